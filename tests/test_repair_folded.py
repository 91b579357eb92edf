"""Repaired tables are counted from their distinct names; stored rows are counted without being made."""

from pyspark.sql import functions as F

from earshot.operators import quality as Q
from earshot.plans import quality as P
from earshot.plans.fixtures import Inputs
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def test_folded_tables_repair_as_their_rows_do(spark):
    made = [("NaÃ¯ve a", "x"), ("NaÃ¯ve a", "x"), ("Naïve a", "x"), ("NaÃ¯ve a", "BjÃ¶rk"), ("b", ""), ("b", None), (None, "BjÃ¶rk")]
    df = spark.createDataFrame(made, "track_name string, artist_name string")
    whole, report = Q.repair_metadata(df, list(Q.REPAIR_COLUMNS))
    folded, short = Q.repair_metadata(Q.folded_names(df, Q.REPAIR_COLUMNS), list(Q.REPAIR_COLUMNS), rows="n")
    assert rows(short) == rows(report)
    assert rows(folded.groupBy(*Q.REPAIR_COLUMNS).agg(F.sum("n"))) == rows(whole.groupBy(*Q.REPAIR_COLUMNS).agg(F.count(F.lit(1))))
    one = Q.repair_metadata(df.groupBy("track_name").count(), ["track_name"], rows="count")[1]
    assert rows(one) == rows(Q.repair_metadata(df, ["track_name"])[1])


def test_stored_rows_are_counted_and_not_made(spark, monkeypatch):
    t = Inputs(spark, FOLDER)
    odd = t.table("customer").unionByName(t.table("customer").limit(40)).unionByName(
        t.table("customer").limit(1).withColumn("c_custkey", F.lit(None).cast("long")))
    t.table = lambda name, table=t.table: odd if name == "customer" else table(name)
    named = rows(t.view("stored_mf").groupBy("model_version", "track_name", "artist_name").agg(F.count(F.lit(1))))
    assert rows(t.mf_names().groupBy("model_version", "track_name", "artist_name").agg(F.sum("n"))) == named
    made = Inputs.view
    monkeypatch.setattr(Inputs, "view", lambda self, name, *a, **k: made(self, name, *a, **k) if name != "stored_mf" or len(k) > 1
                        else (_ for _ in ()).throw(AssertionError("all stored rows are made")))
    assert sum(r["rows"] for r in P.repaired_counts(Inputs(spark, FOLDER)).filter("stored = 'recommendations_mf'").collect()) > 0
