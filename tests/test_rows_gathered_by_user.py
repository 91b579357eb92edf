"""Stored rows are a product of customers and parts: they are numbered where they are made, and never shuffled or stored."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from earshot.operators.ranking import ranked
from earshot.operators.serving import is_readable
from earshot.plans import fixtures
from earshot.plans.fixtures import Inputs
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def above_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.index("BroadcastNestedLoopJoin")]


def test_no_stored_row_is_shuffled(spark, monkeypatch):
    assert entry.queries()
    monkeypatch.setattr(fixtures, "CELL_ROWS", 500)  # a remainder's customers are in several cells
    for name in ("latest_version_join", "impressions_from_items", "per_user_minmax"):
        above = above_join(entry.queries()[name](spark, FOLDER))
        assert "Exchange" not in above and "ExistingRDD" not in above, name
    t = Inputs(spark, FOLDER)
    assert "Exchange" not in above_join(t.mf)
    both = ranked(t.view("stored_mf"), ["model_version", "user_id"], [F.col("recommendation_score").desc(), F.col("track_id").asc()],
                  "recommendation_rank")
    assert rows(t.mf) == rows(both.select(*t.mf.columns))


def test_first_rows_end_with_the_last_readable_one_wanted(spark):
    t = Inputs(spark, FOLDER)
    parts, customers = t.table("part"), t.table("customer").limit(3)
    many = parts.crossJoin(spark.range(60)).withColumn("p_partkey", F.col("p_partkey") + 211 * 1000 * F.col("id")).withColumn(
        "p_name", F.when(F.col("id") % 3 == 0, "17").otherwise(F.col("p_name"))).drop("id")
    given = {"part": many, "customer": customers}
    t.table = lambda name, table=t.table: given[name] if name in given else table(name)
    users = customers.select(F.col("c_custkey").cast("string").alias("user_id"))
    first, whole = t.mf_first(users, 4), t.mf_of(users)
    last = whole.filter(is_readable()).groupBy("user_id").agg(
        F.get(F.sort_array(F.collect_list("recommendation_rank")), F.lit(3)).alias("last"))
    assert rows(first) == rows(whole.join(last, "user_id").filter("recommendation_rank <= last").select(*first.columns))
    assert first.count() < whole.count() / 10
