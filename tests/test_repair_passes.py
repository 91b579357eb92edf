"""Repair reads a table once, however many columns it has."""

from earshot.operators import quality as Q
from tests.conftest import rows


def test_all_columns_are_counted_in_one_pass(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            reads.add(len(part))
            yield part
    made = [("NaÃ¯ve a", "x"), ("NaÃ¯ve a", "BjÃ¶rk"), ("b", ""), ("b", None), (None, "BjÃ¶rk"), ("b", "x")]
    df = spark.createDataFrame(made, "track_name string, artist_name string").coalesce(1)
    df = df.mapInPandas(count, df.schema)
    report = Q.repair_metadata(df, ["track_name", "artist_name"], dry_run=True)[1].drop("examples")
    assert rows(report) == [("artist_name", 2, 1, 2), ("track_name", 2, 1, 2)]
    assert reads.value == len(made)
