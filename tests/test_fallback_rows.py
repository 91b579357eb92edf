"""Trending rows of users: as many as asked for, without a shuffle of rows per user and rank."""

from pyspark.sql import functions as F

from earshot.operators import rules as R
from tests.conftest import rows


def test_only_the_wanted_rows_are_made_and_none_is_shuffled(spark):
    trending = spark.range(1, 1001).select(F.col("id").alias("global_rank_7d"), F.concat(F.lit("t"), "id").alias("track_id"),
                                           F.lit("n").alias("track_name"))
    users = spark.createDataFrame([("a", 2), ("b", 0), (None, 0)], "user_id string, personalized_count long")
    played = spark.createDataFrame([("a", "t1"), ("a", "t3"), ("a", "old"), ("b", "t900")], "user_id string, track_id string")
    given = spark.createDataFrame([("a", "t2"), ("a", "t6")], "user_id string, track_id string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.fallback_candidates(users, trending, played, given, 3)
        found = rows(out.select("user_id", "_row", "track_id"))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found == sorted([("a", 1, "t4"), ("a", 2, "t5"), ("a", 3, "t7"), ("b", 1, "t1"), ("b", 2, "t2"), ("b", 3, "t3"),
                            (None, 1, "t1"), (None, 2, "t2"), (None, 3, "t3")], key=repr)
    assert "Exchange hashpartitioning" not in plan


def test_given_tracks_count_up_to_the_rank(spark):
    trending = spark.range(1, 6).select(F.col("id").alias("global_rank_7d"), F.concat(F.lit("t"), "id").alias("track_id"))
    users = spark.createDataFrame([("a", 2), ("full", 4)], "user_id string, personalized_count long")
    none = spark.createDataFrame([], "user_id string, track_id string")
    found = R.fallback_candidates(users, trending, none, spark.createDataFrame([("a", "t1"), ("a", "x")], none.schema), 4, 4)
    assert rows(found.select("user_id", "_row", "track_id")) == [("a", 1, "t2"), ("a", 2, "t3")]
