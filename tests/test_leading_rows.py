"""Stored rows that can't be among a user's first ones are not ranked."""

import pytest
from pyspark.sql import functions as F

from earshot.operators.serving import is_readable, score_bounds
from earshot.plans.fixtures import Inputs
from earshot.plans.serving import recs
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def test_first_rows_keep_their_ranks_and_others_are_left_out(spark):
    t = Inputs(spark, "/root/testdata/sf0.01")
    users = t.profiles.select("user_id").filter("CAST(user_id AS INT) % 50 = 0")
    parts = t.table("part")
    t.table = lambda name, table=t.table: parts.unionByName(parts.withColumn("p_partkey", F.col("p_partkey") + 211 * 40_000)).unionByName(
        parts.withColumn("p_partkey", F.col("p_partkey") + 211 * 70_000)) if name == "part" else table(name)
    whole, first = t.mf_of(users), t.mf_first(users, 3)

    def top(df):
        return rows(df.filter(is_readable()).groupBy("user_id").agg(
            F.slice(F.array_sort(F.collect_list(F.struct("recommendation_rank", "track_id"))), 1, 3)))
    assert top(first) == top(whole)
    assert 3 * users.count() <= first.count() < whole.count() / 2


def test_users_with_few_rows_keep_all(spark):
    few = spark.createDataFrame([("u", "1", "one", "x", 0.5), ("u", "2", "2", "x", 0.9)],
                                "user_id string, track_id string, track_name string, artist_name string, recommendation_score double")
    assert rows(score_bounds(few, 3)) == [("u", None)]


def test_cascades_do_not_rank_all_stored_rows(spark, monkeypatch):
    monkeypatch.setattr(Inputs, "mf_latest", property(lambda self: pytest.fail("all stored rows are ranked")))
    assert recs(Inputs(spark, FOLDER), fallback=False).count() > 0
