"""Trending rows without a stated number: every track that a user hasn't met, over several blocks of the list."""

import __spark_entry__ as entry
from earshot.operators import rules as R
from tests.conftest import rows


def test_all_new_tracks_of_a_list_of_several_blocks(spark):
    n = 2 * R.TREND_BLOCK + 3
    trending = spark.range(1, n + 1).selectExpr("id AS global_rank_7d", "concat('t', id) AS track_id")
    users = spark.createDataFrame([("a", 2), ("b", 0), (None, 0)], "user_id string, personalized_count long")
    edge = R.TREND_BLOCK
    met = [f"t{k}" for k in (1, edge, edge + 1, n)]
    played = spark.createDataFrame([("a", t) for t in met[:3]] + [("a", "old")], "user_id string, track_id string")
    given = spark.createDataFrame([("a", met[3])], played.schema)
    found = rows(R.fallback_candidates(users, trending, played, given, None).select("user_id", "_row", "track_id"))
    left = [k for k in range(1, n + 1) if f"t{k}" not in met]
    want = [("a", i, f"t{k}") for i, k in enumerate(left, 1)] + [(u, k, f"t{k}") for u in ("b", None) for k in range(1, n + 1)]
    assert found == sorted(want, key=repr)
    none = trending.limit(0)
    assert R.fallback_candidates(users, none, played, given, None).count() == 0


def test_the_rule_list_is_whole(spark):
    """300 tracks in trend: a user who played one of them gets the 299 others, more than any stated number."""
    ev = spark.range(300).selectExpr(
        "concat('e', id) AS event_id", "IF(id = 0, 'one', 'many') AS user_id", "concat('t', id) AS track_id", "concat('a', id) AS artist_id",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS event_ts", "'play' AS event_type", "concat('name ', id) AS track_name", "'x' AS artist_name")
    found = R.recs_rule(ev, fallback_rows=None).filter("user_id = 'one'")
    assert found.count() == found.select("track_id").distinct().count() == 299
    assert found.agg({"recommendation_rank": "max"}).first()[0] == 299
    for name in ("fallback_rank_offset", "recs_rule_30d"):
        assert entry.queries() and "<= 200" not in entry.oracle_sql()[name]
    assert "<= 200" in entry.oracle_sql()["recs_rule_30d_ready"]
