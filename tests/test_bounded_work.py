"""Work that must not grow faster than the rows: shuffles of rolling windows, folders of an upsert table."""

import pytest

from earshot.plans.fixtures import Inputs
from earshot.sources import sinks as K
from earshot.streaming import sessions as X
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def test_windows_of_a_user_are_not_shuffled(spark):
    t = Inputs(spark, FOLDER)
    plan = X.rolling_top_genres(X.genre_counts(t.listens, t.catalog))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate explode(sequence")]
    assert "Exchange" not in above


def test_buckets_are_bounded_in_number(spark, tmp_path):
    folder = str(tmp_path / "t")
    for at, rest in ((1, 0), (2, 1)):
        df = spark.range(4000).filter(f"id % 2 = {rest} OR id < 100").selectExpr("id AS k", f"{at} AS at")
        K.sink_upsert(df, folder, ["k"], "at", part_rows=10, most_buckets=16)
    buckets = K.live_buckets(spark, folder)[1]
    assert len(buckets) == 16 and sum(n for _, n in buckets.values()) == 4000
    found = rows(K.read_upserted(spark, folder, "k long, at int"))
    assert found == sorted(((k, 2 if k % 2 or k < 100 else 1) for k in range(4000)), key=repr)


@pytest.mark.parametrize("most", [1, 2])
def test_few_buckets(spark, tmp_path, most):
    folder = str(tmp_path / "t")
    K.sink_upsert(spark.range(100).selectExpr("id AS k", "1 AS at"), folder, ["k"], "at", part_rows=10, most_buckets=most)
    assert len(K.live_buckets(spark, folder)[1]) == most


def test_a_play_is_in_seven_windows(spark):
    events = spark.sql("SELECT 'u' AS user_id, 't' AS track_id, 'play' AS event_type, TIMESTAMP_NTZ '2024-01-01 05:00:00' AS event_ts")
    cat = spark.sql("SELECT 't' AS track_id, 'Rock' AS genre")
    ends = rows(X.genre_counts(events, cat).selectExpr("CAST(window_end AS STRING)", "plays"))
    assert ends == [(f"2024-01-0{d} 00:00:00", 1) for d in range(2, 9)]
