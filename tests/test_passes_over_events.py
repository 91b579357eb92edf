"""Events are joined, cleaned and shuffled no more than needed."""

from pyspark.sql import functions as F

from earshot.operators import slices as S
from earshot.sources import stage as G

SCHEMA = "source string, user_id string, track_id string, artist_id string, event_ts timestamp, event_type string, track_name string, artist_name string"


def test_an_event_id_is_shuffled_once_and_none_comes_last(spark):
    one = spark.sql("SELECT 's' AS source, 'u' AS user_id, 't' AS track_id, 'a' AS artist_id, TIMESTAMP_NTZ '2024-01-01 05:00:00' AS event_ts, "
                    "'play' AS event_type, 'n' AS track_name, 'm' AS artist_name")
    ids = spark.createDataFrame([("b",), (None,), ("a",)], "event_id string")
    out = S.event_dedup(ids.crossJoin(one))
    assert [r.event_id for r in out.collect()] == ["a"] and len(out.first().event_hash) == 32
    assert [r.user_id for r in S.event_dedup(ids.filter("event_id IS NULL").crossJoin(one)).collect()] == ["u"]


def test_first_records_are_not_checkpointed(spark, monkeypatch):
    monkeypatch.setattr("earshot.operators.ranking.materialize", None)
    events = [("s", u, f"t{i}", None, None, "play", "n", "m") for i, u in enumerate(["nan", "b", "a", " a ", None, "c"])]
    df = spark.createDataFrame(events, SCHEMA).withColumn("event_ts", F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(0, CAST(substr(track_id, 2) AS INT) DIV 2)"))
    got = [r.value for r in G.replay_events(df, max_records=3).collect()]
    assert sorted(F_track(v) for v in got) == ["t1", "t2", "t3"]
    assert len(G.replay_events(df, max_records=100).collect()) == 4


def F_track(value):
    return value.split('"track_id":"')[1].split('"')[0]
