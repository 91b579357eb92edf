"""Events that are read several times are joined once and stored."""

from earshot.operators.quality import snapshots
from earshot.plans import load_all
from earshot.plans.fixtures import Inputs
from tests.conftest import rows

load_all()
from earshot.plans import ingest  # noqa: E402  after the views it names

FOLDER = "/root/testdata/sf0.001"
EVENTS = "event_id string, source string, user_id string, track_id string, event_ts timestamp"
CATALOG = "track_id string, genre string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reports_do_not_join_the_events_again(spark):
    t = Inputs(spark, FOLDER)
    tables = snapshots(t.listens, t.catalog)
    assert [n for n in ("summary", "source_breakdown", "top_users") if "Join" in plan(tables[n])] == []


def test_newest_events_with_equal_and_missing_times(spark):
    cat = spark.createDataFrame([("t", "Rock")], CATALOG)
    ev = spark.sql("SELECT CAST(id AS STRING) AS event_id, 's' AS source, 'u' AS user_id, 't' AS track_id, "
                   "CASE WHEN id < 4 THEN NULL ELSE timestamp_seconds(id DIV 3) END AS event_ts FROM range(10)")
    for n, ids in ((2, "98"), (3, "987"), (6, "987654"), (8, "98765432"), (20, "9876543210")):
        assert "".join(r.event_id for r in snapshots(ev, cat, sample=n)["event_sample"].collect()) == ids
    assert rows(snapshots(ev.limit(0), cat)["event_sample"]) == []


def test_batches_of_the_sink_are_stored(spark, monkeypatch):
    plans = []
    real = ingest.K.sink_insert_ignore
    monkeypatch.setattr(ingest.K, "sink_insert_ignore", lambda df, *a, **k: plans.append(plan(df)) or real(df, *a, **k))
    got = ingest.insert(Inputs(spark, FOLDER))
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    assert got.count() == got.select("event_hash").distinct().count() > 0
