"""Streams, sinks and staged tables: batch equality and repeats."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.sources import sinks as K
from earshot.sources import stage as G
from earshot.streaming import ingest as T
from earshot.streaming import sessions as X
from tests.conftest import rows


def record(**changes):
    base = dict(source="s", user_id="u", track_id="t", artist_id="a", event_ts="2024-01-01T00:00:00Z", event_type=None, track_name="n", artist_name=" BjÃ¶rk ")
    return json.dumps(base | changes)


def test_ingest_repeats_change_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("\n".join([record(), record(), record(user_id="v"), record(user_id=""), record(event_ts=None), "{broken", record(event_ts="soon")]))
    target, offsets, rejects = (str(tmp_path / n) for n in ("events", "offsets", "rejects"))

    def run(checkpoint):
        stream = T.read_topic(spark, "text", path=str(source))
        T.stream_ingest_events(stream, target, checkpoint, rejects).awaitTermination()
        return rows(T.ingested(spark, target).select("user_id", "event_type", "artist_name", "event_hash"))

    first = run(offsets)
    assert [r[:3] for r in first] == [("u", "play", "Björk"), ("v", "play", "Björk")]
    assert rows(spark.read.parquet(rejects).groupBy("reject_reason").count()) == [
        ("bad_time", 1), ("no_time", 1), ("no_user", 1), ("not_a_record", 1)]
    assert run(offsets) == first                      # nothing new
    assert run(str(tmp_path / "lost")) == first       # all records again, without offsets
    (source / "2.txt").write_text("\n".join([record(), record(event_ts="2024-01-01T01:00:00+01:00"), record(user_id="w")]))
    assert [r[0] for r in run(offsets)] == ["u", "v", "w"]   # the same instant in another zone is the same event
    batch = T.stream_clean(spark.read.text(str(source))).dropDuplicates(["event_hash"])
    assert rows(batch.select("user_id", "event_type", "artist_name", "event_hash")) == run(offsets)


def test_upsert_keeps_the_newest_and_removes(spark, tmp_path):
    folder = str(tmp_path / "t")
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v string, at int, gone boolean")
    read = lambda: rows(K.read_upserted(spark, folder, "k string, v string, at int"))
    assert read() == []
    K.sink_upsert(frame(("a", "1", 1, None), ("b", "1", 5, False)), folder, ["k"], "at", remove="gone")
    K.sink_upsert(frame(("a", "2", 2, False), ("b", "0", 4, True), ("c", "9", 1, False)), folder, ["k"], "at", remove="gone")
    assert read() == [("a", "2", 2), ("b", "1", 5), ("c", "9", 1)]  # an older row removes nothing
    K.sink_upsert(frame(("a", "", 3, True), ("x", "", 3, True)), folder, ["k"], "at", remove="gone")
    assert read() == [("b", "1", 5), ("c", "9", 1)]


def test_upsert_buckets_grow_and_a_failed_one_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    frame = lambda ids, v, at: spark.createDataFrame([(str(i), v, at) for i in ids], "k string, v string, at int")
    read = lambda: rows(K.read_upserted(spark, folder, "k string, v string, at int"))
    upsert = lambda ids, v, at: K.sink_upsert(frame(ids, v, at), folder, ["k"], "at", part_rows=100)
    for k in range(3):  # the table grows; buckets split
        upsert(range(400 * k, 400 * (k + 1)), "old", 1)
    _, live = K.live_buckets(spark, folder)
    assert len(live) >= 12 and sum(n for _, n in live.values()) == 1200 and max(n for _, n in live.values()) <= 150
    assert sum(2.0 ** -len(x) for x in live) == 1
    upsert([7], "new", 2)
    _, after = K.live_buckets(spark, folder)
    assert sum(live[x] != after.get(x) for x in live) == 1 and sum(v == "new" for _, v, _ in read()) == 1
    before = read()
    writer = type(frame([1], "", 1).write)
    for place, name in ((writer, "parquet"), (K, "_commit"), (K, "clean_up")):
        with monkeypatch.context() as m:
            m.setattr(place, name, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost driver")))
            with pytest.raises(RuntimeError):
                upsert(range(1200), "late", 3)
        # Only after the rename of the manifest is the new table there, and then it is whole.
        assert read() == before if name != "clean_up" else {v for _, v, _ in read()} == {"late"}
    upsert(range(1200), "last", 4)
    K.clean_up(spark, folder, keep=1)
    assert len(read()) == 1200 and {v for _, v, _ in read()} == {"last"}


def test_insert_keeps_coarse_parts_until_they_are_large(spark, tmp_path):
    folder = str(tmp_path / "t")
    days = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("event_hash"),
                                    F.date_format(F.expr("date_add(DATE'1995-01-01', CAST(id % 700 AS INT))"), "yyyy-MM-dd").alias("day"))
    insert = lambda df, size: K.sink_insert_ignore(df, folder, part=F.col("day"), levels=(4, 7, 10), part_bytes=size)
    insert(days, 1 << 30)
    assert {p.name for p in (tmp_path / "t").glob("part=*")} == {"part=1995", "part=1996"}
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 8
    insert(days.union(days), 1 << 30)
    insert(days.unionByName(days.select(F.md5(F.concat("event_hash", F.lit("x"))).alias("event_hash"), F.lit("1995-03-02").alias("day"))), 1)
    assert {p.name for p in (tmp_path / "t").glob("part=*")} == {"part=1995", "part=1996", "part=1995-03"}
    table = spark.read.parquet(folder)
    assert table.count() == table.select("event_hash").distinct().count() == 4000


def test_insert_reads_only_the_parts_of_the_batch(spark, tmp_path):
    folder = str(tmp_path / "t")
    frame = lambda *r: spark.createDataFrame(list(r), "event_hash string, day string")
    day = F.col("day")
    K.sink_insert_ignore(frame(("a", "d1"), ("b", "d2")), folder, part=day)
    for p in (tmp_path / "t" / "part=d1").glob("*.parquet"):
        p.write_text("unreadable")
    K.sink_insert_ignore(frame(("b", "d2"), ("c", "d2"), ("c", "d2")), folder, part=day)
    assert sorted(r.event_hash for r in spark.read.parquet(f"{folder}/part=d2").collect()) == ["b", "c"]


def sessions_by_lag(events, gap=X.GAP):
    """Batch twin of session_windows with lag and a running count; used to check the stream."""
    order = Window.partitionBy("user_id").orderBy("event_ts")
    starts = F.col("event_ts") >= F.lag("event_ts").over(order) + F.expr(f"INTERVAL {gap}")
    marked = events.select("user_id", "event_ts", F.coalesce(starts, F.lit(True)).cast("int").alias("_new"))
    numbered = marked.withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (numbered.groupBy("user_id", "_s")
            .agg(F.min("event_ts").alias("session_start"),
                 (F.max("event_ts") + F.expr(f"INTERVAL {gap}")).alias("session_end"), F.count(F.lit(1)).alias("plays"))
            .drop("_s"))


def test_sessions_agree_with_lag(spark):
    df = spark.range(400).select((F.col("id") % 7).cast("string").alias("user_id"),
                                 F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(400_000))).alias("event_ts"))
    by_window, by_lag = X.session_windows(df), sessions_by_lag(df)
    assert rows(by_window) == rows(by_lag.select(*by_window.columns))
    gaps = {r.user_id: r.avg_session_gap_sec for r in X.session_gaps(by_window).collect()}
    for user in gaps:
        mine = sorted((r[1], r[2]) for r in rows(by_window) if r[0] == user)
        between = [(b[0] - a[1]).total_seconds() + 1800 for a, b in zip(mine, mine[1:])]
        assert abs(gaps[user] - sum(between) / len(between)) < 1e-6
    single = X.session_gaps(X.session_windows(df.limit(1))).first()
    assert single.avg_session_gap_sec is None


def test_user_features_grow_by_batches_and_repeats_change_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "features")
    schema = "user_id string, track_id string, event_type string, event_ts timestamp"
    cat = spark.createDataFrame([("t0", "rock"), ("t1", "jazz"), ("t2", None)], "track_id string, genre string")
    times = spark.range(600).select(
        (F.col("id") % 5).cast("string").alias("user_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("track_id"), F.lit("play").alias("event_type"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 2400 + F.pmod(F.xxhash64("id"), F.lit(1200))).alias("event_ts"))
    late = spark.createDataFrame([("late", "t0", "play")], "user_id string, track_id string, event_type string") \
        .withColumn("event_ts", F.timestamp_seconds(F.lit(1_700_000_000 + 600 * 2400 + 20 * 86400)))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source))
        for q in X.stream_user_features(stream, cat, target, str(tmp_path / "offsets"), gap="2 hours"):
            q.awaitTermination()
        return rows(X.read_user_features(spark, target))

    times.filter("event_ts < '2023-11-20'").coalesce(1).write.mode("append").parquet(str(source))
    first = run()
    assert first and run() == first  # nothing new
    times.filter("event_ts >= '2023-11-20'").unionByName(late).coalesce(1).write.mode("append").parquet(str(source))
    got = {r[0]: r for r in run()}
    batch = {r["user_id"]: r for r in X.session_gaps(X.session_windows(times, "2 hours"), "2 hours").collect()}
    assert got.keys() == batch.keys() == {str(i) for i in range(5)}  # the late user's session is still open
    for user, row in batch.items():
        assert got[user][1] == row["last_event_ts"] and abs(got[user][3] - row["avg_session_gap_sec"]) < 0.01
    # A batch that is sent again is not added again.
    before = rows(K.read_upserted(spark, f"{target}/sessions", X.TOTALS))
    again = K.read_upserted(spark, f"{target}/sessions", X.TOTALS)
    K.sink_upsert(again, f"{target}/sessions", ["user_id"], "batch", combine=X.add_totals)
    assert rows(K.read_upserted(spark, f"{target}/sessions", X.TOTALS)) == before


def test_replay_takes_the_first_records(spark):
    df = spark.range(300).select(
        F.lit("s").alias("source"), F.concat(F.lit("u"), F.col("id") % 4).alias("user_id"), F.col("id").cast("string").alias("track_id"),
        F.lit("a").alias("artist_id"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("event_ts"),
        F.lit("play").alias("event_type"), F.lit("n").alias("track_name"), F.lit("x").alias("artist_name"))
    taken = G.replay_events(df, max_records=120)
    times = sorted(json.loads(r["value"])["event_ts"] for r in taken.collect())
    assert times == sorted(json.loads(r["value"])["event_ts"] for r in G.replay_events(df).collect())[:120]


def test_stage_round_trip_prunes_partitions(spark, tmp_path):
    root = str(tmp_path / "stage")
    df = spark.createDataFrame([("a", "u", "t", None, None, "play", "n", "x"), ("b", "u", "t", None, None, "play", "n", "x")],
                               "source string, user_id string, track_id string, artist_id string, event_ts timestamp, event_type string, track_name string, artist_name string")
    df = df.withColumn("event_ts", F.lit("2024-01-01").cast("timestamp"))
    G.write_stage(df, root, "2024-01-01")
    G.write_stage(df, root, "2024-01-09")
    one = G.read_stage(spark, root, "a", "2024-01-09", ["user_id"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and "PartitionFilters: [isnotnull(source" in plan and "ReadSchema: struct<user_id:string>" in plan
    assert rows(G.latest_run_date(spark, root)) == [("a", "2024-01-09"), ("b", "2024-01-09")]
    capped = G.replay_events(G.read_latest(spark, root, "a"), max_per_user=1).collect()
    assert len(capped) == 1 and json.loads(capped[0].value)["event_ts"] == "2024-01-01T00:00:00.000000+00:00"
