"""Sessions, rolling genres and user features, as streams and as batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from earshot.operators.popularity import best_name, count_rows
from earshot.operators.ranking import ranked
from earshot.sources.sinks import merged, read_upserted, sink_upsert

GAP = "30 minutes"


def session_windows(events: DataFrame, gap: str = GAP, watermark: str = "1 day") -> DataFrame:
    """Sessions per user: runs of events with less than `gap` between neighbours.

    Works on a stream (append mode: a session is sent once the watermark has passed it) and on
    a table. The session ends with its last event plus the gap.
    """
    if not events.isStreaming:
        return _sessions_of_table(events, gap)
    # Session windows that only touch are merged, so they are kept a microsecond short of the gap.
    return (events.withWatermark("event_ts", watermark)
            .groupBy("user_id", F.session_window("event_ts", f"{gap} -1 microseconds").alias("w"))
            .agg(count_rows().alias("plays"))
            .select("user_id", F.col("w.start").alias("session_start"),
                    (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("session_end"), "plays"))


def _joined_runs(pieces: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Merge pieces (first_ts, last_ts, plays) of each key that follow each other within the gap."""
    order = Window.partitionBy(*keys).orderBy("first_ts", "last_ts")
    opens = F.coalesce(F.col("first_ts") >= F.lag("last_ts").over(order) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    marked = pieces.withColumn("_new", opens.cast("long"))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("plays").alias("plays"))


def _sessions_of_table(events: DataFrame, gap: str) -> DataFrame:
    """Sessions within each user's hours first, then across them.

    Equal times are folded before the first shuffle and a busy user is spread over their hours;
    the second step sees runs instead of events.
    """
    times = (events.groupBy("user_id", "event_ts").agg(count_rows().alias("plays"))
             .select("user_id", F.date_trunc("hour", "event_ts").alias("_hour"), F.col("event_ts").alias("first_ts"),
                     F.col("event_ts").alias("last_ts"), "plays"))
    runs = _joined_runs(times, ["user_id", "_hour"], gap).drop("_hour", "_run")
    return _joined_runs(runs, ["user_id"], gap).select(
        "user_id", F.col("first_ts").alias("session_start"),
        (F.col("last_ts") + F.expr(f"INTERVAL {gap}")).alias("session_end"), "plays")


def _top_genres(group: list[str], n: int) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("_rank", "genre"))), lambda s: s.genre)


def genres(cat: DataFrame) -> DataFrame:
    return cat.groupBy("track_id").agg(best_name("genre").alias("genre")).filter("genre IS NOT NULL")


def genre_panes(events: DataFrame, cat: DataFrame, slide: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Plays per user, slide and genre: an event is in one row, whatever the number of windows it is in. A stream is joined
    with the static catalog."""
    plays = events.filter("event_type = 'play' AND track_id IS NOT NULL").join(genres(cat), "track_id")
    if events.isStreaming:
        plays = plays.withWatermark("event_ts", watermark)
    panes = plays.groupBy("user_id", F.window("event_ts", slide).alias("d"), "genre").agg(count_rows().alias("plays"))
    return panes.select("user_id", (F.window_time("d") if events.isStreaming else F.col("d.start")).alias("pane_ts"), "genre", "plays")


def genre_counts(events: DataFrame, cat: DataFrame, window: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Plays per user, sliding window and genre of a table.

    Panes are gathered by user before they go into every window they are in, so the windows aren't shuffled, here or when they
    are ranked. A user has a row per day and genre by then, however much they play.
    """
    ends = F.expr(f"sequence(pane_ts + INTERVAL {window}, pane_ts + INTERVAL 1 SECOND, -INTERVAL {slide})")
    panes = genre_panes(events, cat, slide).repartition("user_id")
    # Exploded rows are known to be gathered by user still; those that F.window makes are not.
    return (panes.select("user_id", F.explode(ends).alias("window_end"), "genre", "plays")
            .groupBy("user_id", "window_end", "genre").agg(F.sum("plays").alias("plays")))


def rolling_top_genres(counts: DataFrame, n: int = 5) -> DataFrame:
    """The n most played genres per user and window of genre_counts rows, as an array."""
    group = ["user_id", "window_end"]
    order = [F.col("plays").desc(), F.col("genre").asc()]
    return ranked(counts, group, order, "_rank", n).groupBy(*group).agg(_top_genres(group, n).alias("top_genres"))


def stream_top_genres(events: DataFrame, cat: DataFrame, n: int = 5, window: str = "7 days", slide: str = "1 day",
                      watermark: str = "1 day") -> DataFrame:
    """The n most played genres per user and window of a stream, once the watermark has passed the window.

    Two event-time aggregates: panes, then one row of state per user and window with its panes, whose plays are summed by
    genre when the window is sent.
    """
    panes = genre_panes(events, cat, slide, watermark)
    held = (panes.groupBy("user_id", F.window("pane_ts", window, slide).alias("w"))
            .agg(F.collect_list(F.struct("genre", "plays")).alias("held")))
    totals = F.transform(F.array_distinct(F.col("held.genre")), lambda g: F.struct(
        F.aggregate(F.filter("held", lambda p: p["genre"] == g), F.lit(0).cast("long"), lambda s, p: s - p["plays"]).alias("less"),
        g.alias("genre")))
    return held.select("user_id", F.col("w.end").alias("window_end"),
                       F.transform(F.slice(F.array_sort(totals), 1, n), lambda g: g["genre"]).alias("top_genres"))


def session_gaps(sessions: DataFrame, gap: str = GAP) -> DataFrame:
    """Mean seconds from a session's last event to the next session's first, per user.

    The gaps telescope: they sum to the time from the first session's start to the last one's
    end, less the time spent in sessions. So this is one aggregate, and a user with very many
    sessions is never sorted in one task.
    """
    last = F.col("session_end") - F.expr(f"INTERVAL {gap}")

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))
    between = (F.max(micros(F.col("session_start"))) - F.min(micros(last))
               - (F.sum(micros(last) - micros(F.col("session_start")))
                  - F.max_by(micros(last) - micros(F.col("session_start")), F.col("session_start"))
                  - F.min_by(micros(last) - micros(F.col("session_start")), F.col("session_start"))))
    return (sessions.groupBy("user_id").agg(
        F.when(count_rows() > 1, between / 1e6 / (count_rows() - 1)).alias("avg_session_gap_sec"),
        F.max(last).alias("last_event_ts")))


def user_features(events: DataFrame, cat: DataFrame, gap: str = GAP, days: int = 7, n: int = 5,
                  updated_at: Column | None = None) -> DataFrame:
    """Last event, top genres of the last days, and mean session gap of every user."""
    from earshot.operators.slices import since

    recent = (events.filter(since(events, days)).filter("event_type = 'play' AND track_id IS NOT NULL")
              .join(genres(cat), "track_id").groupBy("user_id", "genre").agg(count_rows().alias("plays")))
    top = ranked(recent, ["user_id"], [F.col("plays").desc(), F.col("genre").asc()], "_rank", n)
    top = top.groupBy("user_id").agg(_top_genres(["user_id"], n).alias("top_genres"))
    gaps = session_gaps(session_windows(events, gap), gap)
    return gaps.join(top, "user_id", "left").select(
        "user_id", "last_event_ts", F.coalesce("top_genres", F.array().cast("array<string>")).alias("top_genres"),
        F.col("avg_session_gap_sec").cast("float").alias("avg_session_gap_sec"),
        (updated_at if updated_at is not None else F.current_timestamp()).alias("updated_at"))


TOTALS = "user_id STRING, sessions BIGINT, first_start TIMESTAMP, last_event_ts TIMESTAMP, inside BIGINT, batch BIGINT"
TOPS = "user_id STRING, window_end TIMESTAMP, top_genres ARRAY<STRING>"


def session_totals(sessions: DataFrame, gap: str = GAP) -> DataFrame:
    """What the mean gap of each user follows from, in a form that adds up: sessions, first start, last event, and
    microseconds inside sessions."""
    last = F.col("session_end") - F.expr(f"INTERVAL {gap}")
    return sessions.groupBy("user_id").agg(
        count_rows().alias("sessions"), F.min("session_start").alias("first_start"), F.max(last).alias("last_event_ts"),
        F.sum(F.unix_micros(last) - F.unix_micros("session_start")).alias("inside"))


def add_totals(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored totals with those of a batch added, once: a row that has seen the batch stays as it is."""
    seen = current.select("user_id", F.col("batch").alias("_seen"))
    fresh = incoming.join(seen, "user_id", "left").filter("_seen IS NULL OR _seen < batch").select(*incoming.columns)
    return current.unionByName(fresh).groupBy("user_id").agg(
        F.sum("sessions").alias("sessions"), F.min("first_start").alias("first_start"),
        F.max("last_event_ts").alias("last_event_ts"), F.sum("inside").alias("inside"), F.max("batch").alias("batch"))


def stream_user_features(events: DataFrame, cat: DataFrame, target: str, checkpoint: str, gap: str = GAP,
                         watermark: str = "1 day", n: int = 5) -> list[StreamingQuery]:
    """Keep user features below `target` from a stream of events, all available input at once.

    Two streams: sessions that the watermark has passed are added to totals per user, and the top genres of the newest
    finished 7 days are kept per user. State in the streams is open sessions and open windows only. A batch that runs again
    after a failure changes nothing: totals carry the number of the last batch added, and tops go by their window. The
    batch numbers are those of `checkpoint`, so target and checkpoint are started together.
    """
    def add(batch: DataFrame, number: int) -> None:
        totals = session_totals(batch, gap).withColumn("batch", F.lit(number).cast("long"))
        sink_upsert(totals, f"{target}/sessions", ["user_id"], "batch", combine=add_totals)

    def renew(batch: DataFrame, _: int) -> None:
        newest = merged(batch.limit(0), batch, ["user_id"], "window_end")
        sink_upsert(newest, f"{target}/genres", ["user_id"], "window_end")

    tops = stream_top_genres(events, cat, n, watermark=watermark)
    return [rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True).start()
            for rows, write, name in ((session_windows(events, gap, watermark), add, "sessions"), (tops, renew, "genres"))]


def read_user_features(spark: SparkSession, target: str) -> DataFrame:
    """The features as the streams have left them: last event and mean gap of finished sessions, and top genres of the
    newest finished 7 days (none for users without plays in them)."""
    totals, tops = read_upserted(spark, f"{target}/sessions", TOTALS), read_upserted(spark, f"{target}/genres", TOPS)
    newest = tops.filter(F.col("window_end") == tops.agg(F.max("window_end")).scalar()).select("user_id", "top_genres")
    between = F.unix_micros("last_event_ts") - F.unix_micros("first_start") - F.col("inside")
    return totals.join(newest, "user_id", "left").select(
        "user_id", "last_event_ts", F.coalesce("top_genres", F.array().cast("array<string>")).alias("top_genres"),
        F.when(F.col("sessions") > 1, between / 1e6 / (F.col("sessions") - 1)).cast("float").alias("avg_session_gap_sec"))
