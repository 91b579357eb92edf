"""Sources, sinks and streams over the given tables."""

from pyspark.sql import functions as F

from earshot.functions.events import stored_event_hash
from earshot.plans.registry import define, query
from earshot.session import stored, workspace
from earshot.sources import raw as W
from earshot.sources import sinks as K
from earshot.sources import stage as G
from earshot.sources import tables as B
from earshot.streaming import ingest as T
from earshot.streaming import sessions as X

EV = ("listen_events",)
STAGE = "source, user_id, track_id, artist_id, event_ts, event_type, track_name, artist_name"


def ntz(df):
    """Zoned times as plain UTC ones, the form the given tables have."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n, kind in df.dtypes if kind == "timestamp"})


def staged(t):
    """The listening events written as two staged runs."""
    root = workspace(t.spark, "stage")
    events = t.listens.withColumn("event_ts", F.col("event_ts").cast("timestamp")).drop("event_id")
    G.write_stage(events.filter("event_ts < '1998-01-01'"), root, "2024-01-01")
    G.write_stage(events.filter("event_ts >= '1998-01-01'"), root, "2024-02-01")
    return root


query("scan_stage_events", EV, f"SELECT {STAGE} FROM listen_events WHERE source = 'src_a' AND event_ts >= TIMESTAMP '1998-01-01'")(
    lambda t: ntz(G.read_stage(t.spark, staged(t), "src_a", "2024-02-01", STAGE.split(", "))))
query("latest_run_date", EV, """
SELECT source, max(CASE WHEN event_ts < TIMESTAMP '1998-01-01' THEN '2024-01-01' ELSE '2024-02-01' END) AS run_date FROM listen_events GROUP BY source""")(
    lambda t: G.latest_run_date(t.spark, staged(t)))
query("write_stage", EV, """
SELECT source, CASE WHEN event_ts < TIMESTAMP '1998-01-01' THEN '2024-01-01' ELSE '2024-02-01' END AS run_date, count(*) AS rows
FROM listen_events GROUP BY 1, 2""")(
    lambda t: G.read_stage(t.spark, staged(t)).groupBy("source", "run_date").agg(F.count(F.lit(1)).alias("rows")))

ISO = "strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
CLEANED = "replace(nullif(trim(track_name), ''), 'NaÃ¯ve', 'Naïve')"


def typed(t):
    return t.listens.withColumn("event_ts", F.col("event_ts").cast("timestamp"))


SEQUENCE = f"""event_ts, source NULLS FIRST, user_id, track_id NULLS FIRST, artist_id NULLS FIRST, event_type,
 {CLEANED} NULLS FIRST, artist_name NULLS FIRST"""
REPLAYED = f"""SELECT user_id AS key, source, user_id, track_id, artist_id, {ISO} AS event_ts, event_type,
 {CLEANED} AS track_name, artist_name"""


def replayed(records):
    return records.select("key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in STAGE.split(", ")])


query("replay_events", EV, f"""{REPLAYED} FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {SEQUENCE}) AS n FROM listen_events) WHERE n <= 10""")(
    lambda t: replayed(G.replay_events(typed(t), max_per_user=10)))
query("replay_first_events", EV, f"{REPLAYED} FROM listen_events ORDER BY {SEQUENCE} LIMIT 500")(
    lambda t: replayed(G.replay_events(typed(t), max_records=500)))

LOG = "concat_ws(chr(9), user_id, {ts}, coalesce(artist_id,''), coalesce(artist_name,''), coalesce(track_id,''), coalesce(track_name,''))"


def play_log(t):
    """Play log lines of all events: those of one source lack a field, skips have no valid time."""
    ts = F.when(F.col("event_type") == "skip", "yesterday").otherwise(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    parts = [F.col("user_id"), ts, *[F.coalesce(c, F.lit("")) for c in ("artist_id", "artist_name", "track_id")]]
    full = F.concat_ws("\t", *parts, F.coalesce("track_name", F.lit("")))
    return t.listens.select(F.when(F.col("source") == "src_r", F.concat_ws("\t", *parts)).otherwise(full).alias("value"))


@query("load_play_log_tsv", EV, f"""
SELECT 'log' AS source, user_id, track_id, artist_id, event_ts, 'play' AS event_type, {CLEANED} AS track_name, artist_name
FROM listen_events WHERE source <> 'src_r' AND event_type = 'play'""")
def log(t):
    path = workspace(t.spark, "log")
    play_log(t).write.text(path)
    return ntz(W.load_play_log_tsv(t.spark, path, "log"))


CATALOG_SQL = """
SELECT 'cat' AS source, track_id, NULL AS artist_id, nullif(track_name,'') AS track_name, nullif(artist_name,'') AS artist_name, genre,
  CAST(duration_sec AS DOUBLE) AS duration_sec FROM track_catalog"""


def csv_cells(columns):
    """A CSV line: every cell that is not null in quotes."""
    return F.concat_ws(",", *[F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in columns])


@query("load_catalog_csv", ("track_catalog",), CATALOG_SQL)
def catalog(t):
    """Files with two header lines each, read whole by the loader."""
    path = workspace(t.spark, "catalog")
    heads = (",track,track,artist,track,track", "track_id,number,title,name,genre_top,duration")
    line = csv_cells([F.col("track_id"), F.lit("x"), F.col("track_name"), F.col("artist_name"), F.col("genre"), F.col("duration_sec").cast("string")])
    body = t.catalog.select(F.pmod(F.xxhash64("track_id"), F.lit(4)).alias("part"), F.lit(2).alias("k"), line.alias("value"))
    top = t.spark.range(4).select(F.col("id").alias("part"), F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("k", "value"))
    (body.unionByName(top).repartition(4, "part").sortWithinPartitions("part", "k").select("value").write.text(path))
    return W.load_catalog_csv(t.spark, path, "cat").withColumn("duration_sec", F.col("duration_sec").cast("double"))


@query("load_catalog_csv_one_header", ("track_catalog",), CATALOG_SQL)
def catalog_one_header(t):
    path = workspace(t.spark, "catalog-one")
    t.catalog.select("track_id", F.lit("x").alias("number"), F.col("track_name").alias("title"), "artist_name", "genre",
                     F.col("duration_sec").cast("string").alias("duration")).write.csv(path, header=True)
    return W.load_catalog_csv(t.spark, path, "cat").withColumn("duration_sec", F.col("duration_sec").cast("double"))


def odd_table(t, *more):
    """Events under unfamiliar column names, times as epoch milliseconds (moved past 2001), some missing."""
    ms = F.when(F.col("event_type") == "play", F.unix_millis(F.expr("event_ts + INTERVAL 4000 DAYS").cast("timestamp")).cast("string"))
    return t.listens.select(F.col("user_id").alias("UserId"), F.col("track_id").alias("song-id"), F.col("artist_id").alias("audio_vector"),
                            ms.alias("Played At"), F.col("track_name").alias("song title"), F.col("event_type").alias("action"), *more)


query("normalise_events", EV, f"""
SELECT 'odd' AS source, user_id, track_id, NULL AS artist_id, event_ts + INTERVAL 4000 DAYS AS event_ts, event_type, {CLEANED} AS track_name, NULL AS artist_name
FROM listen_events WHERE event_type = 'play'""")(lambda t: ntz(B.normalise_events(odd_table(t), "odd")))
query("normalise_events_generated_time", EV, """
SELECT event_type, count(*) AS rows, count(*) AS distinct_times_or_rows FROM listen_events GROUP BY event_type""")(
    lambda t: B.normalise_events(odd_table(t), "odd", True, "2030-01-01").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.when(F.first("event_type") == "skip", F.countDistinct("event_ts")).otherwise(F.count(F.lit(1))).alias("distinct_times_or_rows")))
query("infer_event_columns", EV, "SELECT user_id, track_id, event_type FROM listen_events")(
    lambda t: B.map_events(odd_table(t), "odd", B.infer_event_columns(odd_table(t).columns)).select("user_id", "track_id", "event_type"))
query("ingest_audit", EV, """
SELECT 'odd' AS dataset, metric, key, value FROM (
 SELECT 'rows_written' AS metric, NULL AS key, CAST(count(*) FILTER (event_type = 'play') AS VARCHAR) AS value FROM listen_events
 UNION ALL SELECT 'bad_rows', NULL, CAST(count(*) FILTER (event_type <> 'play') AS VARCHAR) FROM listen_events
 UNION ALL SELECT 'skipped', 'missing_user', '0' UNION ALL SELECT 'skipped', 'missing_or_bad_time', CAST(count(*) FILTER (event_type <> 'play') AS VARCHAR) FROM listen_events
 UNION ALL SELECT 'status', NULL, 'ok' UNION ALL SELECT 'timestamp_mode', NULL, 'source'
 UNION ALL SELECT 'mapped_column', 'user_id', 'UserId' UNION ALL SELECT 'mapped_column', 'track_id', 'song-id'
 UNION ALL SELECT 'mapped_column', 'event_ts', 'Played At' UNION ALL SELECT 'mapped_column', 'track_name', 'song title'
 UNION ALL SELECT 'mapped_column', 'event_type', 'action' UNION ALL SELECT 'missing_column', 'artist_id', '' UNION ALL SELECT 'missing_column', 'artist_name', '')""")(
    lambda t: B.ingest_audit(odd_table(t), "odd", B.infer_event_columns(odd_table(t).columns)))


@query("file_audit", EV, """
SELECT source AS file, '.parquet' AS extension, count(*) FILTER (event_type = 'play') AS rows_written, 0::BIGINT AS missing_user,
  count(*) FILTER (event_type <> 'play') AS missing_or_bad_time, CASE WHEN count(*) FILTER (event_type = 'play') > 0 THEN 'ok' ELSE 'no_rows' END AS status
FROM listen_events GROUP BY source""")
def audit_of_files(t):
    """Events under unfamiliar names in folders by source; the audit of their files, summed by folder."""
    root = workspace(t.spark, "audit")
    odd_table(t, "source").write.partitionBy("source").parquet(f"{root}/raw")
    audit = B.gated_stage(t.spark.read.parquet(f"{root}/raw").drop("source"), "odd", f"{root}/stage", "2024-01-01", f"{root}/audit",
                          files=B.input_files(t.spark, f"{root}/raw"))
    counts = ("rows_written", "missing_user", "missing_or_bad_time")
    return (audit.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("file"), "extension")
            .agg(*[F.sum(c).alias(c) for c in counts], F.max("status").alias("status")))


@query("load_any_table", ("track_catalog",), """
SELECT kind, track_id, genre FROM (SELECT track_id, genre, unnest(['csv','jsonl','parquet','pipe','text','tsv']) AS kind FROM track_catalog)""")
def any_table(t):
    root = workspace(t.spark, "any")
    rows = t.catalog.select("track_id", "genre")
    rows.write.parquet(f"{root}/t.parquet")
    rows.write.json(f"{root}/t.jsonl", compression="gzip")
    rows.write.csv(f"{root}/t.csv", header=True)
    rows.write.csv(f"{root}/t.psv", header=True, sep="|")
    rows.write.csv(f"{root}/t.txt", header=True, sep="\t")
    rows.write.csv(f"{root}/t.tsv", header=True, sep="\t", compression="bzip2")
    out = None
    for name in ("t.parquet", "t.jsonl", "t.csv", "t.psv", "t.txt", "t.tsv"):
        part = B.load_any_table(t.spark, f"{root}/{name}").select(F.lit(B.table_kind(name)).alias("kind"), "track_id", "genre")
        out = part if out is None else out.unionByName(part)
    return out


HASHED = f"""SELECT source, user_id, track_id, artist_id, event_ts, event_type, {CLEANED} AS track_name, artist_name,
 md5(concat(source, chr(31), user_id, chr(31), coalesce(track_id,''), chr(31), coalesce(artist_id,''), chr(31), {ISO}, chr(31),
   event_type, chr(31), coalesce({CLEANED},''), chr(31), coalesce(artist_name,''))) AS event_hash FROM listen_events"""
define("hashed_events", EV, HASHED)
define("ingested", ("hashed_events",), "SELECT DISTINCT * FROM hashed_events")


def raw_stream(t):
    """The given line items read as a stream, joined to events and sent twice as raw JSON records. The line items are dealt
    out over tasks, by the key they are joined with, as records are many times as large."""
    lines = t.table("lineitem")
    stream = t.spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem.parquet").parquet(t.folder)
    stream = stream.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    events = t.view("listen_events", lineitem=stream).drop("event_id").withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    value = F.when(F.col("copy") == 3, F.lit("not json")).otherwise(F.to_json(F.struct(*STAGE.split(", "))))
    return twice.select(value.alias("value"))


@query("stream_ingest_events", ("ingested",), "SELECT * FROM ingested")
def ingest(t):
    root = workspace(t.spark, "ingest")
    T.stream_ingest_events(raw_stream(t), f"{root}/events", f"{root}/offsets", f"{root}/rejects").awaitTermination()
    return ntz(T.ingested(t.spark, f"{root}/events"))


@query("stream_clean", ("hashed_events",), "SELECT * FROM hashed_events UNION ALL SELECT * FROM hashed_events")
def clean(t):
    root = workspace(t.spark, "clean")
    T.append_stream(T.stream_clean(raw_stream(t)), f"{root}/out", f"{root}/offsets").awaitTermination()
    return ntz(t.spark.read.parquet(f"{root}/out"))


@query("stream_dedup", EV, "SELECT user_id, track_id, event_ts FROM listen_events GROUP BY ALL")
def dedup(t):
    root = workspace(t.spark, "dedup")
    stream = T.stream_dedup(T.stream_clean(raw_stream(t))).select("user_id", "track_id", "event_ts")
    T.append_stream(stream, f"{root}/out", f"{root}/offsets").awaitTermination()
    return ntz(t.spark.read.parquet(f"{root}/out"))


@query("sink_insert_ignore", ("ingested",), "SELECT event_hash, user_id, track_id FROM ingested")
def insert(t):
    target = f"{workspace(t.spark, 'insert')}/events"
    from earshot.functions.text import clean_text
    events = t.listens.withColumn("track_name", clean_text("track_name")).withColumn("event_hash", stored_event_hash())
    # Batches come from a stored table: a batch is read for the folders it touches and again for its rows. The hash is
    # kept as bytes, half its text, and spelt out when it is read.
    events = stored(events.select(F.unhex("event_hash").alias("event_hash"), "user_id", "track_id"), "batch")
    by_hash = F.left(F.lower(F.hex("event_hash")), F.lit(3))
    K.sink_insert_ignore(events.filter("user_id < '5'"), target, part=by_hash, levels=(1, 2, 3), part_bytes=1 << 10)
    K.sink_insert_ignore(events, target, part=by_hash, levels=(1, 2, 3))
    return t.spark.read.parquet(target).select(F.lower(F.hex("event_hash")).alias("event_hash"), "user_id", "track_id")


@query("sink_upsert", ("vote_state",), "SELECT user_id, track_id, user_selected_vibe FROM vote_state")
def upsert(t):
    target = f"{workspace(t.spark, 'upsert')}/votes"
    log = t.votes.withColumn("seen", F.struct("voted_at", "vote_seq", "vote_line")).select("user_id", "track_id", "user_selected_vibe", "seen")
    old, new = log.filter("seen.voted_at < '1998-01-01'"), log.filter("seen.voted_at >= '1998-01-01'")
    for part in (new, old):
        K.sink_upsert(K.merged(part.limit(0), part, ["user_id", "track_id"], "seen"), target, ["user_id", "track_id"], "seen",
                      part_rows=500)
    return K.read_upserted(t.spark, target, log.schema).drop("seen")


@query("sink_upsert_removal", ("vote_state",), "SELECT user_id, track_id, user_selected_vibe FROM vote_state WHERE user_selected_vibe > 'f'")
def upsert_removal(t):
    """Overrides that follow the votes: a user's newest vote for some moods takes the row away."""
    target = f"{workspace(t.spark, 'overrides')}/votes"
    log = t.votes.withColumn("seen", F.struct("voted_at", "vote_seq", "vote_line")).select("user_id", "track_id", "user_selected_vibe", "seen")
    for part in (log.filter("seen.voted_at < '1998-01-01'"), log.filter("seen.voted_at >= '1998-01-01'")):
        newest = K.merged(part.limit(0), part, ["user_id", "track_id"], "seen").withColumn("gone", F.col("user_selected_vibe") <= "f")
        K.sink_upsert(newest, target, ["user_id", "track_id"], "seen", part_rows=500, remove="gone")
    return K.read_upserted(t.spark, target, log.schema).drop("seen")


@query("sink_replace_version", ("mf",), """
SELECT model_version, count(*) AS rows, min(recommendation_rank) AS first_rank FROM mf WHERE model_version <> 'mf_v1' OR recommendation_rank > 1 GROUP BY model_version""")
def replace(t):
    target = f"{workspace(t.spark, 'versions')}/mf"
    K.sink_replace_version(t.mf, target)
    K.sink_replace_version(t.mf.filter("model_version = 'mf_v1' AND recommendation_rank > 1"), target)
    return t.spark.read.parquet(target).groupBy("model_version").agg(
        F.count(F.lit(1)).alias("rows"), F.min("recommendation_rank").alias("first_rank"))


@query("catalog_upserts", ("track_catalog",), "SELECT source, track_id, track_name, genre FROM track_catalog")
def catalog_stream(t):
    root = workspace(t.spark, "catalog-stream")
    parts = t.table("part")
    stream = t.spark.readStream.schema(parts.schema).option("pathGlobFilter", "part.parquet").parquet(t.folder)
    rows = (t.view("track_catalog", part=stream).withColumn("updated_at", F.explode(F.sequence(F.lit(1), F.lit(2))))
            .withColumn("genre", F.when(F.col("updated_at") == 2, F.col("genre")).otherwise("old"))
            .select("source", "track_id", "track_name", "genre", "updated_at"))
    T.catalog_upserts(rows, f"{root}/catalog", f"{root}/offsets").awaitTermination()
    return K.read_upserted(t.spark, f"{root}/catalog", rows.schema).drop("updated_at")


@query("replay_rebuild", ("ingested",), "SELECT event_hash, user_id, track_id FROM ingested")
def rebuild(t):
    target = f"{workspace(t.spark, 'rebuild')}/events"
    T.replay_rebuild(typed(t), target)
    return t.spark.read.parquet(target).select("event_hash", "user_id", "track_id")


SESSIONS = """s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM (
  SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events)),
sess AS (SELECT CAST(user_id AS VARCHAR) AS user_id, min(ts) AS session_start, max(ts) AS last_ts, max(ts) + INTERVAL {gap} AS session_end, count(*) AS plays FROM s GROUP BY s.user_id, n)"""


def clicks(t):
    return t.table("events").select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("event_ts"))


for key, gap in (("session_windows", "30 minutes"), ("session_windows_12h", "12 hours")):
    query(key, (), "WITH " + SESSIONS.format(gap=gap.upper()) + " SELECT user_id, session_start, session_end, plays FROM sess")(
        lambda t, gap=gap: X.session_windows(clicks(t), gap))


@query("stream_session_windows", (), "WITH " + SESSIONS.format(gap="12 HOURS") + """
SELECT user_id, session_start, session_end, plays FROM sess WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions(t):
    """Sessions the watermark has passed; later ones stay in state until more events arrive."""
    root = workspace(t.spark, "sessions")
    table = t.table("events")
    stream = t.spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).select(
        F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("event_ts"))
    T.append_stream(X.session_windows(stream, "12 hours"), f"{root}/out", f"{root}/offsets").awaitTermination()
    return ntz(t.spark.read.parquet(f"{root}/out"))


define("genre_of", ("track_catalog",), "SELECT track_id, max(nullif(genre,'')) AS genre FROM track_catalog GROUP BY track_id HAVING max(nullif(genre,'')) IS NOT NULL")
query("rolling_top_genres", ("listen_events", "genre_of"), """
c AS (SELECT user_id, w AS window_end, genre, count(*) AS plays FROM (
  SELECT e.user_id, g.genre, unnest(list_transform(range(0, 7), lambda i: date_trunc('day', e.event_ts) + to_days(CAST(i + 1 AS INTEGER)))) AS w
  FROM listen_events e JOIN genre_of g ON g.track_id = e.track_id WHERE e.event_type = 'play') GROUP BY 1, 2, 3)
SELECT user_id, window_end, string_agg(genre, '|' ORDER BY plays DESC, genre) AS top_genres FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, window_end ORDER BY plays DESC, genre) AS r FROM c) WHERE r <= 5 GROUP BY 1, 2""")(
    lambda t: ntz(X.rolling_top_genres(X.genre_counts(t.listens, t.catalog)))
    .withColumn("top_genres", F.array_join("top_genres", "|")))


@query("stream_rolling_top_genres", ("listen_events", "genre_of"), """
SELECT user_id, window_end, top_genres FROM (WITH c AS (SELECT user_id, w AS window_end, genre, count(*) AS plays FROM (
  SELECT e.user_id, g.genre, unnest(list_transform(range(0, 7), lambda i: date_trunc('day', e.event_ts) + to_days(CAST(i + 1 AS INTEGER)))) AS w
  FROM listen_events e JOIN genre_of g ON g.track_id = e.track_id WHERE e.event_type = 'play') GROUP BY 1, 2, 3)
SELECT user_id, window_end, string_agg(genre, '|' ORDER BY plays DESC, genre) AS top_genres FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, window_end ORDER BY plays DESC, genre) AS r FROM c) WHERE r <= 5 GROUP BY 1, 2)
WHERE window_end <= (SELECT max(e.event_ts) FROM listen_events e JOIN genre_of g ON g.track_id = e.track_id
                     WHERE e.event_type = 'play') - INTERVAL 1 DAY""")
def stream_genres(t):
    """The windows that the watermark has passed; later ones stay in state until more events arrive."""
    root = workspace(t.spark, "genres")
    lines = t.table("lineitem")
    stream = t.spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem.parquet").parquet(t.folder)
    events = t.view("listen_events", lineitem=stream).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    tops = X.stream_top_genres(events, t.catalog)
    T.append_stream(tops, f"{root}/out", f"{root}/offsets").awaitTermination()
    return ntz(t.spark.read.parquet(f"{root}/out")).withColumn("top_genres", F.array_join("top_genres", "|"))


query("user_features", ("listen_events", "genre_of"), SESSIONS.format(gap="30 MINUTES").replace("FROM events", "FROM ev").replace(
    "s AS (", "ev AS (SELECT user_id, event_ts AS ts FROM listen_events),\ns AS (", 1) + """,
g AS (SELECT user_id, avg(gap) AS gap FROM (SELECT user_id, epoch_us(lead(session_start) OVER (PARTITION BY user_id ORDER BY session_start)) / 1e6 - epoch_us(last_ts) / 1e6 AS gap FROM sess) GROUP BY user_id),
top AS (SELECT user_id, string_agg(genre, '|' ORDER BY plays DESC, genre) AS top_genres FROM (
  SELECT e.user_id, g.genre, count(*) AS plays, row_number() OVER (PARTITION BY e.user_id ORDER BY count(*) DESC, g.genre) AS r
  FROM listen_events e JOIN genre_of g ON g.track_id = e.track_id
  WHERE e.event_type = 'play' AND event_ts >= (SELECT max(event_ts) FROM listen_events) - INTERVAL 7 DAYS GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1)
SELECT l.user_id, l.last_event_ts, coalesce(top.top_genres, '') AS top_genres, round(CAST(CAST(g.gap AS FLOAT) AS DOUBLE), 0) AS avg_session_gap_sec
FROM (SELECT user_id, max(event_ts) AS last_event_ts FROM listen_events GROUP BY user_id) l LEFT JOIN top ON top.user_id = l.user_id LEFT JOIN g ON g.user_id = l.user_id""")(
    lambda t: X.user_features(t.listens, t.catalog).drop("updated_at").withColumn("top_genres", F.array_join("top_genres", "|"))
    .withColumn("avg_session_gap_sec", F.round(F.col("avg_session_gap_sec").cast("double"), 0)))


@query("stream_user_features", ("listen_events", "genre_of"), SESSIONS.format(gap="30 MINUTES").replace("FROM events", "FROM ev").replace(
    "s AS (", "ev AS (SELECT user_id, event_ts AS ts FROM listen_events),\ns AS (", 1) + """,
done AS (SELECT * FROM sess WHERE session_end <= (SELECT max(ts) FROM ev) - INTERVAL 1 DAY),
g AS (SELECT user_id, max(last_ts) AS last_event_ts, avg(gap) AS gap FROM (SELECT user_id, last_ts,
  epoch_us(lead(session_start) OVER (PARTITION BY user_id ORDER BY session_start)) / 1e6 - epoch_us(last_ts) / 1e6 AS gap FROM done) GROUP BY user_id),
plays AS (SELECT e.user_id, g.genre, e.event_ts FROM listen_events e JOIN genre_of g ON g.track_id = e.track_id WHERE e.event_type = 'play'),
c AS (SELECT user_id, w AS window_end, genre, count(*) AS plays FROM (
  SELECT user_id, genre, unnest(list_transform(range(0, 7), lambda i: date_trunc('day', event_ts) + to_days(CAST(i + 1 AS INTEGER)))) AS w
  FROM plays) GROUP BY 1, 2, 3),
closed AS (SELECT * FROM c WHERE window_end <= (SELECT max(event_ts) FROM plays) - INTERVAL 1 DAY),
top AS (SELECT user_id, string_agg(genre, '|' ORDER BY plays DESC, genre) AS top_genres FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, genre) AS r FROM closed
  WHERE window_end = (SELECT max(window_end) FROM closed)) WHERE r <= 5 GROUP BY 1)
SELECT g.user_id, g.last_event_ts, coalesce(top.top_genres, '') AS top_genres, round(CAST(CAST(g.gap AS FLOAT) AS DOUBLE), 0) AS avg_session_gap_sec
FROM g LEFT JOIN top ON top.user_id = g.user_id""")
def stream_features(t):
    """Features of the sessions and windows that the watermark has passed, kept by two streams in upsert tables."""
    root = workspace(t.spark, "features")
    lines = t.table("lineitem")
    stream = t.spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem.parquet").parquet(t.folder)
    events = t.view("listen_events", lineitem=stream).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    for running in X.stream_user_features(events, t.catalog, f"{root}/features", f"{root}/offsets"):
        running.awaitTermination()
    return ntz(X.read_user_features(t.spark, f"{root}/features")).withColumns({
        "top_genres": F.array_join("top_genres", "|"), "avg_session_gap_sec": F.round(F.col("avg_session_gap_sec").cast("double"), 0)})


@query("export_snapshots", EV + ("track_catalog",), """
SELECT 'catalog_genres' AS report, concat_ws('|', genre, tracks) AS line FROM (
  SELECT coalesce(nullif(genre,''), '__unknown__') AS genre, count(*) AS tracks FROM track_catalog GROUP BY 1 ORDER BY tracks DESC, genre LIMIT 100)
UNION ALL SELECT 'source_breakdown', concat_ws('|', source, count(*), count(DISTINCT user_id), count(DISTINCT track_id)) FROM listen_events GROUP BY source
UNION ALL SELECT 'top_users', concat_ws('|', user_id, n, k) FROM (
  SELECT user_id, count(*) AS n, count(DISTINCT track_id) AS k FROM listen_events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 100)
UNION ALL SELECT 'event_sample', CAST(event_id AS VARCHAR) FROM (SELECT event_id FROM listen_events ORDER BY event_ts DESC, event_id DESC LIMIT 1000)
UNION ALL SELECT 'summary', concat_ws('|', count(*), count(DISTINCT user_id), count(DISTINCT track_id), CASE WHEN count(*) >= 500000 THEN 'PASS' ELSE 'FAIL' END,
  CASE WHEN count(DISTINCT user_id) >= 1000 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN count(DISTINCT track_id) >= 50000 THEN 'PASS' ELSE 'FAIL' END) FROM listen_events""")
def export(t):
    """All five reports written and read again."""
    from earshot.operators.quality import snapshots
    root = workspace(t.spark, "export")
    K.export_snapshots(snapshots(t.listens, t.catalog), root)
    shown = {"catalog_genres": ("genre", "tracks"), "source_breakdown": ("source", "events", "users", "tracks"),
             "top_users": ("user_id", "plays", "distinct_tracks"), "event_sample": ("event_id",)}
    out = t.spark.read.text(f"{root}/summary").select(F.lit("summary").alias("report"), F.concat_ws("|", *[
        F.get_json_object("value", f"$.{p}") for p in ("metrics.total_events", "metrics.distinct_users", "metrics.distinct_tracks",
                                                       "target_status.events", "target_status.users", "target_status.tracks")]).alias("line"))
    for name, columns in shown.items():
        part = t.spark.read.csv(f"{root}/{name}", header=True)
        out = out.unionByName(part.select(F.lit(name).alias("report"), F.concat_ws("|", *columns).alias("line")))
    return out
