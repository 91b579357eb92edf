"""Profiles, target checks, text cleaning and metadata repair."""

from pyspark.sql import functions as F

from earshot.functions.events import flexible_event_ts
from earshot.functions.text import clean_display_columns, clean_text_columns
from earshot.operators import quality as Q
from earshot.operators import slices as S
from earshot.plans.registry import define, query

EV = ("listen_events",)
CLEAN = "replace(nullif(trim({c}), ''), 'NaÃ¯ve', 'Naïve')"

query("summary", EV, """
SELECT count(*) AS total_events, count(DISTINCT user_id) AS distinct_users, count(DISTINCT track_id) AS distinct_tracks,
 min(event_ts) AS min_event_ts, max(event_ts) AS max_event_ts FROM listen_events""")(lambda t: Q.summary(t.listens))
query("source_breakdown", EV, """
SELECT source, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT track_id) AS tracks,
 min(event_ts) AS min_event_ts, max(event_ts) AS max_event_ts FROM listen_events GROUP BY source""")(
    lambda t: Q.source_breakdown(t.listens))
query("top_users_profile", EV, """
SELECT user_id, count(*) AS plays, count(DISTINCT track_id) AS distinct_tracks, min(event_ts) AS first_seen_ts,
 max(event_ts) AS last_seen_ts FROM listen_events GROUP BY user_id ORDER BY plays DESC, user_id LIMIT 100""")(
    lambda t: Q.top_users_profile(t.listens))
query("genre_counts", ("track_catalog",), """
SELECT coalesce(nullif(genre,''), '__unknown__') AS genre, count(*) AS tracks FROM track_catalog GROUP BY 1 ORDER BY tracks DESC, genre LIMIT 100""")(
    lambda t: Q.genre_counts(t.catalog))
query("user_diversity", EV, """
SELECT user_id, count(*) AS rows, (SELECT count(*) FROM listen_events) AS total_rows,
 (SELECT count(DISTINCT user_id) FROM listen_events) AS unique_users FROM listen_events GROUP BY user_id ORDER BY rows DESC, user_id LIMIT 10""")(
    lambda t: Q.user_diversity(t.listens))
query("value_counts", EV, """
SELECT track_name AS value, count(*) AS n FROM listen_events WHERE coalesce(track_name,'') <> '' GROUP BY track_name""")(
    lambda t: Q.value_counts(t.listens, "track_name"))

define("slice_ready", ("ready", "model_users"), "SELECT * FROM ready WHERE user_id IN (SELECT user_id FROM model_users)")
define("checks", ("listen_events", "slice_ready"), """
SELECT scope, unnest([{'m': 'total_events', 'a': e, 't': 30000}, {'m': 'distinct_users', 'a': u, 't': 1000}, {'m': 'distinct_tracks', 'a': k, 't': 50000},
  {'m': 'overall', 'a': NULL, 't': NULL}]) AS r, e >= 30000 AND u >= 1000 AND k >= 50000 AS all_ok FROM (
 SELECT 'raw' AS scope, count(*) AS e, count(DISTINCT user_id) AS u, count(DISTINCT track_id) AS k FROM listen_events
 UNION ALL SELECT 'ready', count(*), count(DISTINCT user_id), count(DISTINCT track_id) FROM slice_ready)""")
query("target_checks", ("checks",), """
SELECT scope, r.m AS metric, r.a AS actual, r.t AS target,
 CASE WHEN CASE WHEN r.m = 'overall' THEN all_ok ELSE r.a >= r.t END THEN 'PASS' ELSE 'FAIL' END AS status FROM checks""")(
    lambda t: Q.target_checks(t.listens, S.slice_events_by_users(t.ready, t.model_users), events=30_000, scope="both"))

query("clean_text_columns", EV, f"""
SELECT event_id, {CLEAN.format(c='track_name')} AS track_name, {CLEAN.format(c='artist_name')} AS artist_name FROM listen_events""")(
    lambda t: clean_text_columns(t.listens, ["track_name", "artist_name"]).select("event_id", "track_name", "artist_name"))
query("clean_display_columns", ("track_catalog",), """
SELECT source, track_id, CASE WHEN track_name = '' THEN '' ELSE concat('You''re ', track_name, ' O''Neil') END AS track_name FROM track_catalog""")(
    lambda t: clean_display_columns(t.catalog.withColumn("track_name", F.when(F.col("track_name") == "", "").otherwise(
        F.concat(F.lit("You'Re "), "track_name", F.lit(" O'Neil")))), ["track_name"]).select("source", "track_id", "track_name"))
# Epoch values below 10^12 are read as seconds, so the times are moved past 2001 first.
query("flexible_event_ts", EV, """
SELECT event_id, event_ts + INTERVAL 4000 DAYS AS event_ts FROM listen_events""")(
    lambda t: t.listens.withColumn("event_ts", F.expr("event_ts + INTERVAL 4000 DAYS")).select("event_id", flexible_event_ts(
        F.when(F.col("source") == "src_a", F.unix_micros(F.col("event_ts").cast("timestamp")).cast("string"))
        .when(F.col("source") == "src_r", F.unix_millis(F.col("event_ts").cast("timestamp")).cast("string"))
        .otherwise(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).cast("timestamp_ntz").alias("event_ts")))

TARGETS = ("track_name", "artist_name")
query("repair_metadata", EV, """
SELECT event_id, replace(track_name, 'NaÃ¯ve', 'Naïve') AS track_name, artist_name FROM listen_events""")(
    lambda t: Q.repair_metadata(t.listens, list(TARGETS))[0].select("event_id", "track_name", "artist_name"))
query("repair_metadata_report", EV, " UNION ALL ".join(f"""
SELECT '{c}' AS target, count(DISTINCT {c}) AS distinct_values_scanned, count(DISTINCT CASE WHEN {c} LIKE 'NaÃ¯ve%' THEN {c} END) AS distinct_values_changed,
 count(CASE WHEN {c} LIKE 'NaÃ¯ve%' THEN 1 END) AS rows_changed FROM listen_events WHERE coalesce({c},'') <> ''""" for c in TARGETS).strip())(
    lambda t: Q.repair_metadata(t.listens, list(TARGETS), dry_run=True)[1].drop("examples"))

FIXED = "replace({c}, 'NaÃ¯ve', 'Naïve')"


def stored_tables(t):
    """The names of the four stored tables with the number of their rows, `n`; the hybrid one holds the newest model's rows.

    Names are repaired by value and results are counts, so each table is folded to its names once, and the stored
    recommendations, a product of customers and parts, by counting both sides before they are joined.
    """
    stored = {"listen_events": (t.listens, None), "track_catalog": (t.catalog, None), "recommendations_mf": (t.mf_names(), "n"),
              "recommendations_hybrid": (t.newest(t.mf_names()), "n")}
    return {name: Q.folded_names(df, Q.REPAIR_COLUMNS, rows) for name, (df, rows) in stored.items()}


STORED = {"listen_events": "listen_events", "track_catalog": "track_catalog", "recommendations_mf": "mf", "recommendations_hybrid": "mf_latest"}
query("repair_tables", ("listen_events", "track_catalog", "mf", "mf_latest"), " UNION ALL ".join(f"""
SELECT '{name}' AS stored, {FIXED.format(c='track_name')} AS track_name, {FIXED.format(c='artist_name')} AS artist_name, count(*) AS rows FROM {view} GROUP BY ALL"""
    for name, view in STORED.items()).strip())(lambda t: repaired_counts(t))


def repaired_counts(t):
    out = None
    for name, df in Q.repair_tables(stored_tables(t), rows="n")[0].items():
        part = df.groupBy(F.lit(name).alias("stored"), "track_name", "artist_name").agg(F.sum("n").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


query("repair_tables_report", ("listen_events", "track_catalog", "mf", "mf_latest"), " UNION ALL ".join(f"""
SELECT '{name}.{c}' AS target, count(DISTINCT {c}) AS distinct_values_scanned, count(DISTINCT CASE WHEN {c} LIKE 'NaÃ¯ve%' THEN {c} END) AS distinct_values_changed,
 count(CASE WHEN {c} LIKE 'NaÃ¯ve%' THEN 1 END) AS rows_changed FROM {view} WHERE coalesce({c},'') <> ''""" for name, view in STORED.items() for c in TARGETS).strip())(
    lambda t: Q.repair_tables(stored_tables(t), dry_run=True, rows="n")[1].drop("examples"))
