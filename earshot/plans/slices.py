"""Filters, slices, popularity and per-user tops."""

from pyspark.sql import functions as F

from earshot.operators import popularity as P
from earshot.operators import quality as Q
from earshot.operators import slices as S
from earshot.plans.registry import define, query

EV = ("listen_events",)
RD = ("ready",)

READABLE = """(trim(coalesce(track_name,'')) <> '' AND NOT regexp_full_match(trim(coalesce(track_name,'')), '[0-9]+')
   AND lower(trim(coalesce(artist_name,''))) NOT IN ('', '__unknown_artist__')
   AND (trim(coalesce(track_id,'')) = '' OR trim(track_name) <> trim(track_id)))"""

query("ready_events", RD, "SELECT * FROM ready")(lambda t: t.ready)

query("readable_flag", EV, f"SELECT event_id, {READABLE} AS readable FROM listen_events")(
    lambda t: S.readable_flag(t.listens).select("event_id", "readable"))

query("readable_only", EV, f"""
SELECT user_id, event_id, track_name, position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) AS position
  FROM listen_events WHERE {READABLE}) WHERE position <= 5""")(
    lambda t: S.readable_only(t.listens, 5, ["user_id"], [F.col("event_ts").desc(), F.col("event_id").desc()])
    .select("user_id", "event_id", "track_name", "position"))

query("anchor_within_days", EV, """
SELECT event_id, event_ts FROM listen_events
WHERE event_ts >= (SELECT max(event_ts) FROM listen_events) - INTERVAL 30 DAYS""")(
    lambda t: S.within_days(t.listens, 30).select("event_id", "event_ts"))

query("anchor_cross_join", EV, """
SELECT event_id FROM listen_events CROSS JOIN (SELECT max(event_ts) AS newest FROM listen_events) WHERE event_ts >= newest - INTERVAL 7 DAYS""")(
    lambda t: S.within_days(t.listens, 7).select("event_id"))

USERS = """SELECT user_id, count(*) AS plays FROM {t} WHERE event_type = 'play' GROUP BY user_id"""

query("model_users_gt20", EV, USERS.format(t="listen_events") + " HAVING count(*) > 20")(
    lambda t: S.model_users_gt20(t.listens))
query("model_users_top1000", EV, USERS.format(t="listen_events") + " ORDER BY plays DESC, user_id LIMIT 1000")(
    lambda t: S.model_users_top(t.listens))
query("model_users_top1000_ready", ("model_users",), "SELECT user_id, plays FROM model_users")(
    lambda t: t.model_users)
query("top_users", ("model_users",), "SELECT user_id, plays FROM model_users ORDER BY plays DESC, user_id LIMIT 20")(
    lambda t: S.top_users(t.model_users, 20))
query("slice_events_by_users", ("ready", "model_users"), """
SELECT event_id, user_id, track_id FROM ready WHERE user_id IN (SELECT user_id FROM model_users)""")(
    lambda t: S.slice_events_by_users(t.ready, t.model_users).select("event_id", "user_id", "track_id"))

METRICS = """SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT track_id) AS tracks,
 round(count(*) / nullif(count(DISTINCT user_id), 0), 2) AS events_per_user FROM {t} WHERE user_id IN (SELECT user_id FROM {u})"""
query("model_metrics_ready", ("ready", "model_users"), METRICS.format(t="ready", u="model_users"))(
    lambda t: Q.model_metrics(S.slice_events_by_users(t.ready, t.model_users)))
query("model_metrics", EV, "mu AS (" + USERS.format(t="listen_events") + " ORDER BY plays DESC, user_id LIMIT 1000) "
      + METRICS.format(t="listen_events", u="mu"))(
    lambda t: Q.model_metrics(S.slice_events_by_users(t.listens, S.model_users_top(t.listens))))

query("user_recent_activity_7d", EV, """
SELECT user_id, count(*) AS plays_7d, max(event_ts) AS last_play_ts FROM listen_events
WHERE event_ts >= (SELECT max(event_ts) FROM listen_events) - INTERVAL 7 DAYS GROUP BY user_id""")(
    lambda t: P.user_recent_activity(t.listens))

RECENT = "event_ts >= (SELECT max(event_ts) FROM {t}) - INTERVAL {d} DAYS AND event_type = 'play'"
NAMES = """coalesce(max(nullif(track_name,'')), max(track_id), '__unknown_track__') AS track_name, max(artist_id) AS artist_id,
 coalesce(max(nullif(artist_name,'')), '__unknown_artist__') AS artist_name"""

query("user_top_tracks_30d", EV, f"""
agg AS (SELECT user_id, coalesce(track_id,'__unknown__') AS k, max(track_id) AS track_id, {NAMES},
               count(*) AS plays_30d, max(event_ts) AS last_play_ts
        FROM listen_events WHERE {RECENT.format(t='listen_events', d=30)} GROUP BY 1, 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY plays_30d DESC, last_play_ts DESC, k) AS rank_in_user,
       track_id, track_name, artist_id, artist_name, plays_30d, last_play_ts FROM agg""")(
    lambda t: P.user_top_tracks(t.listens))

define("top_artists_raw", EV, f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plays_30d DESC, unique_tracks_30d DESC, last_play_ts DESC, k) AS rank_in_user
FROM (SELECT user_id, coalesce(artist_id,'__unknown__') AS k, max(artist_id) AS artist_id,
             coalesce(max(nullif(artist_name,'')), '__unknown_artist__') AS artist_name, count(*) AS plays_30d,
             count(DISTINCT coalesce(track_id, track_name, '__unknown_track__')) AS unique_tracks_30d,
             max(event_ts) AS last_play_ts
      FROM listen_events WHERE {RECENT.format(t='listen_events', d=30)} GROUP BY 1, 2)""")
define("top_artists_ready", RD, f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plays_30d DESC, unique_tracks_30d DESC, last_play_ts DESC, artist_id NULLS LAST) AS rank_in_user
FROM (SELECT user_id, artist_id, coalesce(max(nullif(artist_name,'')), '__unknown_artist__') AS artist_name,
             count(*) AS plays_30d, count(DISTINCT track_id) AS unique_tracks_30d, max(event_ts) AS last_play_ts
      FROM ready WHERE {RECENT.format(t='ready', d=30)} GROUP BY 1, 2)""")
ARTIST_COLS = "SELECT user_id, rank_in_user, artist_id, artist_name, plays_30d, unique_tracks_30d, last_play_ts FROM "
query("user_top_artists_30d", ("top_artists_raw",), ARTIST_COLS + "top_artists_raw")(
    lambda t: P.user_top_artists(t.listens))
query("user_top_artists_30d_ready", ("top_artists_ready",), ARTIST_COLS + "top_artists_ready")(
    lambda t: P.user_top_artists(t.ready, ready=True))

define("popularity_raw", EV, f"""
SELECT coalesce(track_id,'__unknown__') AS track_id_key, max(track_id) AS track_id, {NAMES}, count(*) AS plays_7d,
       count(DISTINCT user_id) AS unique_listeners_7d, max(event_ts) AS last_play_ts
FROM listen_events WHERE {RECENT.format(t='listen_events', d=7)} GROUP BY 1""")
define("popularity_ready", RD, f"""
SELECT track_id AS track_id_key, max(track_id) AS track_id, max(track_name) AS track_name, max(artist_id) AS artist_id,
       max(artist_name) AS artist_name, count(*) AS plays_7d, count(DISTINCT user_id) AS unique_listeners_7d,
       max(event_ts) AS last_play_ts
FROM ready WHERE {RECENT.format(t='ready', d=7)} GROUP BY track_id""".replace("GROUP BY track_id", "GROUP BY ready.track_id"))
for kind in ("raw", "ready"):
    define(f"trending_{kind}", (f"popularity_{kind}",), f"""
SELECT row_number() OVER (ORDER BY plays_7d DESC, unique_listeners_7d DESC, last_play_ts DESC, track_id_key) AS global_rank_7d,
       track_id, track_name, artist_id, artist_name, plays_7d, unique_listeners_7d, last_play_ts
FROM popularity_{kind} WHERE track_id IS NOT NULL""")
query("track_popularity_7d", ("popularity_raw",), "SELECT * FROM popularity_raw")(
    lambda t: P.track_popularity(t.listens))
query("track_popularity_7d_ready", ("popularity_ready",), "SELECT * FROM popularity_ready")(
    lambda t: P.track_popularity(t.ready, ready=True))
query("global_trending_7d", ("trending_raw",), "SELECT * FROM trending_raw")(
    lambda t: P.global_trending(P.track_popularity(t.listens)))
query("global_trending_7d_ready", ("trending_ready",), "SELECT * FROM trending_ready")(
    lambda t: P.global_trending(P.track_popularity(t.ready, ready=True)))
query("global_trending_7d_ready_top20", ("trending_ready",), "SELECT * FROM trending_ready WHERE global_rank_7d <= 20")(
    lambda t: P.global_trending(P.track_popularity(t.ready, ready=True), max_rank=20))

query("artist_track_pop_30d", EV, f"""
SELECT max(artist_id) AS artist_id, max(track_id) AS track_id,
  coalesce(max(nullif(track_name,'')), max(track_id), '__unknown_track__') AS track_name,
  coalesce(max(nullif(artist_name,'')), '__unknown_artist__') AS artist_name, count(*) AS plays_30d
FROM listen_events WHERE {RECENT.format(t='listen_events', d=30)}
GROUP BY coalesce(artist_id,'__unknown__'), coalesce(track_id,'__unknown__')""")(
    lambda t: P.artist_track_pop(t.listens))
query("artist_track_pop_30d_ready", RD, f"""
SELECT artist_id, track_id, max(track_name) AS track_name, max(artist_name) AS artist_name, count(*) AS plays_30d
FROM ready WHERE {RECENT.format(t='ready', d=30)} GROUP BY artist_id, track_id""")(
    lambda t: P.artist_track_pop(t.ready, ready=True))

define("named", RD, """
SELECT min(nullif(track_id,'')) AS track_id, min(nullif(artist_id,'')) AS artist_id, track_name, artist_name,
       count(*) AS plays, count(DISTINCT user_id) AS unique_listeners, max(event_ts) AS last_play_ts
FROM ready WHERE artist_name <> '__unknown_artist__' GROUP BY track_name, artist_name""")
define("named_ranked", ("named",), """
SELECT row_number() OVER (ORDER BY plays DESC, unique_listeners DESC, last_play_ts DESC, track_name, artist_name) AS global_rank_7d,
       coalesce(track_id, track_name) AS track_id, track_name, artist_id, artist_name, plays AS plays_7d,
       unique_listeners AS unique_listeners_7d FROM named""")
query("named_popularity", ("named",), "SELECT * FROM named")(lambda t: P.named_popularity(t.ready))
query("named_trending_rank", ("named_ranked",), "SELECT * FROM named_ranked")(
    lambda t: P.named_trending(P.named_popularity(t.ready), None))

define("track_totals", EV, """
SELECT user_id, coalesce(nullif(track_id,''), nullif(track_name,''), '__unknown_track__') AS track_id,
       coalesce(nullif(track_name,''), nullif(track_id,''), '__unknown_track__') AS track_name,
       min(nullif(artist_id,'')) AS artist_id, coalesce(max(nullif(artist_name,'')), '__unknown_artist__') AS artist_name,
       count(*) AS plays, max(event_ts) AS last_played_at
FROM listen_events GROUP BY 1, 2, 3""".replace("GROUP BY 1, 2, 3", """
GROUP BY user_id, coalesce(nullif(listen_events.track_id,''), nullif(listen_events.track_name,''), '__unknown_track__'),
         coalesce(nullif(listen_events.track_name,''), nullif(listen_events.track_id,''), '__unknown_track__')"""))
define("favorites", ("track_totals",), """
SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id
    ORDER BY plays DESC, last_played_at DESC, track_name, artist_name, track_id) AS favorite_rank,
    track_id, track_name, artist_id, artist_name, plays FROM track_totals)""")
query("user_favorites", ("track_totals",), "SELECT * FROM track_totals")(lambda t: P.user_track_totals(t.listens))
query("favorites_rank", ("favorites",), "SELECT * FROM favorites")(
    lambda t: P.user_favorites(t.listens))

query("event_dedup", EV, """
hashed AS (SELECT *, md5(concat(source, chr(31), user_id, chr(31), coalesce(track_id,''), chr(31), coalesce(artist_id,''), chr(31),
   strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', chr(31), event_type, chr(31), coalesce(track_name,''), chr(31),
   coalesce(artist_name,''))) AS event_hash FROM
   (SELECT * FROM listen_events UNION ALL SELECT * REPLACE (event_id || 'x' AS event_id) FROM listen_events))
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_hash ORDER BY event_id) AS rn FROM hashed) WHERE rn = 1""")(
    lambda t: S.event_dedup(t.listens.unionByName(
        t.listens.withColumn("event_id", F.concat("event_id", F.lit("x"))))))

query("latest_events_sample", EV, "SELECT * FROM listen_events ORDER BY event_ts DESC, event_id DESC LIMIT 1000")(
    lambda t: S.latest_events(t.listens))
query("top_n_by_rank", ("trending_ready",), """
SELECT global_rank_7d, track_id, track_name, artist_id, artist_name, plays_7d, unique_listeners_7d
FROM trending_ready WHERE global_rank_7d <= 20""")(
    lambda t: S.top_n_by_rank(P.global_trending(P.track_popularity(t.ready, ready=True), max_rank=20)
                              .drop("last_play_ts"), "global_rank_7d", 20))
query("distinct_pairs", EV, f"""
SELECT DISTINCT user_id, coalesce(track_id,'__unknown__') AS track_id_key FROM listen_events
WHERE {RECENT.format(t='listen_events', d=30)}""")(
    lambda t: S.within_days(t.listens, 30).filter("event_type = 'play'")
    .select("user_id", F.coalesce("track_id", F.lit("__unknown__")).alias("track_id_key")).distinct())
