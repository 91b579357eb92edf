"""Cascades, search, pages and user references."""

from pyspark.sql import functions as F

from earshot.functions.vibe_rules import VIBES
from earshot.operators import interactions as I
from earshot.operators import people as N
from earshot.operators import popularity as P
from earshot.operators import rules as R
from earshot.operators import serving as S
from earshot.plans.fixtures import FIRST_NAMES, LAST_NAMES
from earshot.plans.history import hybrid, latest
from earshot.plans.recommend import FALLBACK
from earshot.plans.registry import define, query
from earshot.plans.slices import READABLE, USERS
from earshot.plans.vibes import named, vibe_items
from earshot.session import materialize

query("latest_version_join", ("mf_latest",), """
SELECT model_version, user_id, recommendation_rank, track_id, recommendation_score FROM mf_latest""")(
    lambda t: t.mf_latest.select("model_version", "user_id", "recommendation_rank", "track_id", "recommendation_score"))


def trending(t, n=None):
    return P.global_trending(P.track_popularity(t.ready, ready=True), max_rank=n)


def dense(t):
    return R.recs_rule(t.ready, users=t.model_users, fallback_rows=FALLBACK)


define("dense", ("rule_ready", "model_users"),
       "SELECT * FROM rule_ready WHERE user_id IN (SELECT user_id FROM model_users)")
query("recsource_counts", ("hy_recs", "mf_latest", "dense", "trending_ready"), """
SELECT 'hybrid' AS source, count(*) > 0 AS available, count(*) AS rows, count(DISTINCT user_id) AS users, 'hy_1' AS model_version,
  TIMESTAMP '2024-03-01 00:00:00' AS generated_at FROM hy_recs
UNION ALL SELECT 'mf', count(*) > 0, count(*), count(DISTINCT user_id), max(model_version), max(generated_at) FROM mf_latest
UNION ALL SELECT 'dense', count(*) > 0, count(*), count(DISTINCT user_id), NULL, NULL FROM dense
UNION ALL SELECT 'trending', count(*) > 0, count(*), NULL, NULL, NULL FROM trending_ready""")(
    lambda t: S.recsource_counts(
        hybrid(t).select(F.lit("hy_1").alias("model_version"), F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'").alias("generated_at"), "user_id"),
        t.mf_newest(), dense(t), P.track_popularity(t.ready, ready=True)))

TREND = "global_rank_7d, track_id, track_name, artist_id, artist_name, plays_7d, unique_listeners_7d"
query("trending_cascade", ("trending_ready", "named_ranked"), f"""
ok AS (SELECT {TREND}, row_number() OVER (ORDER BY global_rank_7d) AS position FROM trending_ready WHERE {READABLE})
SELECT *, 'trending_7d' AS mode FROM ok WHERE position <= 20
UNION ALL SELECT {TREND}, global_rank_7d, 'trending_7d_named_fallback' FROM named_ranked WHERE global_rank_7d <= 20 AND (SELECT count(*) FROM ok) = 0""")(
    lambda t: S.trending_items(trending(t), P.named_trending(named(t), 20)))

define("listeners", ("listen_events",), "SELECT DISTINCT user_id FROM listen_events")
define("shared", ("trending_ready",), f"""
SELECT 'fallback_trending' AS mode, row_number() OVER (ORDER BY global_rank_7d) AS position, track_id, track_name, artist_name
FROM trending_ready WHERE {READABLE}""")


def cascade_sql(tag, *sources):
    parts = " UNION ALL ".join(
        f"SELECT user_id, {i} AS pr, '{mode}' AS mode, recommendation_rank, track_id, track_name, artist_name, recommendation_score "
        f"FROM {view} WHERE user_id IN (SELECT user_id FROM listeners)" for i, (view, mode) in enumerate(sources))
    define(f"{tag}_served", (*[v for v, _ in sources], "listeners"), f"""
SELECT user_id, mode, position, recommendation_rank, track_id, track_name, artist_name, recommendation_score FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recommendation_rank) AS position FROM (
  SELECT *, min(pr) OVER (PARTITION BY user_id) AS first_pr FROM ({parts})) WHERE pr = first_pr AND {READABLE}) WHERE position <= 20""")
    define(f"{tag}_all", (f"{tag}_served", "listeners", "shared"), f"""
SELECT * FROM {tag}_served UNION ALL
SELECT u.user_id, s.mode, s.position, NULL, s.track_id, s.track_name, s.artist_name, NULL FROM listeners u CROSS JOIN shared s
WHERE s.position <= 20 AND u.user_id NOT IN (SELECT user_id FROM {tag}_served)""")


cascade_sql("ca", ("hy_recs", "personalized_hybrid_ready"), ("mf_latest", "personalized_mf_ready"))
cascade_sql("cd", ("dense", "personalized_dense_1000"))
ROUND = "* REPLACE (round(recommendation_score, 9) AS recommendation_score)"


def listeners(t):
    return t.listens.select("user_id").distinct()


SERVED = 20  # items of a served list


def recs(t, fallback=True, mf_first=True):
    """The sources that are used only, as ranking one takes a pass over its rows; of the stored rows those that may be served."""
    users = materialize(listeners(t))
    sources = (hybrid(t), t.mf_first(users, SERVED), None) if mf_first else (None, None, dense(t))
    lists = (trending(t), P.named_trending(named(t), 20)) if fallback else (None, None)
    return S.recs_cascade(users, *sources, *lists, limit=SERVED, fallback=fallback,
                          use_hybrid=mf_first, use_mf=mf_first, use_dense=not mf_first)


def scores9(df):
    return df.withColumn("recommendation_score", F.round("recommendation_score", 9))


query("recs_cascade", ("ca_all",), f"SELECT {ROUND} FROM ca_all")(lambda t: scores9(recs(t.with_stored_events())))
query("recs_cascade_dense", ("cd_all",), f"SELECT {ROUND} FROM cd_all")(lambda t: scores9(recs(t, mf_first=False)))

define("fav_served", ("favorites",), f"""
SELECT user_id, 'user_favorites' AS mode, position, track_id, track_name, artist_name FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY favorite_rank) AS position FROM favorites
 WHERE {READABLE}) WHERE position <= 20""")
query("user_favorites_topn", ("fav_served",), "SELECT * FROM fav_served")(
    lambda t: S.favorites_cascade(listeners(t), P.user_favorites(t.listens), None, fallback_to_recs=False))
query("favorites_cascade", ("fav_served", "cd_all"), """
SELECT * FROM fav_served UNION ALL
SELECT user_id, CASE WHEN mode LIKE 'personalized%' THEN 'favorites_fallback_personalized'
  WHEN mode LIKE 'fallback%' THEN 'favorites_fallback_trending' ELSE mode END, position, track_id, track_name, artist_name
FROM cd_all WHERE user_id NOT IN (SELECT user_id FROM fav_served)""")(
    lambda t: S.favorites_cascade(listeners(t), P.user_favorites(t.listens), recs(t, mf_first=False)))

KEY = "coalesce(nullif(lower(trim(track_id)),''), concat(lower(trim(track_name)), '::', lower(trim(artist_name))))"
define("pv", ("ca_served", "vitems"), f"""
SELECT a.*, v.vibe FROM (SELECT *, {KEY} AS k FROM ca_served) a JOIN (SELECT DISTINCT vibe, {KEY} AS k FROM vitems) v ON v.k = a.k
WHERE v.vibe IN ({', '.join(repr(v) for v in VIBES)})""")


def mood_items(t):
    return vibe_items(t, 100, list(VIBES))


def served_and_moods(t):
    """Served lists and mood items, both from events that are joined once."""
    kept = t.with_stored_events()
    return recs(kept, fallback=False), mood_items(kept)


def in_mood(served, items, vibe):
    return S.restrict_to(served, items.filter(F.col("vibe") == vibe))


query("personalised_vibe", ("pv",), "SELECT user_id, mode, position, track_id, vibe FROM pv")(
    lambda t: S.personalised_vibe(*served_and_moods(t)).select("user_id", "mode", "position", "track_id", "vibe"))
query("recs_in_vibe_semi", ("pv",), "SELECT DISTINCT user_id, track_id FROM pv WHERE vibe = 'party'")(
    lambda t: in_mood(*served_and_moods(t), "party").select("user_id", "track_id").distinct())
query("vibe_coverage", ("ca_served", "pv"), "SELECT u.user_id, " + ", ".join(
    f"count(DISTINCT CASE WHEN vibe = '{v}' THEN track_id END) AS {v}" for v in VIBES)
    + " FROM (SELECT DISTINCT user_id FROM ca_served) u LEFT JOIN pv ON pv.user_id = u.user_id GROUP BY u.user_id")(
    lambda t: S.vibe_coverage(*served_and_moods(t)))

query("page_excluding_seen", ("trending_ready", "named_ranked"), f"""
SELECT track_id, page_position FROM (SELECT track_id, row_number() OVER (ORDER BY global_rank_7d) AS page_position FROM named_ranked
 WHERE {KEY} NOT IN (SELECT {KEY} FROM trending_ready WHERE global_rank_7d <= 50)) WHERE page_position <= 5""")(
    lambda t: S.next_page(P.named_trending(named(t), None), trending(t, 50), 5, [], [F.col("global_rank_7d").asc()])
    .select("track_id", "page_position"))

SEARCH = ["ring", "small ring", "NAÏVE", "large%box", "customer", "r_ng"]
define("sq", (), "SELECT * FROM (VALUES " + ", ".join(f"('{q.lower()}')" for q in SEARCH) + ") AS s(query)")
define("found", ("ready", "track_catalog", "sq"), """
SELECT sq.query, c.* FROM (
 SELECT track_id, track_name, coalesce(max(nullif(artist_name,'')), '__unknown_artist__') AS artist_name, NULL AS genre,
   count(*) AS popularity_30d, track_name AS raw FROM ready GROUP BY track_id, track_name
 UNION ALL SELECT track_id, coalesce(nullif(track_name,''), track_id), coalesce(nullif(artist_name,''), '__unknown_artist__'), genre, 0, track_name
   FROM track_catalog WHERE track_name IS NOT NULL) c JOIN sq ON lower(c.raw) LIKE concat('%', sq.query, '%')""")
define("deduped", ("found",), """
SELECT query, track_id, track_name, artist_name, genre, popularity_30d FROM found
QUALIFY row_number() OVER (PARTITION BY query, lower(track_name), lower(artist_name) ORDER BY popularity_30d DESC, track_id, coalesce(genre,''), track_name) = 1""")
define("search", ("deduped",), f"""
SELECT query, row_number() OVER (PARTITION BY query ORDER BY scan) AS position, track_id, track_name, artist_name, genre, popularity_30d, match_score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY match_score DESC, popularity_30d DESC, track_name, artist_name, track_id) AS scan
 FROM (SELECT *, CASE WHEN lower(track_name) = query THEN 300 WHEN lower(track_name) LIKE concat(query, '%') THEN 200
   WHEN lower(track_name) LIKE concat('%', query, '%') THEN 100 ELSE 0 END AS match_score FROM deduped)) WHERE {READABLE}""")


def requests(t):
    return t.spark.createDataFrame([(q,) for q in SEARCH], "query string")


query("union_search_sources", ("found",), "SELECT query, track_id, track_name, artist_name, genre, popularity_30d FROM found")(
    lambda t: S.search_sources(requests(t), t.ready, t.catalog))
query("search_dedup", ("deduped",), "SELECT * FROM deduped")(
    lambda t: S.search_dedup(S.search_sources(requests(t), t.ready, t.catalog)))
query("search_tracks", ("search",), "SELECT * FROM search WHERE position <= 10")(
    lambda t: S.search_tracks(requests(t), t.ready, t.catalog))
# A request table that grows with the data: the last eight characters of every catalog name, typed in capitals.
query("search_request_table", ("ready", "track_catalog"), """
rq AS (SELECT DISTINCT trim(lower(right(track_name, 8))) AS query FROM track_catalog WHERE track_name IS NOT NULL),
names AS (SELECT lower(track_name) AS name FROM ready UNION SELECT lower(track_name) FROM track_catalog WHERE track_name IS NOT NULL)
SELECT query, count(*) AS names FROM rq JOIN names ON contains(name, query) GROUP BY query""")(
    lambda t: S.matching_names(t.catalog.select(F.upper(F.expr("right(track_name, 8)")).alias("query")),
                               t.ready.select(F.lower("track_name").alias("name")).union(t.catalog.select(F.lower("track_name")))
                               .filter("name IS NOT NULL").distinct())
    .groupBy("query").agg(F.count(F.lit(1)).alias("names")))

query("normalise_interactions", ("demo_interactions",), """
SELECT interaction_id, user_id, track_id, action, signal_strength, source_endpoint, CASE
  WHEN track_id IS NULL AND action <> 'session_start' THEN 'track_required'
  WHEN given IS NOT NULL AND NOT given BETWEEN 0 AND 100 THEN 'strength_out_of_range' END AS reject_reason FROM (
 SELECT interaction_id, trim(user_id) AS user_id, nullif(trim(track_id),'') AS track_id, signal_strength AS given,
  CASE action WHEN 'Played' THEN 'play' WHEN 'thumbs-up' THEN 'like' WHEN 'session start' THEN 'session_start' ELSE action END AS action,
  coalesce(signal_strength, CASE action WHEN 'impression' THEN 0.05 WHEN 'Played' THEN 1.0 WHEN 'thumbs-up' THEN 2.0 WHEN 'skip' THEN 0.2 ELSE 1.0 END) AS signal_strength,
  '/feedback/interaction' AS source_endpoint FROM demo_interactions)""")(
    lambda t: I.normalise_interactions(t.interactions).select(
        "interaction_id", "user_id", "track_id", "action", "signal_strength", "source_endpoint", "reject_reason"))
query("impressions_from_items", ("mf_latest",), """
SELECT user_id, track_id, 'impression' AS action, '/recs' AS source_endpoint, 'personalized_mf_ready' AS model_mode,
  recommendation_rank, 's1' AS session_id, 0.05::DOUBLE AS signal_strength,
  json_object('track_name', trim(track_name), 'artist_name', trim(artist_name), 'source', 'api_auto_impression')::VARCHAR AS metadata
FROM mf_latest WHERE coalesce(track_id,'') <> ''""")(
    lambda t: I.impressions_from_items(latest(t), "/recs", "personalized_mf_ready", session_id="s1")
    .drop("model_version", "context_vibe"))

query("profile_left_join", ("model_users", "user_profiles"), """
SELECT m.user_id, m.plays, coalesce(p.display_name, m.user_id) AS display_name FROM model_users m LEFT JOIN user_profiles p ON p.user_id = m.user_id""")(
    lambda t: N.named_users(t.model_users, t.profiles))
query("list_profiles", ("user_profiles",), "SELECT display_name, user_id FROM user_profiles ORDER BY display_name, user_id LIMIT 100")(
    lambda t: N.list_profiles(t.profiles))

# The hash value modulo the name count is taken four hex digits at a time, which stays in range.
HEX4 = "CAST(concat('0x', substr(sha256(user_id), {i}, 4)) AS BIGINT)"
SLOT = f"""((({HEX4.format(i=1)} * 65536 + {HEX4.format(i=5)}) * 65536 + {HEX4.format(i=9)}) % 8100)"""
FIRST, LAST = (", ".join(f"'{n}'" for n in names) for names in (FIRST_NAMES, LAST_NAMES))
define("shown", ("ready",), f"""
WITH everyone AS ({USERS.format(t="ready")}),
turns AS (SELECT user_id, slot, row_number() OVER (PARTITION BY slot ORDER BY plays DESC, user_id) AS turn
          FROM (SELECT *, {SLOT} AS slot FROM everyone))
SELECT user_id, concat([{FIRST}][slot % 90 + 1], ' ', [{LAST}][slot // 90 + 1],
                       CASE WHEN turn > 1 THEN concat(' ', turn) ELSE '' END) AS display_name FROM turns""")


def shown(t):
    plays = t.ready.groupBy("user_id").agg(F.count(F.lit(1)).alias("plays"))
    return N.display_names(plays, FIRST_NAMES, LAST_NAMES)


query("display_names", ("shown",), "SELECT * FROM shown")(shown)

# References people might type: ids, names in capitals, parts of names, and two kinds of typing slips.
REFS = """SELECT CASE CAST(user_id AS BIGINT) % 6 WHEN 0 THEN user_id WHEN 1 THEN upper(display_name)
  WHEN 2 THEN concat(' ', substring(display_name, 3, 8)) WHEN 3 THEN concat(substring(display_name, 1, 3), substring(display_name, 5, 40))
  WHEN 4 THEN concat('nobody ', user_id) ELSE concat(substring(display_name, 1, 5), 'x', substring(display_name, 6, 40)) END AS ref
FROM {shown}"""
define("refs", ("shown",), REFS.replace("{shown}", "shown"))
define("asked", ("refs",), "SELECT DISTINCT ref, trim(ref) AS key FROM refs")
NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
query("resolve_users", ("asked", "shown", "model_users"), f"""
byid AS (SELECT a.ref, a.key AS user_id, p.display_name, 'user_id' AS method, NULL::DOUBLE AS score FROM asked a
  JOIN model_users m ON m.user_id = a.key LEFT JOIN shown p ON p.user_id = a.key),
byname AS (SELECT a.ref, min(p.user_id) AS user_id, min(p.display_name) AS display_name, 'display_name' AS method, NULL::DOUBLE AS score
  FROM asked a JOIN shown p ON lower(p.display_name) = lower(a.key) WHERE a.ref NOT IN (SELECT ref FROM byid) GROUP BY a.ref),
open2 AS (SELECT * FROM asked WHERE ref NOT IN (SELECT ref FROM byid) AND ref NOT IN (SELECT ref FROM byname)
  AND length(key) >= 3 AND regexp_matches(key, '[A-Za-z]')),
bypart AS (SELECT o.ref, min(p.user_id) AS user_id, min(p.display_name) AS display_name, 'partial' AS method, NULL::DOUBLE AS score
  FROM open2 o JOIN shown p ON contains(lower(p.display_name), lower(o.key)) GROUP BY o.ref HAVING count(*) = 1),
open3 AS (SELECT ref, {NORM.format(c='key')} AS q FROM open2 WHERE length(key) >= 4 AND ref NOT IN (SELECT ref FROM bypart)),
cands AS (SELECT p.user_id, p.display_name, {NORM.format(c='p.display_name')} AS n FROM shown p JOIN model_users m ON m.user_id = p.user_id),
scored AS (SELECT o.ref, c.user_id, c.display_name, list_max(list_transform(list_append(string_split(n, ' '), n),
    lambda t: 1 - levenshtein(q, t) / greatest(length(q), length(t), 1)))
  + CASE WHEN list_has_any(string_split(q, ' '), string_split(n, ' ')) THEN 0.03::DOUBLE ELSE 0::DOUBLE END AS score FROM open3 o CROSS JOIN cands c),
rk AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, display_name, user_id) AS rn,
  lead(score, 1, 0) OVER (PARTITION BY ref ORDER BY score DESC, display_name, user_id) AS second FROM scored),
byspell AS (SELECT ref, user_id, display_name, 'fuzzy' AS method, round(score, 9) AS score FROM rk
  WHERE rn = 1 AND score >= 0.84 AND (score - second >= 0.05 OR score >= 0.92)),
hit AS (SELECT * FROM byid UNION ALL SELECT * FROM byname UNION ALL SELECT * FROM bypart UNION ALL SELECT * FROM byspell)
SELECT * FROM hit UNION ALL SELECT ref, key, NULL, 'unresolved', NULL FROM asked WHERE ref NOT IN (SELECT ref FROM hit)""")(
    lambda t: resolved(t).withColumn("score", F.round("score", 9)))


def resolved(t):
    names = materialize(shown(t))
    return N.resolve_users(t.spark.sql(REFS, shown=names), names, t.model_users)
