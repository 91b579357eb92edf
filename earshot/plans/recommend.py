"""Rule, popularity and hybrid recommendations and their parts."""

from pyspark.sql import functions as F

from earshot.operators import popularity as P
from earshot.operators import rules as R
from earshot.operators import slices as S
from earshot.plans import slices as base
from earshot.plans.registry import define, query
from earshot.session import materialize

FALLBACK = 200  # trending rows after the personalised ones, where a query states a number


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


for kind, src in (("raw", "listen_events"), ("ready", "ready")):
    recent = base.RECENT.format(t=src, d=30)
    key = "coalesce(track_id,'__unknown__')" if kind == "raw" else "track_id"
    names = ("coalesce(max(nullif(track_name,'')), max(track_id), '__unknown_track__') AS track_name, "
             "coalesce(max(nullif(artist_name,'')), '__unknown_artist__') AS artist_name")
    define(f"played_{kind}", (src,), f"SELECT DISTINCT user_id, {key} AS track_id FROM {src} WHERE {recent}")
    define(f"atp_{kind}", (src,), f"SELECT artist_id, track_id, {names}, count(*) AS pop FROM {src} "
           f"WHERE {recent} AND artist_id IS NOT NULL AND track_id IS NOT NULL GROUP BY {src}.artist_id, {src}.track_id")
    define(f"cands_{kind}", (f"top_artists_{kind}", f"atp_{kind}", f"played_{kind}"), f"""
SELECT u.user_id, a.track_id, a.track_name, a.artist_id, a.artist_name, u.rank_in_user AS r, a.pop,
       CAST(a.pop AS DOUBLE) * (CAST(1.0 AS DOUBLE) / u.rank_in_user) AS score
FROM top_artists_{kind} u JOIN atp_{kind} a ON u.artist_id = a.artist_id
LEFT JOIN played_{kind} p ON p.user_id = u.user_id AND p.track_id = a.track_id
WHERE u.rank_in_user <= 5 AND p.user_id IS NULL""")
    define(f"dedup_{kind}", (f"cands_{kind}",), f"""
SELECT user_id, track_id, max(track_name) AS track_name, max(artist_id) AS artist_id, max(artist_name) AS artist_name,
       min(r) AS artist_affinity_rank, max(pop) AS track_popularity_30d, max(score) AS recommendation_score
FROM cands_{kind} GROUP BY user_id, track_id""")
    define(f"pers_{kind}", (f"dedup_{kind}",), f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recommendation_score DESC, track_popularity_30d DESC, track_id)
  AS recommendation_rank FROM dedup_{kind}""")
    define(f"fall_{kind}", (f"played_{kind}", f"dedup_{kind}", f"trending_{kind}"), f"""
SELECT u.user_id, g.* FROM (SELECT DISTINCT user_id FROM played_{kind}) u CROSS JOIN trending_{kind} g
WHERE NOT EXISTS (SELECT 1 FROM played_{kind} p WHERE p.user_id = u.user_id AND p.track_id = g.track_id)
  AND NOT EXISTS (SELECT 1 FROM dedup_{kind} d WHERE d.user_id = u.user_id AND d.track_id = g.track_id)""")
    rule = f"""
SELECT user_id, recommendation_rank, track_id, track_name, artist_id, artist_name, artist_affinity_rank,
       track_popularity_30d, recommendation_score FROM pers_{kind}
UNION ALL
SELECT f.user_id, coalesce(c.n, 0) + row_number() OVER (PARTITION BY f.user_id ORDER BY f.global_rank_7d, f.track_id),
       f.track_id, f.track_name, f.artist_id, f.artist_name, NULL, f.plays_7d,
       CAST(f.plays_7d AS DOUBLE) * CAST(0.001 AS DOUBLE) + CAST(1.0 AS DOUBLE) / (f.global_rank_7d + 1000)
FROM fall_{kind} f LEFT JOIN (SELECT user_id, count(*) AS n FROM pers_{kind} GROUP BY user_id) c ON c.user_id = f.user_id"""
    define(f"rule_{kind}_all", (f"pers_{kind}", f"fall_{kind}"), rule)
    define(f"rule_{kind}", (f"pers_{kind}", f"fall_{kind}"), rule + f"""
QUALIFY row_number() OVER (PARTITION BY f.user_id ORDER BY f.global_rank_7d, f.track_id) <= {FALLBACK}""")

RULE = """SELECT * REPLACE (round(recommendation_score, 9) AS recommendation_score) FROM rule_{k} WHERE true"""

query("artist_candidate_join", ("top_artists_ready", "atp_ready"), """
SELECT u.user_id, u.artist_id, u.rank_in_user AS artist_affinity_rank, a.track_id, a.pop AS track_popularity_30d
FROM top_artists_ready u JOIN atp_ready a ON u.artist_id = a.artist_id WHERE u.rank_in_user <= 5""")(
    lambda t: R.artist_candidates(
        P.user_top_artists(t.ready, ready=True, max_rank=5).withColumnRenamed("rank_in_user", "artist_affinity_rank")
        .select("user_id", "artist_id", "artist_affinity_rank", "unique_tracks_30d"),
        P.artist_track_pop(t.ready, ready=True).filter("artist_id IS NOT NULL")
        .withColumnRenamed("plays_30d", "track_popularity_30d"))
    .select("user_id", "artist_id", "artist_affinity_rank", "track_id", "track_popularity_30d"))


def _played(t):
    return (S.within_days(t.ready, 30).select("user_id", "track_id").distinct())


query("unseen_anti_join", ("trending_ready", "played_ready"), """
SELECT user_id, p.track_id FROM played_ready p LEFT JOIN trending_ready g ON g.track_id = p.track_id WHERE g.track_id IS NULL""")(
    lambda t: _played(t).join(P.track_popularity(t.ready, ready=True), "track_id", "left_anti")
    .select("user_id", "track_id"))


@query("fallback_cross_join", ("played_ready", "trending_ready"), """
SELECT user_id, global_rank_7d, track_id FROM (
  SELECT u.user_id, g.global_rank_7d, g.track_id,
         row_number() OVER (PARTITION BY u.user_id ORDER BY g.global_rank_7d) AS rn
  FROM (SELECT DISTINCT user_id FROM played_ready) u CROSS JOIN trending_ready g
  WHERE NOT EXISTS (SELECT 1 FROM played_ready p WHERE p.user_id = u.user_id AND p.track_id = g.track_id))
WHERE rn <= 20""")
def fallback(t):
    played = _played(t)
    users = played.select("user_id").distinct().withColumn("personalized_count", F.lit(0).cast("long"))
    trending = P.global_trending(P.track_popularity(t.ready, ready=True))
    return R.fallback_candidates(users, materialize(trending), played, played.limit(0), 20).select(
        "user_id", "global_rank_7d", "track_id")


query("recs_rule_30d", ("rule_raw_all",), RULE.format(k="raw_all"))(
    lambda t: rounded(R.recs_rule(t.listens, ready=False, fallback_rows=None), "recommendation_score"))
query("recs_rule_30d_ready", ("rule_ready",), RULE.format(k="ready"))(
    lambda t: rounded(R.recs_rule(t.ready, fallback_rows=FALLBACK), "recommendation_score"))
query("recs_rule_dense", ("rule_raw", "listen_events"), "mu AS (" + base.USERS.format(t="listen_events")
      + " ORDER BY plays DESC, user_id LIMIT 1000) " + RULE.format(k="raw") + " AND user_id IN (SELECT user_id FROM mu)")(
    lambda t: rounded(R.recs_rule(t.listens, users=S.model_users_top(t.listens), ready=False, fallback_rows=FALLBACK),
                      "recommendation_score"))
query("recs_rule_dense_ready", ("rule_ready", "model_users"),
      RULE.format(k="ready") + " AND user_id IN (SELECT user_id FROM model_users)")(
    lambda t: rounded(R.recs_rule(t.ready, users=t.model_users, fallback_rows=FALLBACK), "recommendation_score"))
query("fallback_rank_offset", ("rule_ready_all",), """
SELECT user_id, recommendation_rank, track_id FROM rule_ready_all
WHERE artist_affinity_rank IS NULL""")(
    lambda t: R.recs_rule(t.ready, fallback_rows=None).filter("artist_affinity_rank IS NULL")
    .select("user_id", "recommendation_rank", "track_id"))
query("union_personalised_fallback", ("rule_ready",), """
SELECT user_id, count(*) AS rows, count(artist_affinity_rank) AS personalised, max(recommendation_rank) AS last_rank
FROM rule_ready GROUP BY user_id""")(
    lambda t: R.recs_rule(t.ready, fallback_rows=FALLBACK).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("artist_affinity_rank").alias("personalised"),
        F.max("recommendation_rank").alias("last_rank")))
