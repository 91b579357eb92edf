"""Training history, feedback, and the hybrid rerank."""

from pyspark.sql import functions as F

from earshot.operators import history as H
from earshot.operators import hybrid as Y
from earshot.operators.interactions import normalise_interactions
from earshot.plans.recommend import rounded
from earshot.plans.registry import define, query
from earshot.session import materialize

define("accepted", ("demo_interactions",), """
SELECT * FROM (SELECT interaction_id, user_id, nullif(trim(track_id),'') AS track_id,
  CASE action WHEN 'Played' THEN 'play' WHEN 'thumbs-up' THEN 'like' WHEN 'session start' THEN 'session_start' ELSE action END AS action,
  coalesce(signal_strength, CASE action WHEN 'impression' THEN 0.05 WHEN 'Played' THEN 1.0 WHEN 'thumbs-up' THEN 2.0
     WHEN 'skip' THEN 0.2 ELSE 1.0 END) AS signal_strength FROM demo_interactions)
WHERE (track_id IS NOT NULL OR action = 'session_start') AND signal_strength BETWEEN 0 AND 100""")
define("history", ("ready", "model_users"), """
SELECT user_id, track_id, max(track_name) AS track_name, max(artist_name) AS artist_name, count(*) AS plays
FROM ready WHERE user_id IN (SELECT user_id FROM model_users) GROUP BY user_id, track_id""")
define("feedback", ("accepted", "model_users", "track_catalog", "history"), """
SELECT f.user_id, f.track_id, coalesce(tc.track_name, h.track_name, f.track_id) AS track_name,
       coalesce(tc.artist_name, h.artist_name, '__unknown_artist__') AS artist_name, f.feedback_score
FROM (SELECT user_id, track_id, sum(CASE
        WHEN action IN ('play','like','favorite','add_to_playlist') THEN greatest(CAST(signal_strength AS DECIMAL(6,3)), 0.10)
        WHEN action = 'impression' THEN greatest(CAST(signal_strength AS DECIMAL(6,3)), 0.01)
        WHEN action IN ('skip','dislike') THEN -greatest(abs(CAST(signal_strength AS DECIMAL(6,3))), 0.10)
        ELSE CAST(0 AS DECIMAL(6,3)) END) AS feedback_score
      FROM accepted WHERE coalesce(track_id,'') <> '' AND user_id IN (SELECT user_id FROM model_users)
      GROUP BY user_id, track_id) f
LEFT JOIN (SELECT track_id, max(nullif(track_name,'')) AS track_name, max(nullif(artist_name,'')) AS artist_name
           FROM track_catalog GROUP BY track_catalog.track_id) tc ON tc.track_id = f.track_id
LEFT JOIN history h ON h.user_id = f.user_id AND h.track_id = f.track_id""")


def accepted(t):
    return normalise_interactions(t.interactions).filter("reject_reason IS NULL")


def feedback(t, fanout=False):
    return H.feedback_scores(accepted(t), t.model_users, t.catalog, t.ready, fanout)


def history(t):
    return H.user_track_history(t.ready, t.model_users)


def as_double(df, column):
    return df.withColumn(column, F.col(column).cast("double"))


query("user_track_history", ("history",), "SELECT * FROM history")(history)
query("feedback_scores", ("feedback",), "SELECT * REPLACE (CAST(feedback_score AS DOUBLE) AS feedback_score) FROM feedback")(
    lambda t: as_double(feedback(t), "feedback_score"))
query("feedback_scores_fanout", ("feedback", "history", "track_catalog"), """
SELECT f.user_id, f.track_id, CAST(f.feedback_score * coalesce(h.plays, 1) * coalesce(c.n, 1) AS DOUBLE) AS feedback_score
FROM feedback f LEFT JOIN history h ON h.user_id = f.user_id AND h.track_id = f.track_id
LEFT JOIN (SELECT track_id, count(*) AS n FROM track_catalog GROUP BY track_id) c ON c.track_id = f.track_id""")(
    lambda t: as_double(feedback(t, True), "feedback_score").select("user_id", "track_id", "feedback_score"))
query("track_name_enrichment", ("feedback",), "SELECT user_id, track_id, track_name, artist_name FROM feedback")(
    lambda t: feedback(t).drop("feedback_score"))
define("blended", ("history", "feedback"), """
SELECT user_id, track_id, track_name, artist_name, CAST(ceil(score) AS BIGINT) AS plays FROM (
 SELECT coalesce(h.user_id, f.user_id) AS user_id, coalesce(h.track_id, f.track_id) AS track_id,
   coalesce(nullif(h.track_name,''), nullif(f.track_name,''), h.track_id, f.track_id) AS track_name,
   coalesce(nullif(h.artist_name,''), nullif(f.artist_name,''), '__unknown_artist__') AS artist_name,
   greatest(CAST(0 AS DECIMAL(28,4)), coalesce(h.plays, 0) + CAST(4.0 AS DECIMAL(6,1)) * CAST(coalesce(f.feedback_score, 0) AS DECIMAL(18,3))) AS score
 FROM history h FULL OUTER JOIN feedback f ON f.user_id = h.user_id AND f.track_id = h.track_id) WHERE score >= 1""")
query("blended_history", ("blended",), "SELECT * FROM blended")(
    lambda t: H.blended_history(t.ready, t.model_users, feedback(t)))
query("history_feedback_full_outer", ("history", "feedback"), """
SELECT coalesce(h.user_id, f.user_id) AS user_id, coalesce(h.track_id, f.track_id) AS track_id, h.plays,
  CAST(f.feedback_score AS DOUBLE) AS feedback_score
FROM history h FULL OUTER JOIN feedback f ON f.user_id = h.user_id AND f.track_id = h.track_id""")(
    lambda t: as_double(history(t).select("user_id", "track_id", "plays").join(
        feedback(t).select("user_id", "track_id", "feedback_score"), ["user_id", "track_id"], "full_outer"),
        "feedback_score"))
query("interaction_weights", ("blended",), """
SELECT user_id, track_id, round(greatest(0.1, least(1.0, ln(1 + greatest(plays, 1)) / (SELECT max(ln(1 + greatest(plays, 1))) FROM blended))), 9) AS weight
FROM blended""")(
    lambda t: rounded(H.interaction_weights(H.blended_history(t.ready, t.model_users, feedback(t))), "weight"))

define("hist_clean", ("history",), "SELECT * REPLACE (replace(track_name, 'NaÃ¯ve', 'Naïve') AS track_name) FROM history")
query("user_artist_counts", ("hist_clean",), """
SELECT user_id, artist_name, CAST(sum(plays) AS BIGINT) AS plays FROM hist_clean GROUP BY user_id, artist_name""")(
    lambda t: H.user_artist_counts(H.cleaned_names(history(t))))
query("global_pop", ("history",), "SELECT track_id, CAST(sum(plays) AS BIGINT) AS plays FROM history GROUP BY track_id")(
    lambda t: H.global_pop(history(t)))
define("pool", ("history",), """
SELECT track_id, plays, row_number() OVER (ORDER BY plays DESC, track_id) AS pool_rank
FROM (SELECT track_id, CAST(sum(plays) AS BIGINT) AS plays FROM history GROUP BY track_id) QUALIFY pool_rank <= 10000""")
query("global_top_pop_pool", ("pool",), "SELECT * FROM pool")(lambda t: Y.top_pop_pool(H.global_pop(history(t)), 10_000))
query("per_user_minmax", ("mf_latest",), """
SELECT user_id, track_id, recommendation_score, min(recommendation_score) OVER (PARTITION BY user_id) AS mf_min,
  max(recommendation_score) OVER (PARTITION BY user_id) AS mf_max FROM mf_latest""")(
    lambda t: ranged(t).select("user_id", "track_id", "recommendation_score", "mf_min", "mf_max"))


def ranged(t):
    """The newest stored rows with their user's score range; a range comes with its customer, so no stored row is shuffled."""
    customers = t.mf_customers()
    ranges = materialize(Y.user_ranges(t.newest(t.mf_gathered(customers)), ["_cell"]))
    return t.newest(t.mf_gathered(customers, ranges))


def latest(t):
    return t.mf_latest


ALL = 1 << 40  # ranks no list reaches


def hybrid_views(tag, hist, mf, users, k, scan, pool, cap, weights, over_scan, tie_pop, meta_fallback):
    """Define the checking views of one hybrid variant by walking the whole pool per user."""
    wsum = sum(weights)
    w = [f"CAST({x / wsum!r} AS DOUBLE)" for x in weights]
    define(f"{tag}_meta", (hist,), f"""
SELECT track_id, first(track_name ORDER BY user_id) AS track_name, first(artist_name ORDER BY user_id) AS artist_name
FROM {hist} GROUP BY track_id""")
    define(f"{tag}_pop", (hist,), f"SELECT track_id, CAST(sum(plays) AS BIGINT) AS plays FROM {hist} GROUP BY track_id")
    define(f"{tag}_pool", (f"{tag}_pop", f"{tag}_meta"), f"""
SELECT p.*, m.track_name, m.artist_name, row_number() OVER (ORDER BY plays DESC, p.track_id) AS pool_rank
FROM {tag}_pop p JOIN {tag}_meta m ON m.track_id = p.track_id QUALIFY pool_rank <= {pool}""")
    define(f"{tag}_likes", (hist,), f"""
SELECT user_id, artist_name FROM (SELECT user_id, artist_name, row_number() OVER (PARTITION BY user_id ORDER BY sum(plays) DESC, artist_name) AS r
FROM {hist} GROUP BY user_id, artist_name) WHERE r <= 5""")
    define(f"{tag}_users", (users,), f"SELECT DISTINCT user_id FROM {users}")
    define(f"{tag}_range", (mf, f"{tag}_users"), f"""
SELECT user_id, min(recommendation_score) AS lo, max(recommendation_score) AS hi FROM {mf}
WHERE {f'recommendation_rank <= {scan}' if over_scan else 'true'} AND user_id IN (SELECT user_id FROM {tag}_users) GROUP BY user_id""")
    define(f"{tag}_mf", (mf, hist, f"{tag}_users"), f"""
SELECT m.user_id, m.track_id, m.track_name, m.artist_name, m.recommendation_score AS raw FROM {mf} m
WHERE recommendation_rank <= {scan} AND user_id IN (SELECT user_id FROM {tag}_users)
  AND NOT EXISTS (SELECT 1 FROM {hist} h WHERE h.user_id = m.user_id AND h.track_id = m.track_id)""")
    define(f"{tag}_walk", (f"{tag}_pool", f"{tag}_users", f"{tag}_mf", hist), f"""
SELECT u.user_id, p.track_id, p.track_name, p.artist_name,
  coalesce(c.n, 0) + row_number() OVER (PARTITION BY u.user_id ORDER BY p.pool_rank) - 1 AS reached
FROM {tag}_users u CROSS JOIN {tag}_pool p LEFT JOIN (SELECT user_id, count(*) AS n FROM {tag}_mf GROUP BY user_id) c ON c.user_id = u.user_id
WHERE NOT EXISTS (SELECT 1 FROM {hist} h WHERE h.user_id = u.user_id AND h.track_id = p.track_id)
  AND NOT EXISTS (SELECT 1 FROM {tag}_mf m WHERE m.user_id = u.user_id AND m.track_id = p.track_id)""")
    define(f"{tag}_cand", (f"{tag}_mf", f"{tag}_walk"), f"""
SELECT user_id, track_id, track_name, artist_name, raw FROM {tag}_mf
UNION ALL SELECT user_id, track_id, track_name, artist_name, NULL FROM {tag}_walk WHERE reached < {cap}""")
    define(f"{tag}_scored", (f"{tag}_cand", f"{tag}_range", f"{tag}_pop", f"{tag}_likes"), f"""
SELECT c.user_id, c.track_id, c.track_name, c.artist_name,
  (coalesce(c.raw, r.lo, 0.0) - coalesce(r.lo, 0.0)) / (CASE WHEN r.hi <> r.lo THEN r.hi - r.lo ELSE 1.0 END) AS mf_score,
  CAST(coalesce(p.plays, 0) AS DOUBLE) / (SELECT CAST(max(plays) AS DOUBLE) FROM {tag}_pop) AS pop_score,
  CAST(CASE WHEN l.user_id IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS artist_bonus
FROM {tag}_cand c LEFT JOIN {tag}_range r ON r.user_id = c.user_id LEFT JOIN {tag}_pop p ON p.track_id = c.track_id
LEFT JOIN {tag}_likes l ON l.user_id = c.user_id AND l.artist_name = c.artist_name""")
    define(f"{tag}_recs", (f"{tag}_scored",), f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recommendation_score DESC, {'pop_score DESC, ' if tie_pop else ''}track_id) AS recommendation_rank
FROM (SELECT *, ({w[0]} * mf_score) + ({w[1]} * pop_score) + ({w[2]} * artist_bonus) AS recommendation_score FROM {tag}_scored))
WHERE recommendation_rank <= {k}""")


hybrid_views("hy", "hist_clean", "mf_latest", "hist_clean", 100, ALL, ALL, ALL, (0.45, 0.45, 0.10), True, True, True)
ROUND4 = ("* REPLACE (round(recommendation_score, 9) AS recommendation_score, round(mf_score, 9) AS mf_score, "
          "round(pop_score, 9) AS pop_score, round(artist_bonus, 9) AS artist_bonus)")
SCORES = ("recommendation_score", "mf_score", "pop_score", "artist_bonus")


def hybrid(t, **changes):
    return Y.recs_hybrid(history(t), t.mf_of(t.model_users), Y.HybridSettings(**changes))


query("recs_hybrid", ("hy_recs",), f"SELECT {ROUND4} FROM hy_recs")(lambda t: rounded(hybrid(t), *SCORES))
hybrid_views("hs", "hist_clean", "mf_latest", "hist_clean", 10, 20, 300, 60, (0.45, 0.45, 0.10), True, True, True)
query("capped_candidate_pool", ("hs_recs",), f"SELECT {ROUND4} FROM hs_recs")(
    lambda t: rounded(hybrid(t, k=10, mf_scan=20, pool=300, cap=60), *SCORES))
