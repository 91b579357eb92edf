"""Mood labels, votes, overrides and mood retrieval."""

from pyspark.sql import functions as F

from earshot.functions.vibe_rules import VIBE_RULES, VIBES, vibe_keywords, vibe_labels
from earshot.operators import popularity as P
from earshot.operators import vibes as V
from earshot.plans.registry import define, query
from earshot.plans.slices import READABLE, RECENT

REQUESTS = [*VIBES, "Study time", "happy hour", "vintage", "spoken word"]
VOTE_ORDER = ("voted_at", "vote_seq", "vote_line")


def quoted(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


define("requests", (), "SELECT * FROM (VALUES " + ", ".join(
    f"('{v}', {quoted(vibe_labels(v))}, {quoted(vibe_keywords(v))})" for v in REQUESTS) + ") AS r(vibe, labels, keywords)")
define("rules", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{v}', {quoted(w)})" for i, (v, w) in enumerate(VIBE_RULES.items())) + ") AS r(place, vibe, keywords)")

define("cat_names", ("track_catalog",), """
SELECT track_id, max(nullif(track_name,'')) AS track_name, max(nullif(artist_name,'')) AS artist_name,
  max(nullif(genre,'')) AS genre FROM track_catalog GROUP BY track_catalog.track_id""")
define("vcands", ("cat_names", "listen_events"), f"""
SELECT track_id, coalesce(c.track_name, e.track_name) AS track_name, coalesce(c.artist_name, e.artist_name) AS artist_name, genre,
  coalesce(p.plays_30d, 0) AS plays_30d, coalesce(p.unique_listeners_30d, 0) AS unique_listeners_30d
FROM cat_names c FULL OUTER JOIN (
  SELECT track_id, max(nullif(track_name,'')) AS track_name, max(nullif(artist_name,'')) AS artist_name
  FROM listen_events WHERE track_id IS NOT NULL GROUP BY listen_events.track_id) e USING (track_id)
FULL OUTER JOIN (SELECT track_id, count(*) AS plays_30d, count(DISTINCT user_id) AS unique_listeners_30d
  FROM listen_events WHERE {RECENT.format(t='listen_events', d=30)} AND track_id IS NOT NULL GROUP BY track_id) p USING (track_id)""")
query("three_way_full_outer", ("vcands",), "SELECT * FROM vcands")(lambda t: V.vibe_candidates(t.catalog, t.listens))
query("vibe_candidates", ("vcands",), "SELECT genre, count(*) AS tracks, CAST(sum(plays_30d) AS BIGINT) AS plays FROM vcands GROUP BY genre")(
    lambda t: V.vibe_candidates(t.catalog, t.listens).groupBy("genre").agg(
        F.count(F.lit(1)).alias("tracks"), F.sum("plays_30d").alias("plays")))


def best_of(text):
    return f"""SELECT max_by(struct_pack(v := vibe, k := hit), len(hit) * 100 - place) FROM
      (SELECT place, vibe, list_filter(keywords, lambda w: contains(lower({text}), w)) AS hit FROM rules) WHERE len(hit) > 0"""


define("vfeat_all", ("vcands", "rules"), f"""
SELECT track_id, genre, plays_30d, unique_listeners_30d, best.v AS vibe_label, best.k AS kw,
 CASE WHEN g IS NOT NULL THEN 'genre_rule' WHEN best IS NOT NULL THEN 'text_rule' ELSE 'no_genre_match' END AS label_source
FROM (SELECT *, coalesce(g, x) AS best FROM (
  SELECT c.*, ({best_of("coalesce(c.genre,'')")}) AS g,
   ({best_of("concat(coalesce(c.track_name,''), ' ', coalesce(c.artist_name,''))")}) AS x FROM vcands c))""")
define("vfeat", ("vfeat_all",), """
SELECT track_id, coalesce(vibe_label, 'unknown') AS vibe_label, round(CASE WHEN vibe_label IS NULL THEN 0.15::DOUBLE ELSE least(0.95::DOUBLE,
  CASE label_source WHEN 'genre_rule' THEN 0.45::DOUBLE ELSE 0.32::DOUBLE END + least(len(kw) * 0.12::DOUBLE, 0.30::DOUBLE)
  + CASE WHEN plays_30d >= 50 THEN 0.08::DOUBLE WHEN plays_30d >= 10 THEN 0.04::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN unique_listeners_30d >= 20 THEN 0.08::DOUBLE WHEN unique_listeners_30d >= 5 THEN 0.04::DOUBLE ELSE 0::DOUBLE END) END, 3) AS confidence,
 label_source, coalesce(array_to_string(kw, '|'), '') AS rule_keywords, genre, plays_30d, unique_listeners_30d FROM vfeat_all""")


def features(t, unknown=False):
    return V.vibe_features(V.vibe_candidates(t.catalog, t.listens), unknown)


def flat(df):
    """Array and decimal columns as text and double, for comparison."""
    out = df
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            out = out.withColumn(name, F.coalesce(F.array_join(name, "|"), F.lit("")))
        elif kind.startswith("decimal"):
            out = out.withColumn(name, F.col(name).cast("double"))
    return out


query("vibe_features", ("vfeat",), "SELECT * FROM vfeat WHERE vibe_label <> 'unknown'")(lambda t: flat(features(t)))
query("vibe_features_unknown", ("vfeat",), "SELECT * FROM vfeat")(lambda t: flat(features(t, True)))

define("vote_state", ("vibe_votes",), """
SELECT user_id, track_id, predicted_vibe, user_selected_vibe, feedback_count, first_seen_at, updated_at FROM (
 SELECT *, count(*) OVER w AS feedback_count, min(voted_at) OVER w AS first_seen_at, max(voted_at) OVER w AS updated_at,
  row_number() OVER (PARTITION BY user_id, track_id ORDER BY voted_at DESC, vote_seq DESC, vote_line DESC) AS rn
 FROM vibe_votes WINDOW w AS (PARTITION BY user_id, track_id)) WHERE rn = 1""")
define("vcounts", ("vote_state",), """
SELECT track_id, user_selected_vibe AS vibe_label, count(DISTINCT user_id) AS unique_users FROM vote_state GROUP BY 1, 2""")
define("consensus", ("vcounts",), """
SELECT a.track_id, a.vibe_label, a.unique_users AS top_unique_users, a.total AS total_unique_users,
  a.unique_users / a.total AS top_share, (a.unique_users - coalesce(b.unique_users, 0)) / a.total AS margin
FROM (SELECT *, row_number() OVER w AS rn, CAST(sum(unique_users) OVER (PARTITION BY track_id) AS BIGINT) AS total FROM vcounts
      WINDOW w AS (PARTITION BY track_id ORDER BY unique_users DESC, vibe_label)) a
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY unique_users DESC, vibe_label) AS rn FROM vcounts) b
  ON b.track_id = a.track_id AND b.rn = 2 WHERE a.rn = 1""")
define("overrides", ("consensus",), """
SELECT track_id, vibe_label, round(least(0.98::DOUBLE, greatest(0.70::DOUBLE, top_share + 0.10::DOUBLE)), 3) AS confidence,
 total_unique_users AS unique_users, round(top_share, 4) AS top_share, round(margin, 4) AS margin, 15 AS threshold_users
FROM consensus WHERE total_unique_users >= 15 AND top_share >= 0.70 AND margin >= 0.15""")
define("effective", ("vfeat", "overrides"), """
SELECT coalesce(f.track_id, o.track_id) AS track_id, coalesce(o.vibe_label, f.vibe_label) AS vibe_label,
 coalesce(o.confidence, f.confidence, 0.15) AS confidence,
 CASE WHEN o.track_id IS NOT NULL THEN 'user_feedback_override' ELSE coalesce(f.label_source, 'unknown') END AS label_source,
 coalesce(f.rule_keywords, '') AS rule_keywords, f.genre, coalesce(f.plays_30d, 0) AS plays_30d,
 coalesce(f.unique_listeners_30d, 0) AS unique_listeners_30d, o.unique_users AS override_unique_users,
 o.top_share AS override_top_share, o.margin AS override_margin
FROM (SELECT * FROM vfeat WHERE vibe_label <> 'unknown') f FULL OUTER JOIN overrides o ON o.track_id = f.track_id""")


def votes(t):
    return V.vibe_vote_state(t.votes, VOTE_ORDER)


def effective(t):
    return V.vibe_effective(features(t), V.vibe_overrides(votes(t)))


query("vibe_vote_state", ("vote_state",), "SELECT * FROM vote_state")(votes)
query("vote_consensus_counts", ("vcounts",), "SELECT * FROM vcounts")(lambda t: V.vote_counts(votes(t)))
query("consensus_rank", ("consensus",), """
SELECT * REPLACE (round(top_share, 9) AS top_share, round(margin, 9) AS margin) FROM consensus""")(
    lambda t: V.consensus(votes(t)).withColumns({c: F.round(c, 9) for c in ("top_share", "margin")}))
query("vibe_overrides", ("overrides",), "SELECT * FROM overrides")(lambda t: flat(V.vibe_overrides(votes(t))))
for key in ("vibe_effective", "vibe_effective_full_outer"):
    query(key, ("effective",), "SELECT * FROM effective" if key == "vibe_effective" else
          "SELECT track_id, vibe_label, confidence, override_margin FROM effective")(
        (lambda t: flat(effective(t))) if key == "vibe_effective" else
        (lambda t: flat(effective(t)).select("track_id", "vibe_label", "confidence", "override_margin")))

define("by_label", ("effective", "requests", "cat_names"), """
SELECT r.vibe, row_number() OVER (PARTITION BY r.vibe ORDER BY e.confidence DESC, e.plays_30d DESC, e.track_id) AS position,
 e.track_id, coalesce(c.track_name, e.track_id) AS track_name, coalesce(c.artist_name, '__unknown_artist__') AS artist_name,
 e.genre, e.vibe_label, e.confidence, e.plays_30d
FROM effective e JOIN requests r ON list_contains(r.labels, e.vibe_label) LEFT JOIN cat_names c ON c.track_id = e.track_id
WHERE e.vibe_label <> 'unknown'""")
define("by_genre", ("track_catalog", "requests", "ready"), """
SELECT r.vibe, row_number() OVER (PARTITION BY r.vibe ORDER BY coalesce(p.n, 0) DESC, c.track_name, c.track_id, c.source) AS position,
 c.track_id, coalesce(nullif(c.track_name,''), c.track_id) AS track_name,
 coalesce(nullif(c.artist_name,''), '__unknown_artist__') AS artist_name, c.genre, coalesce(p.n, 0) AS plays_30d
FROM track_catalog c JOIN requests r ON len(list_filter(r.keywords, lambda k: lower(c.genre) LIKE concat('%', k, '%'))) > 0
LEFT JOIN (SELECT track_id, count(*) AS n FROM ready GROUP BY track_id) p ON p.track_id = c.track_id
WHERE c.track_name IS NOT NULL AND c.genre IS NOT NULL""")
define("matched", ("named", "track_catalog"), """
SELECT n.*, coalesce(m.genre_l, '') AS genre_l FROM named n LEFT JOIN (
 SELECT n.track_name, n.artist_name, max(nullif(lower(c.genre), '')) AS genre_l FROM named n JOIN track_catalog c
  ON lower(c.track_name) = lower(n.track_name) AND (lower(coalesce(c.artist_name,'')) = lower(n.artist_name)
     OR coalesce(c.artist_name,'') = '' OR lower(n.artist_name) = '')
 WHERE coalesce(c.track_name,'') <> '' GROUP BY n.track_name, n.artist_name) m
ON m.track_name = n.track_name AND m.artist_name = n.artist_name""")
define("by_name", ("matched", "requests"), """
SELECT vibe, row_number() OVER (PARTITION BY vibe ORDER BY s DESC, plays DESC, unique_listeners DESC, track_name, artist_name) AS global_rank_7d,
 coalesce(track_id, track_name) AS track_id, track_name, artist_id, artist_name, plays AS plays_7d, unique_listeners AS unique_listeners_7d,
 s AS vibe_match_score
FROM (SELECT m.*, r.vibe, list_max(list_transform(r.keywords, lambda k: CASE WHEN genre_l LIKE concat('%',k,'%') THEN 3
   WHEN lower(track_name) LIKE concat('%',k,'%') THEN 2 WHEN lower(artist_name) LIKE concat('%',k,'%') THEN 1 ELSE 0 END)) AS s
  FROM matched m CROSS JOIN requests r) WHERE s > 0""")
named = lambda t: P.named_popularity(t.ready)

query("vibe_tracks", ("by_label",), "SELECT * FROM by_label")(
    lambda t: flat(V.vibe_tracks(effective(t), t.catalog, REQUESTS)))
for key in ("vibe_catalog_match", "keyword_exists_semi"):
    query(key, ("by_genre",), "SELECT * FROM by_genre" if key == "vibe_catalog_match" else
          "SELECT vibe, position, track_id FROM by_genre")(
        (lambda t: V.vibe_catalog_match(t.catalog, t.ready, REQUESTS)) if key == "vibe_catalog_match" else
        (lambda t: V.vibe_catalog_match(t.catalog, t.ready, REQUESTS).select("vibe", "position", "track_id")))
query("name_or_blank_join", ("matched",), "SELECT track_id, track_name, artist_name, plays, genre_l FROM matched")(
    lambda t: V.name_match(named(t), t.catalog).select("track_id", "track_name", "artist_name", "plays", "genre_l"))
query("vibe_named_match", ("by_name",), "SELECT * FROM by_name")(
    lambda t: V.vibe_named_match(named(t), t.catalog, REQUESTS))
query("vibe_named_rank", ("by_name",), "SELECT vibe, global_rank_7d, track_id FROM by_name")(
    lambda t: V.vibe_named_match(named(t), t.catalog, REQUESTS).select("vibe", "global_rank_7d", "track_id"))

define("vitems", ("by_label", "by_genre", "by_name", "trending_ready", "named_ranked", "requests"), f"""
SELECT vibe, mode, position, track_id, track_name, artist_name FROM (
 SELECT *, min(pr) OVER (PARTITION BY vibe) AS first_pr FROM (
  SELECT vibe, 1 AS pr, 'vibe_match_features' AS mode, row_number() OVER (PARTITION BY vibe ORDER BY position) AS position,
    track_id, track_name, artist_name FROM by_label WHERE {READABLE}
  UNION ALL SELECT vibe, 2, 'vibe_match_catalog', row_number() OVER (PARTITION BY vibe ORDER BY position), track_id, track_name, artist_name
    FROM by_genre WHERE {READABLE}
  UNION ALL SELECT vibe, 3, 'vibe_fallback_named_keyword', global_rank_7d, track_id, track_name, artist_name FROM by_name
  UNION ALL SELECT vibe, 4, 'vibe_fallback_named_trending', row_number() OVER (PARTITION BY vibe ORDER BY global_rank_7d), track_id, track_name, artist_name
    FROM trending_ready CROSS JOIN requests WHERE {READABLE}
  UNION ALL SELECT vibe, 5, 'vibe_fallback_named_trending', global_rank_7d, track_id, track_name, artist_name FROM named_ranked CROSS JOIN requests)
 WHERE position <= 100) WHERE pr = first_pr""")


def vibe_items(t, limit=100, vibes=REQUESTS):
    names = named(t)
    trending = P.global_trending(P.track_popularity(t.ready, ready=True))
    return V.vibe_cascade(effective(t), t.catalog, t.ready, names, trending, P.named_trending(names, limit), vibes, limit)


query("vibe_cascade", ("vitems",), "SELECT * FROM vitems")(lambda t: vibe_items(t.with_stored_events()))
