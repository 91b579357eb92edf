"""Mood labels of tracks: rules, votes, overrides and retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import UNKNOWN, UNKNOWN_ARTIST, UNKNOWN_TRACK, blank_to_null, readable, strip
from earshot.functions.vibe_rules import best_vibe, confidence, strings, vibe_keywords, vibe_labels
from earshot.operators.history import catalog_names
from earshot.operators.popularity import best_name, count_rows
from earshot.operators.ranking import ranked
from earshot.operators.slices import since
from earshot.session import materialize


def vibe_candidates(cat: DataFrame, ev: DataFrame, days: int = 30) -> DataFrame:
    """Every track of catalog or events with names, genre and recent play counts.

    Names and counts come from one aggregate over the events; a listener counts only for plays
    inside the window. Both sides are hashed by track_id, so the outer join moves no more data.
    """
    recent = since(ev, days) & (F.col("event_type") == "play")
    plays = (ev.filter("track_id IS NOT NULL").withColumn("_recent", recent)
             .groupBy("track_id").agg(
                 best_name("track_name").alias("_t"), best_name("artist_name").alias("_a"),
                 F.count_if("_recent").alias("plays_30d"),
                 F.countDistinct(F.when(F.col("_recent"), F.col("user_id"))).alias("unique_listeners_30d")))
    listed = cat.filter("track_id IS NOT NULL").groupBy("track_id").agg(
        best_name("track_name").alias("track_name"), best_name("artist_name").alias("artist_name"),
        best_name("genre").alias("genre"))
    return (listed.join(plays, "track_id", "full_outer").filter(F.col("track_id") != UNKNOWN)
            .select("track_id", F.coalesce("track_name", "_t").alias("track_name"),
                    F.coalesce("artist_name", "_a").alias("artist_name"), "genre",
                    F.coalesce("plays_30d", F.lit(0)).alias("plays_30d"),
                    F.coalesce("unique_listeners_30d", F.lit(0)).alias("unique_listeners_30d")))


def vibe_features(cands: DataFrame, include_unknown: bool = False, limit: int | None = None) -> DataFrame:
    """Label by genre keywords, or by track and artist name when the genre says nothing."""
    if limit is not None:
        cands = cands.orderBy(F.col("plays_30d").desc(), F.col("track_id").asc()).limit(limit)
    text = F.concat_ws(" ", F.coalesce("track_name", F.lit("")), F.coalesce("artist_name", F.lit("")))
    matched = (cands.withColumn("_genre", best_vibe(F.coalesce("genre", F.lit(""))))
               .withColumn("_best", F.coalesce("_genre", best_vibe(text))))
    source = (F.when(F.col("_genre").isNotNull(), "genre_rule").when(F.col("_best").isNotNull(), "text_rule")
              .otherwise("no_genre_match"))
    out = matched.withColumn("label_source", source).select(
        "track_id", F.coalesce("_best.vibe", F.lit("unknown")).alias("vibe_label"),
        confidence(F.coalesce("_best.hits", F.lit(0)), F.col("plays_30d"), F.col("unique_listeners_30d"),
                   F.col("label_source")).alias("confidence"),
        "label_source", F.col("_best.keywords").alias("rule_keywords"), "genre", "plays_30d", "unique_listeners_30d")
    return out if include_unknown else out.filter(F.col("vibe_label") != "unknown")


def vibe_vote_state(vote_log: DataFrame, order: tuple[str, ...] = ("voted_at",)) -> DataFrame:
    """One row per (user, track): the latest vote, how many there were, first and last time."""
    chosen = blank_to_null(F.lower(strip(F.col("user_selected_vibe"))))
    log = vote_log.withColumns({"user_selected_vibe": chosen,
                                "predicted_vibe": blank_to_null(F.lower(strip(F.col("predicted_vibe"))))})
    return (log.filter("user_selected_vibe IS NOT NULL").groupBy("user_id", "track_id")
            .agg(F.max_by(F.struct("predicted_vibe", "user_selected_vibe"), F.struct(*order)).alias("v"),
                 count_rows().alias("feedback_count"), F.min("voted_at").alias("first_seen_at"),
                 F.max("voted_at").alias("updated_at"))
            .select("user_id", "track_id", "v.*", "feedback_count", "first_seen_at", "updated_at"))


def vote_counts(votes: DataFrame) -> DataFrame:
    return (votes.filter("user_selected_vibe <> ''")
            .groupBy("track_id", F.col("user_selected_vibe").alias("vibe_label"))
            .agg(F.countDistinct("user_id").alias("unique_users")))


def consensus(votes: DataFrame) -> DataFrame:
    """Leading label per track with its share of all voters and its lead over the next label."""
    counts = vote_counts(votes)
    totals = counts.groupBy("track_id").agg(F.sum("unique_users").alias("total_unique_users"))
    order = [F.col("unique_users").desc(), F.col("vibe_label").asc()]
    leaders = ranked(counts, ["track_id"], order, "rn", 2).groupBy("track_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("vibe_label"))).alias("vibe_label"),
        F.max(F.when(F.col("rn") == 1, F.col("unique_users"))).alias("top_unique_users"),
        F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("unique_users"))), F.lit(0)).alias("_second"))
    return (leaders.join(totals, "track_id")
            .withColumn("top_share", F.col("top_unique_users") / F.col("total_unique_users"))
            .withColumn("margin", (F.col("top_unique_users") - F.col("_second")) / F.col("total_unique_users"))
            .drop("_second"))


def vibe_overrides(votes: DataFrame, min_users: int = 15, min_share: float = 0.70, min_margin: float = 0.15) -> DataFrame:
    """Tracks whose voters agree; a track that no longer passes has no row."""
    passed = consensus(votes).filter(
        (F.col("total_unique_users") >= min_users) & (F.col("top_share") >= min_share) & (F.col("margin") >= min_margin))
    sure = F.least(F.lit(0.98), F.greatest(F.lit(0.70), F.col("top_share") + 0.10))
    return passed.select(
        "track_id", "vibe_label", F.round(sure, 3).cast("decimal(4,3)").alias("confidence"),
        F.col("total_unique_users").alias("unique_users"),
        F.round("top_share", 4).cast("decimal(5,4)").alias("top_share"),
        F.round("margin", 4).cast("decimal(5,4)").alias("margin"), F.lit(min_users).alias("threshold_users"))


def vibe_effective(features: DataFrame, overrides: DataFrame) -> DataFrame:
    f, o = features.alias("f"), overrides.alias("o")
    return f.join(o, "track_id", "full_outer").select(
        "track_id", F.coalesce("o.vibe_label", "f.vibe_label").alias("vibe_label"),
        F.coalesce(F.col("o.confidence"), F.col("f.confidence"), F.lit("0.150").cast("decimal(4,3)")).alias("confidence"),
        F.when(F.col("o.vibe_label").isNotNull(), "user_feedback_override")
        .otherwise(F.coalesce("f.label_source", F.lit("unknown"))).alias("label_source"),
        "f.rule_keywords", "f.genre", F.coalesce("f.plays_30d", F.lit(0)).alias("plays_30d"),
        F.coalesce("f.unique_listeners_30d", F.lit(0)).alias("unique_listeners_30d"),
        F.col("o.unique_users").alias("override_unique_users"), F.col("o.top_share").alias("override_top_share"),
        F.col("o.margin").alias("override_margin"))


def _readable() -> Column:
    return readable(F.col("track_name"), F.col("artist_name"), F.col("track_id"))


def _by_request(tests: dict[str, Column]) -> Column:
    """The requested moods whose test holds for a row, as an array to explode."""
    return F.filter(F.array(*[F.when(test, F.lit(vibe)) for vibe, test in tests.items()]), lambda v: v.isNotNull())


def vibe_tracks(effective: DataFrame, cat: DataFrame, vibes: list[str], limit: int | None = None,
                readable_only: bool = False) -> DataFrame:
    """Labelled tracks per requested mood, surest and most played first; only the first `limit` if given."""
    tests = {v: F.col("vibe_label").isin(*vibe_labels(v)) for v in vibes}
    hits = (effective.filter(F.col("vibe_label") != "unknown").withColumn("vibe", F.explode(_by_request(tests))))
    order = [F.col("confidence").desc(), F.col("plays_30d").desc(), F.col("track_id").asc()]
    shown = (hits.join(catalog_names(cat), "track_id", "left")
             .select("vibe", "track_id", F.coalesce("track_name", "track_id", F.lit(UNKNOWN_TRACK)).alias("track_name"),
                     F.coalesce("artist_name", F.lit(UNKNOWN_ARTIST)).alias("artist_name"),
                     "genre", "vibe_label", "confidence", "plays_30d"))
    return ranked(shown.filter(_readable()) if readable_only else shown, ["vibe"], order, "position", limit)


def _any_keyword(text: Column, words: list[str]) -> Column:
    """A text holds one of the words. Each pattern is a literal, so Catalyst makes it a substring test; a pattern that
    is put together in a row is compiled again for every row and word."""
    return reduce(lambda a, b: a | b, [text.like(f"%{w}%") for w in words])


def vibe_catalog_match(cat: DataFrame, ready: DataFrame, vibes: list[str], limit: int | None = None,
                       readable_only: bool = False) -> DataFrame:
    """Catalog rows whose genre holds a keyword of the requested mood, most played first."""
    pop = ready.groupBy("track_id").agg(count_rows().alias("_plays"))
    tests = {v: _any_keyword(F.lower("genre"), vibe_keywords(v)) for v in vibes}
    hits = (cat.filter("track_name IS NOT NULL AND genre IS NOT NULL")
            .withColumn("vibe", F.explode(_by_request(tests)))
            .join(pop, "track_id", "left")
            .select("vibe", F.coalesce("track_id", F.lit(UNKNOWN)).alias("track_id"),
                    F.coalesce(blank_to_null(F.col("track_name")), "track_id", F.lit(UNKNOWN)).alias("track_name"),
                    F.coalesce(blank_to_null(F.col("artist_name")), F.lit(UNKNOWN_ARTIST)).alias("artist_name"),
                    "genre", F.coalesce("_plays", F.lit(0)).alias("plays_30d"), F.col("track_name").alias("_raw"), "source"))
    order = [F.col("plays_30d").desc(), F.col("_raw").asc(), F.col("track_id").asc(), F.col("source").asc()]
    return ranked(hits.filter(_readable()) if readable_only else hits, ["vibe"], order, "position", limit) \
        .drop("_raw", "source")


def name_match(named: DataFrame, cat: DataFrame) -> DataFrame:
    """Named tracks with the lower-case genre of a catalog row of the same name.

    The artist must match too unless the catalog leaves it blank. The catalog is folded to one
    row per (name, artist) first and the join is on the name.
    """
    listed = (cat.filter(F.coalesce("track_name", F.lit("")) != "")
              .groupBy(F.lower("track_name").alias("_name"), F.lower(F.coalesce("artist_name", F.lit(""))).alias("_artist"))
              .agg(F.max(F.lower(blank_to_null(F.col("genre")))).alias("_genre")))
    exact = named.withColumns({"_name": F.lower("track_name"), "_artist": F.lower("artist_name")})
    blank = listed.filter("_artist = ''").select("_name", F.col("_genre").alias("_open"))
    any_artist = listed.groupBy("_name").agg(F.max("_genre").alias("_any"))
    joined = exact.join(listed, ["_name", "_artist"], "left").join(blank, "_name", "left").join(any_artist, "_name", "left")
    best = F.when(F.col("_artist") == "", F.col("_any")).otherwise(F.greatest("_genre", "_open"))
    return joined.withColumn("genre_l", F.coalesce(best, F.lit(""))).drop("_name", "_artist", "_genre", "_open", "_any")


def vibe_named_match(named: DataFrame, cat: DataFrame, vibes: list[str], limit: int | None = None) -> DataFrame:
    """Named tracks by their best keyword: 3 in the genre, 2 in the track name, 1 in the artist."""
    def best(words: list[str]) -> Column:
        texts = [(F.col("genre_l"), 3), (F.col("_track"), 2), (F.col("_artist"), 1)]
        return reduce(lambda rest, pair: F.when(_any_keyword(pair[0], words), pair[1]).otherwise(rest),
                      reversed(texts), F.lit(0))
    scores = F.array(*[F.struct(F.lit(v).alias("vibe"), best(vibe_keywords(v)).alias("score")) for v in vibes])
    # The scores are a column of their own: inside the filter their tests would be interpreted, not compiled.
    lowered = name_match(named, cat).withColumns({"_track": F.lower("track_name"), "_artist": F.lower("artist_name")})
    hits = (lowered.withColumn("_scores", scores).withColumn("_hit", F.explode(F.filter("_scores", lambda s: s.score > 0)))
            .drop("_scores", "_track", "_artist").select("*", "_hit.vibe", F.col("_hit.score").alias("vibe_match_score")))
    if limit is None:
        hits = materialize(hits)  # a full rank goes through its rows twice
    order = [F.col("vibe_match_score").desc(), F.col("plays").desc(), F.col("unique_listeners").desc(),
             F.col("track_name").asc(), F.col("artist_name").asc()]
    return ranked(hits, ["vibe"], order, "global_rank_7d", limit).select(
        "vibe", "global_rank_7d", F.coalesce("track_id", "track_name").alias("track_id"), "track_name", "artist_id",
        "artist_name", F.col("plays").alias("plays_7d"), F.col("unique_listeners").alias("unique_listeners_7d"),
        "vibe_match_score")


def vibe_cascade(effective: DataFrame, cat: DataFrame, ready: DataFrame, named: DataFrame, trending: DataFrame,
                 named_trending: DataFrame, vibes: list[str], limit: int = 10) -> DataFrame:
    """Items per requested mood from the first source that has readable ones; `mode` names it."""
    spark = effective.sparkSession

    def first_readable(df: DataFrame, rank: str, mode: str, priority: int) -> DataFrame:
        return (ranked(df.filter(_readable()), ["vibe"], [F.col(rank).asc()], "_p", limit)
                .select("vibe", F.lit(priority).alias("_priority"), F.lit(mode).alias("mode"),
                        F.col("_p").alias("position"), "track_id", "track_name", "artist_name"))

    wanted = spark.createDataFrame([(v,) for v in vibes], "vibe string")

    def for_all(df: DataFrame) -> DataFrame:
        return df.withColumn("vibe", F.explode(strings(vibes)))

    options = (first_readable(vibe_tracks(effective, cat, vibes, limit, True), "position", "vibe_match_features", 1)
               .unionByName(first_readable(vibe_catalog_match(cat, ready, vibes, limit, True), "position", "vibe_match_catalog", 2))
               .unionByName(vibe_named_match(named, cat, vibes, limit).select(
                   "vibe", F.lit(3).alias("_priority"), F.lit("vibe_fallback_named_keyword").alias("mode"),
                   F.col("global_rank_7d").alias("position"), "track_id", "track_name", "artist_name"))
               .unionByName(first_readable(for_all(trending), "global_rank_7d",
                                           "vibe_fallback_named_trending", 4))
               .unionByName(for_all(named_trending.filter(F.col("global_rank_7d") <= limit)).select(
                   "vibe", F.lit(5).alias("_priority"), F.lit("vibe_fallback_named_trending").alias("mode"),
                   F.col("global_rank_7d").alias("position"), "track_id", "track_name", "artist_name")))
    options = materialize(options.join(F.broadcast(wanted), "vibe", "left_semi"))
    first = options.groupBy("vibe").agg(F.min("_priority").alias("_priority"))
    return options.join(F.broadcast(first), ["vibe", "_priority"]).drop("_priority")
