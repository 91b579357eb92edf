"""Rule-based recommendations: tracks of a user's recent top artists, then trending tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import UNKNOWN, UNKNOWN_ARTIST, UNKNOWN_TRACK
from earshot.operators.popularity import best_name, global_trending, rank_artists
from earshot.operators.ranking import positions, ranked
from earshot.operators.slices import since
from earshot.session import materialize, small

REC_COLUMNS = ("user_id", "recommendation_rank", "track_id", "track_name", "artist_id", "artist_name",
               "artist_affinity_rank", "track_popularity_30d", "recommendation_score")
# Trending tracks in a row of the list, where users get all of it.
TREND_BLOCK = 1024


def play_cube(ev: DataFrame, days: int, recent_days: int) -> DataFrame:
    """One row per (user, artist, track) of the window, with counts for the shorter one too.

    Everything the rules need comes from this table, so the events are read once.
    """
    recent = since(ev, recent_days)
    plays = ev.filter(since(ev, days)).filter(F.col("event_type") == "play")
    return materialize(
        plays.withColumn("_recent", recent)
        .groupBy("user_id", "artist_id", "track_id",
                 F.coalesce("track_id", "track_name", F.lit(UNKNOWN_TRACK)).alias("track_ref"))
        .agg(F.count(F.lit(1)).alias("plays"), best_name("track_name").alias("track_name"),
             best_name("artist_name").alias("artist_name"), F.max("event_ts").alias("last_play_ts"),
             F.count_if("_recent").alias("recent_plays"),
             F.max(F.when(F.col("_recent"), F.nullif("track_name", F.lit("")))).alias("recent_track_name"),
             F.max(F.when(F.col("_recent"), F.nullif("artist_name", F.lit("")))).alias("recent_artist_name")))


def _top_artists(cube: DataFrame, ready: bool, top: int) -> DataFrame:
    key = F.col("artist_id") if ready else F.coalesce("artist_id", F.lit(UNKNOWN))
    counts = cube.groupBy("user_id", key.alias("artist_id_key")).agg(
        F.max("artist_id").alias("artist_id"), F.sum("plays").alias("plays_30d"),
        F.countDistinct("track_ref").alias("unique_tracks_30d"),
        F.max("last_play_ts").alias("last_play_ts"))
    return (rank_artists(counts, top).filter("artist_id IS NOT NULL")
            .select("user_id", "artist_id", "unique_tracks_30d",
                    F.col("rank_in_user").alias("artist_affinity_rank")))


def _artist_tracks(cube: DataFrame) -> DataFrame:
    named = cube.filter("artist_id IS NOT NULL AND track_id IS NOT NULL")
    return named.groupBy("artist_id", "track_id").agg(
        F.coalesce(F.max("track_name"), F.col("track_id")).alias("track_name"),
        F.coalesce(F.max("artist_name"), F.lit(UNKNOWN_ARTIST)).alias("artist_name"),
        F.sum("plays").alias("track_popularity_30d"))


def _trending(cube: DataFrame) -> DataFrame:
    recent = (cube.filter("recent_plays > 0 AND track_id IS NOT NULL")
              .groupBy("track_id").agg(
                  F.coalesce(F.max("recent_track_name"), F.col("track_id")).alias("track_name"),
                  F.max("artist_id").alias("artist_id"),
                  F.coalesce(F.max("recent_artist_name"), F.lit(UNKNOWN_ARTIST)).alias("artist_name"),
                  F.sum("recent_plays").alias("plays_7d"),
                  F.countDistinct("user_id").alias("unique_listeners_7d"),
                  F.max("last_play_ts").alias("last_play_ts"))
              .withColumn("track_id_key", F.col("track_id")))
    return global_trending(recent)


def artist_candidates(top_artists: DataFrame, tracks: DataFrame, max_rank: int | None = None) -> DataFrame:
    """Each user's top artists joined with those artists' tracks, on (artist, position in the artist's list).

    The position splits a hot artist over many tasks. With `max_rank` only candidates that can
    still reach it are joined: a track of one artist that has `max_rank` unplayed tracks of that
    artist ahead of it cannot, so the first max_rank + (tracks already played) positions are
    enough. Tracks credited to several artists are ranked by more than one row and are joined in full.
    """
    columns = ["user_id", "artist_id", "artist_affinity_rank", "track_id", "track_name",
               "artist_name", "track_popularity_30d"]

    def join_all(listed: DataFrame, need) -> DataFrame:
        length = listed.groupBy("artist_id").agg(F.max("_pos").alias("_length"))
        wanted = positions(top_artists.join(length, "artist_id"), need, "_pos")
        return wanted.join(listed, ["artist_id", "_pos"]).select(columns)

    by_popularity = [F.col("track_popularity_30d").desc(), F.col("track_id").asc()]
    if max_rank is None:
        return join_all(ranked(tracks, ["artist_id"], by_popularity, "_pos"), F.col("_length"))
    shared = tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("_credits")).filter("_credits > 1")
    several = tracks.join(shared.select("track_id"), "track_id", "left_semi")
    single = tracks.join(shared.select("track_id"), "track_id", "left_anti")
    first = join_all(ranked(single, ["artist_id"], by_popularity, "_pos"),
                     F.least("_length", F.col("unique_tracks_30d") + max_rank))
    rest = join_all(ranked(several, ["artist_id"], by_popularity, "_pos"), F.col("_length"))
    return first.unionByName(rest)


def _all_fallback(users: DataFrame, trending: DataFrame, met: DataFrame, total: int) -> DataFrame:
    """Every trending track that a user hasn't met, numbered in `_row`; `met` has a user's ranks in `_met`.

    The list is held in blocks, a row each. A user has a row per block with the ranks met there, and the block's tracks are
    spelt out once the two have met, so rows per user and rank are neither joined, sorted nor shuffled.
    """
    spark = users.sparkSession
    first = F.col("_block") * F.lit(TREND_BLOCK)
    blocks = (trending.withColumn("_block", F.floor((F.col("global_rank_7d") - 1) / TREND_BLOCK))
              .groupBy("_block").agg(F.sort_array(F.collect_list(F.struct(
                  "global_rank_7d", *[c for c in trending.columns if c != "global_rank_7d"]))).alias("_tracks")))
    asking = (users.join(met, "user_id", "left").repartition(4 * spark.sparkContext.defaultParallelism, "user_id")
              .withColumn("_met", F.coalesce("_met", F.expr("CAST(array() AS array<bigint>)")))
              .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((total - 1) // TREND_BLOCK).cast("long"))).alias("_block"))
              .select(*users.columns, "_block", (first - F.size(F.filter("_met", lambda m: m <= first))).alias("_before"),
                      F.filter("_met", lambda m: (m > first) & (m <= first + TREND_BLOCK)).alias("_own")))
    new = F.filter("_tracks", lambda t: ~F.array_contains("_own", t["global_rank_7d"]))
    return (asking.join(small(blocks, total), "_block")
            .select(*users.columns, "_before", F.posexplode(new).alias("_at", "_t"))
            .select(*users.columns, "_t.*", (F.col("_before") + F.col("_at") + 1).cast("long").alias("_row")))


def fallback_candidates(users: DataFrame, trending: DataFrame, played: DataFrame, candidates: DataFrame,
                        rows: int | None, max_rank: int | None = None) -> DataFrame:
    """The first `rows` trending tracks that a user has neither played nor been given (all of them if None), numbered in `_row`.

    A user who knows k trending tracks meets `rows` new ones within the first k + rows ranks. The ranks known are gathered
    per user, so what is left of 1, 2, 3 ... needs no join of its rows; the leading tracks that any user needs are few and
    are joined by rank. With `max_rank` the given tracks count as rows already had. `users` has user_id and
    personalized_count, `played` and `candidates` have user_id, track_id.
    """
    total = trending.agg(F.coalesce(F.max("global_rank_7d"), F.lit(0)).alias("n")).scalar()
    met = (played.select("user_id", "track_id").unionByName(candidates.select("user_id", "track_id"))
           .join(trending.select("track_id", "global_rank_7d"), "track_id")
           .groupBy("user_id").agg(F.collect_set("global_rank_7d").alias("_met")))
    if rows is None:
        length = trending.agg(F.max("global_rank_7d")).first()[0]
        return _all_fallback(users, trending if length else trending.limit(0), met, length or 1)
    asking = users if max_rank is None else users.filter(F.col("personalized_count") < max_rank)
    wanted = F.lit(rows) if max_rank is None else F.lit(max_rank) - F.col("personalized_count")
    needed = materialize(
        asking.join(met, "user_id", "left")
        .withColumn("_met", F.coalesce("_met", F.expr("CAST(array() AS array<bigint>)")))
        .withColumn("_wanted", wanted.cast("int"))
        .withColumn("_need", F.least(total, F.size("_met") + F.col("_wanted")).cast("long"))
        .filter("_need >= 1"))
    most = needed.agg(F.max("_need")).first()[0] or 0
    new = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), F.col("_need")), F.col("_met")), F.lit(1), F.col("_wanted"))
    return (needed.select(*users.columns, F.posexplode(new).alias("_at", "global_rank_7d"))
            .join(small(trending.filter(F.col("global_rank_7d") <= most), most), "global_rank_7d")
            .withColumn("_row", F.col("_at").cast("long") + 1).drop("_at"))


def append_fallback(personalised: DataFrame, fallback: DataFrame) -> DataFrame:
    """Trending rows after the personalised ones; `fallback` carries each user's offset."""
    shifted = (fallback.withColumn("recommendation_rank", F.col("personalized_count") + F.col("_row"))
               .withColumn("artist_affinity_rank", F.lit(None).cast("long"))
               .withColumn("track_popularity_30d", F.col("plays_7d"))
               .withColumn("recommendation_score",
                           F.col("plays_7d") * F.lit(0.001) + F.lit(1.0) / (F.col("global_rank_7d") + 1000)))
    return personalised.select(*REC_COLUMNS).unionByName(shifted.select(*REC_COLUMNS))


def recs_rule(ev: DataFrame, days: int = 30, top_artists: int = 5, users: DataFrame | None = None,
              ready: bool = True, max_rank: int | None = None, fallback_rows: int | None = 100) -> DataFrame:
    """Recommendations of every active user, or of those in `users` only.

    All personalised rows, then the first `fallback_rows` trending tracks that are new to the user (all that there are if
    None); or, with `max_rank`, the first max_rank rows of both together.

    `users` restricts the receiving side before candidates are built; artist and trending
    counts always come from all events.
    """
    cube = play_cube(ev, days, 7)
    receiving = cube if users is None else materialize(
        cube.join(users.select("user_id"), "user_id", "left_semi"))
    trending = materialize(_trending(cube))
    played = receiving.filter("track_id IS NOT NULL").select("user_id", "track_id").distinct()
    found = (artist_candidates(_top_artists(receiving, ready, top_artists), _artist_tracks(cube), max_rank)
             .join(played, ["user_id", "track_id"], "left_anti")
             .withColumn("recommendation_score",
                         F.col("track_popularity_30d") * (F.lit(1.0) / F.col("artist_affinity_rank")))
             .groupBy("user_id", "track_id").agg(
                 F.max("track_name").alias("track_name"), F.max("artist_id").alias("artist_id"),
                 F.max("artist_name").alias("artist_name"),
                 F.min("artist_affinity_rank").alias("artist_affinity_rank"),
                 F.max("track_popularity_30d").alias("track_popularity_30d"),
                 F.max("recommendation_score").alias("recommendation_score")))
    order = [F.col("recommendation_score").desc(), F.col("track_popularity_30d").desc(), F.col("track_id").asc()]
    personalised = materialize(ranked(found, ["user_id"], order, "recommendation_rank", max_rank))
    counts = personalised.groupBy("user_id").agg(F.count(F.lit(1)).alias("personalized_count"))
    active = (receiving.select("user_id").distinct().join(counts, "user_id", "left")
              .withColumn("personalized_count", F.coalesce("personalized_count", F.lit(0))))
    wanted = fallback_rows if max_rank is None else max_rank
    fallback = fallback_candidates(active, trending, played, personalised, wanted, max_rank)
    out = append_fallback(personalised, fallback)
    return out if max_rank is None else out.filter(F.col("recommendation_rank") <= max_rank)
