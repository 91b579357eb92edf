"""Recent and all-time popularity, per-user tops and trending ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import UNKNOWN, UNKNOWN_ARTIST, UNKNOWN_TRACK, blank_to_null
from earshot.operators.ranking import ranked
from earshot.operators.slices import within_days


def count_rows() -> Column:
    return F.count(F.lit(1))


def best_name(name: str) -> Column:
    """Largest non-blank value of a name column."""
    return F.max(blank_to_null(F.col(name)))


def _track_names() -> list[Column]:
    return [F.coalesce(best_name("track_name"), F.max("track_id"), F.lit(UNKNOWN_TRACK)).alias("track_name"),
            F.max("artist_id").alias("artist_id"),
            F.coalesce(best_name("artist_name"), F.lit(UNKNOWN_ARTIST)).alias("artist_name")]


def _plays(ev: DataFrame, days: int) -> DataFrame:
    return within_days(ev, days).filter(F.col("event_type") == "play")


def user_recent_activity(ev: DataFrame, days: int = 7) -> DataFrame:
    """Events of any type per user in the window."""
    return within_days(ev, days).groupBy("user_id").agg(
        count_rows().alias("plays_7d"), F.max("event_ts").alias("last_play_ts"))


def user_top_tracks(ev: DataFrame, days: int = 30, max_rank: int | None = None) -> DataFrame:
    counts = (_plays(ev, days)
              .groupBy("user_id", F.coalesce("track_id", F.lit(UNKNOWN)).alias("track_id_key"))
              .agg(F.max("track_id").alias("track_id"), *_track_names(),
                   count_rows().alias("plays_30d"), F.max("event_ts").alias("last_play_ts")))
    order = [F.col("plays_30d").desc(), F.col("last_play_ts").desc(), F.col("track_id_key").asc()]
    return ranked(counts, ["user_id"], order, "rank_in_user", max_rank).select(
        "user_id", "rank_in_user", "track_id", "track_name", "artist_id", "artist_name",
        "plays_30d", "last_play_ts")


def user_top_artists(ev: DataFrame, days: int = 30, ready: bool = False,
                     max_rank: int | None = None) -> DataFrame:
    """Artists per user. Raw events fold null artists into one '__unknown__' artist."""
    plays = _plays(ev, days)
    if ready:
        key, track = F.col("artist_id"), F.col("track_id")
    else:
        key = F.coalesce("artist_id", F.lit(UNKNOWN))
        track = F.coalesce("track_id", "track_name", F.lit(UNKNOWN_TRACK))
    counts = (plays.groupBy("user_id", key.alias("artist_id_key"))
              .agg(F.max("artist_id").alias("artist_id"),
                   F.coalesce(best_name("artist_name"), F.lit(UNKNOWN_ARTIST)).alias("artist_name"),
                   count_rows().alias("plays_30d"), F.countDistinct(track).alias("unique_tracks_30d"),
                   F.max("event_ts").alias("last_play_ts")))
    return rank_artists(counts, max_rank).select(
        "user_id", "rank_in_user", "artist_id", "artist_name", "plays_30d",
        "unique_tracks_30d", "last_play_ts")


def rank_artists(counts: DataFrame, max_rank: int | None) -> DataFrame:
    order = [F.col("plays_30d").desc(), F.col("unique_tracks_30d").desc(),
             F.col("last_play_ts").desc(), F.col("artist_id_key").asc_nulls_last()]
    return ranked(counts, ["user_id"], order, "rank_in_user", max_rank)


def track_popularity(ev: DataFrame, days: int = 7, ready: bool = False) -> DataFrame:
    if ready:
        key = F.col("track_id")
        names = [F.max(c).alias(c) for c in ("track_name", "artist_id", "artist_name")]
    else:
        key, names = F.coalesce("track_id", F.lit(UNKNOWN)), _track_names()
    return (_plays(ev, days).groupBy(key.alias("track_id_key"))
            .agg(F.max("track_id").alias("track_id"), *names, count_rows().alias("plays_7d"),
                 F.countDistinct("user_id").alias("unique_listeners_7d"),
                 F.max("event_ts").alias("last_play_ts")))


def global_trending(popularity: DataFrame, max_rank: int | None = None) -> DataFrame:
    order = [F.col("plays_7d").desc(), F.col("unique_listeners_7d").desc(),
             F.col("last_play_ts").desc(), F.col("track_id_key").asc()]
    return ranked(popularity.filter("track_id IS NOT NULL"), [], order, "global_rank_7d", max_rank).select(
        "global_rank_7d", "track_id", "track_name", "artist_id", "artist_name",
        "plays_7d", "unique_listeners_7d", "last_play_ts")


def artist_track_pop(ev: DataFrame, days: int = 30, ready: bool = False) -> DataFrame:
    plays = _plays(ev, days)
    if ready:
        keys = [F.col("artist_id"), F.col("track_id")]
        values = [F.max("track_name").alias("track_name"), F.max("artist_name").alias("artist_name")]
        return plays.groupBy(*keys).agg(*values, count_rows().alias("plays_30d"))
    keys = [F.coalesce("artist_id", F.lit(UNKNOWN)).alias("artist_id_key"),
            F.coalesce("track_id", F.lit(UNKNOWN)).alias("track_id_key")]
    return (plays.groupBy(*keys)
            .agg(F.max("track_id").alias("track_id"), *_track_names(), count_rows().alias("plays_30d"))
            .select("artist_id", "track_id", "track_name", "artist_name", "plays_30d"))


def named_popularity(ready: DataFrame) -> DataFrame:
    """All-time popularity per (track name, artist name)."""
    named = ready.filter((F.col("artist_name") != UNKNOWN_ARTIST) & (F.col("track_name") != ""))
    return (named.groupBy("track_name", "artist_name")
            .agg(F.min(blank_to_null(F.col("track_id"))).alias("track_id"),
                 F.min(blank_to_null(F.col("artist_id"))).alias("artist_id"),
                 count_rows().alias("plays"), F.countDistinct("user_id").alias("unique_listeners"),
                 F.max("event_ts").alias("last_play_ts"))
            .select("track_id", "artist_id", "track_name", "artist_name", "plays",
                    "unique_listeners", "last_play_ts"))


def named_trending(named: DataFrame, limit: int | None = 20) -> DataFrame:
    """Trending layout over all-time counts; the *_7d names are kept for the serving schema."""
    order = [F.col("plays").desc(), F.col("unique_listeners").desc(), F.col("last_play_ts").desc(),
             F.col("track_name").asc(), F.col("artist_name").asc()]
    return ranked(named, [], order, "global_rank_7d", limit).select(
        "global_rank_7d", F.coalesce("track_id", "track_name").alias("track_id"), "track_name",
        "artist_id", "artist_name", F.col("plays").alias("plays_7d"),
        F.col("unique_listeners").alias("unique_listeners_7d"))


def user_track_totals(ev: DataFrame) -> DataFrame:
    """All-time events per user and track; id and name stand in for each other when blank."""
    ident, name = blank_to_null(F.col("track_id")), blank_to_null(F.col("track_name"))
    return (ev.groupBy("user_id",
                       F.coalesce(ident, name, F.lit(UNKNOWN_TRACK)).alias("track_id"),
                       F.coalesce(name, ident, F.lit(UNKNOWN_TRACK)).alias("track_name"))
            .agg(F.min(blank_to_null(F.col("artist_id"))).alias("artist_id"),
                 F.coalesce(best_name("artist_name"), F.lit(UNKNOWN_ARTIST)).alias("artist_name"),
                 count_rows().alias("plays"), F.max("event_ts").alias("last_played_at")))


def user_favorites(ev: DataFrame, top: int | None = None) -> DataFrame:
    """The tracks of each user, most played first; the first `top` if given."""
    order = [F.col("plays").desc(), F.col("last_played_at").desc(), F.col("track_name").asc(),
             F.col("artist_name").asc(), F.col("track_id").asc()]
    return ranked(user_track_totals(ev), ["user_id"], order, "favorite_rank", top).select(
        "user_id", "favorite_rank", "track_id", "track_name", "artist_id", "artist_name", "plays")
