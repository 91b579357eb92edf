"""Training input: play history, explicit feedback, and their blend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import UNKNOWN_ARTIST, blank_to_null, clean_text_columns
from earshot.operators.popularity import best_name, count_rows
from earshot.operators.ranking import ranked
from earshot.operators.slices import slice_events_by_users
from earshot.session import small

# How actions count as feedback, and the floors of their strengths.
POSITIVE_ACTIONS = ("play", "like", "favorite", "add_to_playlist")
NEGATIVE_ACTIONS = ("skip", "dislike")
STRENGTH = "decimal(6,3)"


def user_track_history(ready: DataFrame, users: DataFrame, min_plays: int = 1, n: int | None = None) -> DataFrame:
    return (slice_events_by_users(ready, users, n).groupBy("user_id", "track_id")
            .agg(F.max("track_name").alias("track_name"), F.max("artist_name").alias("artist_name"),
                 count_rows().alias("plays"))
            .filter(F.col("plays") >= min_plays))


def catalog_names(cat: DataFrame) -> DataFrame:
    """One row of names per track over all catalog sources."""
    return cat.groupBy("track_id").agg(best_name("track_name").alias("track_name"),
                                       best_name("artist_name").alias("artist_name"))


def attach_names(df: DataFrame, cat: DataFrame, ev: DataFrame) -> DataFrame:
    """Names for (user_id, track_id) rows: the catalog's, else those of the user's own plays."""
    own = ev.groupBy("user_id", "track_id").agg(best_name("track_name").alias("_own_track"),
                                                best_name("artist_name").alias("_own_artist"))
    return (df.join(catalog_names(cat), "track_id", "left")
            .join(own, ["user_id", "track_id"], "left")
            .withColumn("track_name", F.coalesce("track_name", "_own_track", "track_id"))
            .withColumn("artist_name", F.coalesce("artist_name", "_own_artist", F.lit(UNKNOWN_ARTIST)))
            .drop("_own_track", "_own_artist"))


def feedback_scores(inter: DataFrame, users: DataFrame, cat: DataFrame, ready: DataFrame,
                    fanout: bool = False, n: int | None = None) -> DataFrame:
    """Signed feedback per (user, track).

    `fanout` multiplies each score by the user's plays of the track and by its catalog sources,
    as joining both tables row by row does; by default a signal counts once.
    """
    strength = F.col("signal_strength").cast(STRENGTH)

    def at_least(value, floor: str):
        return F.greatest(value, F.lit(floor).cast(STRENGTH))

    signed = (F.when(F.col("action").isin(*POSITIVE_ACTIONS), at_least(strength, "0.10"))
              .when(F.col("action") == "impression", at_least(strength, "0.01"))
              .when(F.col("action").isin(*NEGATIVE_ACTIONS), -at_least(F.abs(strength), "0.10"))
              .otherwise(F.lit(0).cast(STRENGTH)))
    scores = (inter.filter(F.coalesce("track_id", F.lit("")) != "")
              .join(small(users.select("user_id"), n), "user_id", "left_semi")
              .groupBy("user_id", "track_id").agg(F.sum(signed).alias("feedback_score")))
    own = slice_events_by_users(ready, users, n)
    if fanout:
        copies = cat.groupBy("track_id").agg(count_rows().alias("_sources"))
        plays = own.groupBy("user_id", "track_id").agg(count_rows().alias("_plays"))
        factor = F.coalesce("_sources", F.lit(1)) * F.coalesce("_plays", F.lit(1))
        scores = (scores.join(copies, "track_id", "left").join(plays, ["user_id", "track_id"], "left")
                  .withColumn("feedback_score", F.col("feedback_score") * factor.cast("decimal(18,0)"))
                  .drop("_sources", "_plays"))
    return attach_names(scores, cat, own).select(
        "user_id", "track_id", "track_name", "artist_name", "feedback_score")


def blended_history(ready: DataFrame, users: DataFrame, feedback: DataFrame, boost: str = "4.0",
                    min_plays: int = 1, n: int | None = None) -> DataFrame:
    """Plays plus boosted feedback, never below zero, rounded up."""
    base = user_track_history(ready, users, 1, n)
    both = base.alias("b").join(feedback.alias("f"), ["user_id", "track_id"], "full_outer")
    score = F.greatest(
        F.lit(0).cast("decimal(28,4)"),
        F.coalesce("plays", F.lit(0)).cast("decimal(18,0)")
        + F.lit(boost).cast("decimal(6,1)") * F.coalesce(F.col("feedback_score").cast("decimal(18,3)"), F.lit(0)))
    return (both.withColumn("_score", score).filter(F.col("_score") >= min_plays)
            .select("user_id", "track_id",
                    F.coalesce(blank_to_null(F.col("b.track_name")), blank_to_null(F.col("f.track_name")),
                               F.col("track_id")).alias("track_name"),
                    F.coalesce(blank_to_null(F.col("b.artist_name")), blank_to_null(F.col("f.artist_name")),
                               F.lit(UNKNOWN_ARTIST)).alias("artist_name"),
                    F.ceil("_score").cast("long").alias("plays")))


def interaction_weights(hist: DataFrame) -> DataFrame:
    """log1p(plays) over its maximum, held between 0.1 and 1."""
    logs = hist.select("user_id", "track_id", F.log1p(F.greatest("plays", F.lit(1)).cast("double")).alias("_log"))
    top = logs.agg(F.max("_log").alias("m")).scalar()
    weight = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("_log") / top))
    return logs.select("user_id", "track_id", weight.alias("weight"))


def cleaned_names(hist: DataFrame) -> DataFrame:
    """Cleaned names with the track id and the unknown artist as stand-ins."""
    return clean_text_columns(hist, ["track_name", "artist_name"]).withColumns({
        "track_name": F.coalesce("track_name", "track_id"),
        "artist_name": F.coalesce("artist_name", F.lit(UNKNOWN_ARTIST))})


def user_artist_counts(hist: DataFrame) -> DataFrame:
    return hist.groupBy("user_id", "artist_name").agg(F.sum("plays").alias("plays"))


def user_artists_top(hist: DataFrame, n: int = 5) -> DataFrame:
    order = [F.col("plays").desc(), F.col("artist_name").asc()]
    return ranked(user_artist_counts(hist), ["user_id"], order, "artist_rank", max(n, 1))


def global_pop(hist: DataFrame) -> DataFrame:
    return hist.groupBy("track_id").agg(F.sum("plays").alias("plays"))


def first_seen_names(hist: DataFrame) -> DataFrame:
    """Names of a track as its first user (by id) has them."""
    return (hist.groupBy("track_id").agg(F.min_by(F.struct("track_name", "artist_name"), "user_id").alias("m"))
            .select("track_id", "m.track_name", "m.artist_name"))
