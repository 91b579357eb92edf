"""Event filters, windows back from the newest event, and modelling user slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.events import stored_event_hash
from earshot.functions.text import UNKNOWN_ARTIST, readable
from earshot.operators.ranking import ranked
from earshot.session import scalar_max, small

MODEL_USERS = 1000


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def ready_events(ev: DataFrame) -> DataFrame:
    """Plays with usable user, track and artist metadata."""
    return ev.filter(
        (F.col("event_type") == "play") & _filled("user_id") & _filled("track_id")
        & _filled("track_name") & _filled("artist_name")
        & (F.lower("artist_name") != UNKNOWN_ARTIST)
        & (F.col("track_name") != F.col("track_id"))
        & ~F.col("track_name").rlike("^[0-9]+$"))


def readable_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("readable", readable(F.col("track_name"), F.col("artist_name"), F.col("track_id")))


def readable_only(df: DataFrame, limit: int, group: list[str], order: list[Column],
                  name: str = "position") -> DataFrame:
    """The first `limit` readable rows of each list, renumbered in `name`."""
    return ranked(readable_flag(df).filter("readable").drop("readable"), group, order, name, max_rank=limit)


def since(ev: DataFrame, days: int, anchor: DataFrame | None = None) -> Column:
    """Predicate: within `days` of the newest event of `anchor` (default: of `ev`), bound included.

    The newest event is a scalar subquery, so no join is planned and the comparison with its
    value reaches the scan.
    """
    newest = scalar_max(anchor if anchor is not None else ev, "event_ts")
    return F.col("event_ts") >= newest - F.expr(f"INTERVAL {int(days)} DAYS")


def within_days(ev: DataFrame, days: int) -> DataFrame:
    return ev.filter(since(ev, days))


def _plays_per_user(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_type") == "play").groupBy("user_id").agg(F.count(F.lit(1)).alias("plays"))


def model_users_gt20(ev: DataFrame, min_plays: int = 20) -> DataFrame:
    return _plays_per_user(ev).filter(F.col("plays") > min_plays)


def model_users_top(ev: DataFrame, n: int = MODEL_USERS) -> DataFrame:
    """The n users with most plays; ties go to the smaller user_id."""
    return _plays_per_user(ev).orderBy(F.col("plays").desc(), F.col("user_id").asc()).limit(n)


def slice_events_by_users(ev: DataFrame, users: DataFrame, n: int | None = None) -> DataFrame:
    """Events of the given users. A known bound `n` of their number allows a broadcast hint."""
    return ev.join(small(users.select("user_id"), n), "user_id", "left_semi")


def event_dedup(ev: DataFrame) -> DataFrame:
    """One row per event hash: the one with the smallest event_id.

    An aggregate rather than a window, so copies are dropped before the shuffle too. The hash travels as bytes, and the
    event_id once, in front of its row; a row without one comes last.
    """
    hashed = ev.withColumn("event_hash", stored_event_hash())
    others = [c for c in ev.columns if c not in ("event_id", "event_hash")]
    return (hashed.groupBy(F.unhex("event_hash").alias("_hash"))
            .agg(F.min(F.struct(F.col("event_id").isNull().alias("_none"), "event_id", *others)).alias("kept"))
            .select(*[f"kept.{c}" for c in ev.columns if c != "event_hash"], F.lower(F.hex("_hash")).alias("event_hash")))


def latest_events(ev: DataFrame, n: int = 1000) -> DataFrame:
    return ev.orderBy(F.col("event_ts").desc(), F.col("event_id").desc()).limit(n)


def top_users(users: DataFrame, n: int = 20) -> DataFrame:
    return users.orderBy(F.col("plays").desc(), F.col("user_id").asc()).limit(n)


def top_n_by_rank(df: DataFrame, rank_col: str, n: int, user_id: str | None = None) -> DataFrame:
    cut = df.filter(F.col(rank_col) <= n)
    return cut if user_id is None else cut.filter(F.col("user_id") == user_id)
