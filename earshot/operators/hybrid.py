"""Popularity and hybrid recommendations from a bounded pool of popular tracks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import UNKNOWN_ARTIST, clean_text_columns
from earshot.operators.history import cleaned_names, first_seen_names, global_pop, user_artists_top
from earshot.operators.ranking import positions, ranked
from earshot.session import materialize, small


@dataclass(frozen=True)
class HybridSettings:
    """`mf_scan`, `pool` and `cap` cut the MF rows, the popular tracks and the candidates of a user; by default
    nothing is cut. `evaluation` gives the variant used to evaluate."""

    k: int = 100
    mf_scan: int | None = None
    pool: int | None = None
    artists: int = 5
    weights: tuple[float, float, float] = (0.45, 0.45, 0.10)
    cap: int | None = None
    popularity_breaks_ties: bool = True
    scale_over_scan: bool = True
    clean: bool = True

    @property
    def scanned(self) -> int | None:
        return None if self.mf_scan is None else max(self.mf_scan, self.k)

    @property
    def pool_size(self) -> int | None:
        return None if self.pool is None else max(self.pool, self.k)

    @staticmethod
    def evaluation(scan: int, weights=(0.65, 0.25, 0.10)) -> "HybridSettings":
        return HybridSettings(k=scan, weights=weights, popularity_breaks_ties=False, scale_over_scan=False, clean=False)


def top_pop_pool(pop: DataFrame, n: int | None = None) -> DataFrame:
    """All tracks, numbered from the most played; the first n if given."""
    return ranked(pop, [], [F.col("plays").desc(), F.col("track_id").asc()], "pool_rank", n)


def user_ranges(mf: DataFrame, near: Sequence[str] = ()) -> DataFrame:
    """Each user's score range. `near` are columns that follow from the user; where rows are gathered by them, none is shuffled."""
    return mf.groupBy(*near, "user_id").agg(F.min("recommendation_score").alias("mf_min"),
                                            F.max("recommendation_score").alias("mf_max")).drop(*near)


def mf_minmax(mf: DataFrame) -> DataFrame:
    """Each user's score range, as an aggregate joined back (a hot user stays splittable)."""
    return mf.join(user_ranges(mf), "user_id")


def _leading_pool(users: DataFrame, excluded: DataFrame, pool: DataFrame, wanted: int,
                  bound: int | None) -> DataFrame:
    """The first `wanted` pool rows of each user that are not in `excluded`, without scanning the
    pool per user: a user with e excluded pool rows needs the first wanted + e positions."""
    counts = excluded.groupBy("user_id").agg(F.count(F.lit(1)).alias("_out"))
    size = pool.agg(F.coalesce(F.max("pool_rank"), F.lit(0)).alias("n")).scalar()
    need = F.least(size, F.coalesce("_out", F.lit(0)) + wanted)
    spread = positions(users.select("user_id").join(counts, "user_id", "left"), need, "pool_rank")
    return (spread.select("user_id", "pool_rank")
            .join(excluded, ["user_id", "pool_rank"], "left_anti")
            .join(small(pool, bound), "pool_rank"))


def _leading_of_artists(likes: DataFrame, excluded: DataFrame, pool: DataFrame, s: "HybridSettings") -> DataFrame:
    """Pool positions of the tracks of each user's artists that can be among the best k: of an artist with e excluded
    tracks the first k + e. Joined by artist and place in the artist's list, so an artist's rows spread over tasks."""
    listed = pool.select("artist_name", "pool_rank", "place")
    sizes = pool.groupBy("artist_name").agg(F.max("place").alias("size"))
    wanted = likes.join(sizes, "artist_name")
    if s.cap is not None:  # the walk down the pool decides; all tracks of the artists take part
        need = F.col("size")
    else:
        out = excluded.groupBy("user_id", "artist_name").agg(F.count(F.lit(1)).alias("_out"))
        wanted = wanted.join(out, ["user_id", "artist_name"], "left")
        need = F.least("size", F.coalesce("_out", F.lit(0)) + s.k)
    return positions(wanted, need, "place").join(listed, ["artist_name", "place"]).select("user_id", "pool_rank")


def capped_pool(users: DataFrame, mf_candidates: DataFrame, excluded: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """Keep wanted pool positions that a walk down the pool reaches before `cap` candidates.

    The walk starts with the user's MF candidates and adds each pool track that is not excluded
    (played or already a candidate), so a position p is reached when
    candidates + (p - 1 - excluded before p) is below the cap.
    """
    started = mf_candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("_started"))
    marks = (wanted.select("user_id", "pool_rank", F.lit(0).alias("_out"))
             .unionByName(excluded.select("user_id", "pool_rank", F.lit(1).alias("_out")))
             .groupBy("user_id", "pool_rank").agg(F.max("_out").alias("_out")))
    before = Window.partitionBy("user_id").orderBy("pool_rank").rowsBetween(Window.unboundedPreceding, -1)
    walked = marks.withColumn("_skipped", F.coalesce(F.sum("_out").over(before), F.lit(0)))
    reached = F.coalesce("_started", F.lit(0)) + F.col("pool_rank") - 1 - F.col("_skipped") < cap
    return (walked.filter("_out = 0").join(started, "user_id", "left").filter(reached)
            .select("user_id", "pool_rank"))


def recs_popularity(train_counts: DataFrame, test_users: DataFrame, scan: int) -> DataFrame:
    """The `scan` most played training tracks that a user has not played."""
    meta = first_seen_names(train_counts)
    pool = materialize(top_pop_pool(global_pop(train_counts)).join(meta, "track_id"))
    seen = (train_counts.join(pool, "track_id").select("user_id", "pool_rank")
            .join(test_users.select("user_id"), "user_id", "left_semi"))
    rows = _leading_pool(test_users, seen, pool, scan, None)
    return ranked(rows, ["user_id"], [F.col("pool_rank").asc()], "recommendation_rank", scan).select(
        "user_id", "recommendation_rank", "track_id", "track_name", "artist_name",
        F.col("plays").cast("double").alias("recommendation_score"))


def hybrid_components(hist: DataFrame, mf: DataFrame, settings: HybridSettings = HybridSettings(),
                      users: DataFrame | None = None) -> DataFrame:
    """The candidates of each user with MF score, popularity and artist bonus, whatever their weights will be.

    A popular track outside the MF rows scores by popularity alone, or with the artist bonus.
    Only the first k of the former and the tracks of the user's top artists can be among the
    best k, so no user walks the whole pool.
    """
    s = settings
    hist = materialize(cleaned_names(hist) if s.clean else hist)
    users = (hist if users is None else users).select("user_id").distinct()
    pop = global_pop(hist)
    top_pop = pop.agg(F.max("plays").alias("m")).scalar()
    meta = first_seen_names(hist)
    pool = materialize(ranked(top_pop_pool(pop, s.pool_size).join(meta, "track_id"), ["artist_name"],
                              [F.col("pool_rank").asc()], "place"))
    likes = materialize(user_artists_top(hist, s.artists).select("user_id", "artist_name"))

    # One pass over the MF rows: played ones are marked, not dropped, because they count in the range.
    mine = mf.join(users, "user_id", "left_semi").select(
        "user_id", "track_id", "track_name", "artist_name", "recommendation_rank",
        F.col("recommendation_score").alias("mf_raw"))
    mine = mine if s.scanned is None or not s.scale_over_scan else mine.filter(F.col("recommendation_rank") <= s.scanned)
    if s.clean:
        named = meta.select("track_id", F.col("track_name").alias("_t"), F.col("artist_name").alias("_a"))
        mine = (clean_text_columns(mine, ["track_name", "artist_name"]).join(named, "track_id", "left")
                .withColumn("track_name", F.coalesce("track_name", "_t", "track_id"))
                .withColumn("artist_name", F.coalesce("artist_name", "_a", F.lit(UNKNOWN_ARTIST))).drop("_t", "_a"))
    marked = materialize(mine.join(hist.select("user_id", "track_id", F.lit(True).alias("_played")),
                                   ["user_id", "track_id"], "left"))
    ranges = marked.groupBy("user_id").agg(F.min("mf_raw").alias("mf_min"), F.max("mf_raw").alias("mf_max"))
    near = F.lit(True) if s.scanned is None else F.col("recommendation_rank") <= s.scanned
    from_mf = marked.filter(F.col("_played").isNull() & near).select(
        "user_id", "track_id", "track_name", "artist_name", "mf_raw")

    ranks = small(pool.select("track_id", "pool_rank", "artist_name"), s.pool_size)
    excluded = materialize(
        hist.select("user_id", "track_id").join(users, "user_id", "left_semi")
        .unionByName(from_mf.select("user_id", "track_id"))
        .join(ranks, "track_id").select("user_id", "pool_rank", "artist_name"))
    leading = _leading_pool(users, excluded, pool, s.k, s.pool_size).select("user_id", "pool_rank")
    liked = _leading_of_artists(likes.join(users, "user_id", "left_semi"), excluded, pool, s)
    wanted = leading.unionByName(liked)
    kept = (capped_pool(users, from_mf, excluded, wanted, s.cap) if s.cap is not None
            else wanted.distinct().join(excluded, ["user_id", "pool_rank"], "left_anti"))
    from_pool = kept.join(small(pool, s.pool_size), "pool_rank").select(
        "user_id", "track_id", "track_name", "artist_name", F.lit(None).cast("double").alias("mf_raw"))

    lowest = F.coalesce("mf_min", F.lit(0.0))
    spread = F.when(F.col("mf_max") != F.col("mf_min"), F.col("mf_max") - F.col("mf_min")).otherwise(F.lit(1.0))
    return (from_mf.unionByName(from_pool)
              .join(ranges, "user_id", "left")
              .join(pop, "track_id", "left")
              .join(likes.withColumn("_liked", F.lit(True)), ["user_id", "artist_name"], "left")
              .withColumn("mf_score", (F.coalesce("mf_raw", lowest) - lowest) / spread)
              .withColumn("pop_score", F.coalesce("plays", F.lit(0)).cast("double") / top_pop.cast("double"))
              .withColumn("artist_bonus", F.when(F.col("_liked"), 1.0).otherwise(0.0))
              .select("user_id", "track_id", "track_name", "artist_name", "mf_score", "pop_score", "artist_bonus"))


def weighted(components: DataFrame, settings: HybridSettings, grid: Sequence[tuple[float, float, float]]) -> DataFrame:
    """The best k of each user under each weight triple (`combo`, its place in the grid), in one pass."""
    s = settings
    shares = [[w / max(sum(triple), 1e-9) for w in triple] for triple in grid]
    triples = F.array(*[F.struct(F.lit(i).alias("combo"), *[F.lit(w).alias(n) for n, w in zip(("w_mf", "w_pop", "w_artist"), own)])
                        for i, own in enumerate(shares)])
    scored = components.select("*", F.inline(triples)).withColumn(
        "recommendation_score", F.col("w_mf") * F.col("mf_score") + F.col("w_pop") * F.col("pop_score")
        + F.col("w_artist") * F.col("artist_bonus"))
    order = [F.col("recommendation_score").desc()]
    if s.popularity_breaks_ties:
        order.append(F.col("pop_score").desc())
    order.append(F.col("track_id").asc())
    return ranked(scored, ["combo", "user_id"], order, "recommendation_rank", s.k).select(
        "combo", "user_id", "recommendation_rank", "track_id", "track_name", "artist_name", "recommendation_score",
        "mf_score", "pop_score", "artist_bonus")


def recs_hybrid(hist: DataFrame, mf: DataFrame, settings: HybridSettings = HybridSettings(),
                users: DataFrame | None = None) -> DataFrame:
    """Rerank MF rows and popular tracks by MF score, popularity and artist affinity."""
    return weighted(hybrid_components(hist, mf, settings, users), settings, [settings.weights]).drop("combo")


def versioned(recs: DataFrame, model_version: str) -> DataFrame:
    return recs.select(F.lit(model_version).alias("model_version"), "*",
                       F.current_timestamp().alias("generated_at"))
