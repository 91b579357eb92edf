"""Matrix factorisation: training, block scoring and stored recommendations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.history import first_seen_names
from earshot.operators.ranking import ranked
from earshot.session import materialize

# Vectors per block: a scoring task holds one block of users, one slice of items and their score matrix.
USER_BLOCK = 512
ITEM_BLOCK = 16384


def index_ids(df: DataFrame, column: str) -> DataFrame:
    """Dense integer index of an id column in id order: the same ids give the same index."""
    ids = df.select(column).distinct()
    return materialize(ranked(ids, [], [F.col(column).asc()], "_i")
                       .select(column, (F.col("_i") - 1).cast("int").alias(f"{column}_index")))


def train_mf(weights: DataFrame, factors: int = 48, iterations: int = 8, reg: float = 0.01,
             implicit: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Factor vectors of users (user_id, vec) and tracks (track_id, vec) by alternating least squares.

    With `implicit`, unplayed pairs count as zero preference, in place of sampled negatives.
    """
    users, items = index_ids(weights, "user_id"), index_ids(weights, "track_id")
    rows = materialize(
        weights.join(users, "user_id").join(items, "track_id")
        .select("user_id_index", "track_id_index", F.col("weight").cast("float").alias("weight"))
        # A fixed order makes the result the same for the same input and seed.
        .repartition("user_id_index").sortWithinPartitions("user_id_index", "track_id_index"))
    model = ALS(rank=factors, maxIter=iterations, regParam=reg, implicitPrefs=implicit, seed=seed,
                userCol="user_id_index", itemCol="track_id_index", ratingCol="weight",
                nonnegative=False, coldStartStrategy="drop").fit(rows)

    def named(vectors: DataFrame, ids: DataFrame, column: str) -> DataFrame:
        return materialize(ids.join(vectors, F.col("id") == F.col(f"{column}_index"))
                           .select(column, F.col("features").alias("vec")))

    return named(model.userFactors, users, "user_id"), named(model.itemFactors, items, "track_id")


def _score_block(k: int):
    def score(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        users, tracks, values = [], [], []
        if len(left) and len(right):
            right = right.sort_values("track_id")
            items = right["track_id"].to_numpy(object)
            scores = (np.stack(left["user_vec"].to_list()).astype(np.float64)
                      @ np.stack(right["track_vec"].to_list()).astype(np.float64).T)
            place = {t: i for i, t in enumerate(items)}
            groups = {g: rows.to_numpy() for g, rows in pd.Series(range(len(right))).groupby(right["apart"].to_numpy(object))}
            for row, (user, least, seen, own) in enumerate(zip(left["user_id"], left["least"], left["seen"], left["apart"])):
                line = scores[row]
                if own in groups:
                    line[groups[own]] = -np.inf
                if seen is not None:
                    line[[place[t] for t in seen if t in place]] = -np.inf
                # Only scores that reach the k-th are sorted; all that equal it are among them.
                near = np.flatnonzero(line >= np.partition(line, -k)[-k]) if len(line) > k else np.arange(len(line))
                best = near[np.argsort(-line[near], kind="stable")][:k]
                best = best[np.isfinite(line[best])]
                if least is not None and least == least:
                    best = best[line[best] >= least]
                users += [user] * len(best)
                tracks += items[best].tolist()
                values += line[best].tolist()
        return pd.DataFrame({"user_id": pd.Series(users, dtype=object), "track_id": pd.Series(tracks, dtype=object),
                             "score": pd.Series(values, dtype="float64")})
    return score


def _norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(F.col(vec).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))


def norm_slices(item_vecs: DataFrame, size: int = ITEM_BLOCK) -> tuple[DataFrame, list[float]]:
    """Items (track_id, track_vec, apart, slice) in slices of about `size` by falling vector norm, and the largest norm per slice."""
    count = max(1, -(-item_vecs.count() // size))
    sliced = materialize(item_vecs.select(F.col("track_id").alias("track_id"), F.col("vec").alias("track_vec"), "apart", _norm("vec").alias("norm"))
                         .repartitionByRange(count, F.col("norm").desc(), F.col("track_id").asc())
                         .withColumn("slice", F.spark_partition_id()))
    bounds = dict(sliced.groupBy("slice").agg(F.max("norm")).collect())
    return sliced.select("track_id", "track_vec", "apart", "slice"), [bounds.get(k, 0.0) for k in range(count)]


def open_slices(users: DataFrame, bounds: list[float], low: int, high: int) -> DataFrame:
    """A row per user (with `norm`, and `least`, its k-th score so far or null) and slice from `low` to below `high` that
    can still hold a track of that score: by Cauchy-Schwarz no score exceeds the product of the norms."""
    # A few units in the last place are left for rounding; an equal score may still win by its track id.
    steps = F.split(F.lit(",".join(repr(b * (1 + 1e-9)) for b in bounds[low:high])), ",").cast("array<double>")
    slices = F.filter(F.sequence(F.lit(low), F.lit(high - 1)), lambda i: F.col("least").isNull()
                      | (F.get(steps, i - low) * F.col("norm") >= F.col("least")))
    return users.withColumn("slice", F.explode(slices))


def topk_scores(user_vecs: DataFrame, item_vecs: DataFrame, seen: DataFrame | None = None, k: int = 100,
                item_block: int | None = None, apart: str | None = None) -> DataFrame:
    """The k unseen tracks of highest dot product per user; ties go to the smaller track_id. With `apart`, a text column
    of both tables, tracks with the user's value of it count as seen, too: the pairs are never rows.

    Items are sliced by falling norm. Rounds of one, two, four ... slices follow; after each a user's k-th score is known
    and only slices whose norms can reach it are scored for this user, so most vectors are never sent to most slices. Each
    (user block, slice) pair is one cogroup that returns at most k rows per user. The tracks a user has seen travel with
    the slice they are in, so a heavy user is split too.
    """
    group = (F.lit(None).cast("string") if apart is None else F.col(apart)).alias("apart")
    items, bounds = norm_slices(item_vecs.select("track_id", "vec", group), item_block or ITEM_BLOCK)
    users = user_vecs.select(F.col("user_id").alias("user_id"), F.col("vec").alias("user_vec"), _norm("vec").alias("norm"), group)
    blocks = max(1, -(-users.count() // USER_BLOCK))
    users = users.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int"))
    best = None
    if seen is not None:
        seen = materialize(seen.select("user_id", "track_id").distinct().join(items.select("track_id", "slice"), "track_id")
                           .groupBy("user_id", "slice").agg(F.collect_list("track_id").alias("seen")))
    low, width = 0, 1
    while low < len(bounds):
        high = min(low + width, len(bounds))
        kth = best.groupBy("user_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")) if low else None
        least = users.withColumn("least", F.lit(None).cast("double")) if kth is None else users.join(kth, "user_id", "left")
        left = open_slices(least, bounds, low, high)
        left = left.withColumn("seen", F.lit(None).cast("array<string>")) if seen is None else \
            left.join(seen, ["user_id", "slice"], "left")
        right = items.filter(F.col("slice").between(low, high - 1)).withColumn(
            "ub", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        partial = (left.select("ub", "slice", "user_id", "user_vec", "least", "seen", "apart").groupBy("ub", "slice")
                   .cogroup(right.select("ub", "slice", "track_id", "track_vec", "apart").groupBy("ub", "slice"))
                   .applyInPandas(_score_block(k), "user_id string, track_id string, score double"))
        best = ranked(partial if low == 0 else best.unionByName(partial), ["user_id"],
                      [F.col("score").desc(), F.col("track_id").asc()], "recommendation_rank", k)
        low, width = high, 2 * width
        if low < len(bounds):
            best = materialize(best.drop("recommendation_rank"))
    return best.select("user_id", "recommendation_rank", "track_id", "score")


def recs_mf(user_vecs: DataFrame, item_vecs: DataFrame, hist: DataFrame, k: int = 100) -> DataFrame:
    """Named top-k rows per user without the tracks of their history."""
    return (topk_scores(user_vecs, item_vecs, hist, k).join(first_seen_names(hist), "track_id", "left")
            .select("user_id", "recommendation_rank", "track_id",
                    F.coalesce("track_name", "track_id").alias("track_name"),
                    "artist_name", F.col("score").alias("recommendation_score")))
