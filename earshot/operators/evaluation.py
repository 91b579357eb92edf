"""Temporal holdout and recommendation quality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import UNKNOWN_ARTIST, blank_to_null, readable
from earshot.operators.hybrid import HybridSettings, hybrid_components, recs_popularity, top_pop_pool, weighted
from earshot.operators.popularity import count_rows
from earshot.operators.ranking import ranked
from earshot.operators.slices import slice_events_by_users
from earshot.session import materialize, small

METRICS = ("source", "users_evaluated", "users_with_recs", "user_coverage", "precision_at_k", "recall_at_k",
           "ndcg_at_k", "hit_rate_at_k", "item_coverage_at_k", "personalization_at_k", "readable_rate_at_k")
# Users per block when list overlaps are counted: a task holds two blocks and their pair matrix.
BLOCK = 1024


def _newest() -> list[Column]:
    return [F.col("event_ts").desc(), F.col("event_id").desc()]


def holdout_split(ready: DataFrame, users: DataFrame, holdout: int = 5, min_events: int = 20,
                  n: int | None = None) -> DataFrame:
    """Every event of the users with its rank from the newest, and the side it falls on."""
    events = slice_events_by_users(ready, users, n)
    sizes = events.groupBy("user_id").agg(count_rows().alias("user_events")).filter(F.col("user_events") >= min_events)
    return (ranked(events.join(small(sizes, n), "user_id"), ["user_id"], _newest(), "rn_desc")
            .withColumn("split", F.when(F.col("rn_desc") <= holdout, "test").otherwise("train"))
            .select("user_id", "track_id", "track_name", "artist_name", "rn_desc", "user_events", "split"))


@dataclass
class Holdout:
    """train: user_id, track_id, plays, names; test: user_id, track_id; tracks: the catalog size."""

    train: DataFrame
    test: DataFrame
    total_tracks: Column


def novel_truth(held: DataFrame, train: DataFrame) -> DataFrame:
    """Held-out tracks the user had not played before."""
    return (held.select("user_id", "track_id").distinct()
            .join(train.select("user_id", "track_id"), ["user_id", "track_id"], "left_anti"))


def _two_sided(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only users with both training and test tracks."""
    both = train.select("user_id").distinct().join(test.select("user_id").distinct(), "user_id", "left_semi")
    return train.join(both, "user_id", "left_semi"), test.join(both, "user_id", "left_semi")


def candidate_restrict(train: DataFrame, test: DataFrame, n: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep the n most played training tracks on both sides, then drop users left one-sided."""
    top = top_pop_pool(train.groupBy("track_id").agg(F.sum("plays").alias("plays")), n).select("track_id")
    kept = small(top, n)
    return (*_two_sided(train.join(kept, "track_id", "left_semi"), test.join(kept, "track_id", "left_semi")), top)


def build_holdout(ready: DataFrame, users: DataFrame, holdout: int = 5, min_events: int = 20, target: str = "novel",
                  candidate_top_n: int = 0, n: int | None = None) -> Holdout:
    """Split each user's events at the newest `holdout`.

    The boundary is each user's holdout-th newest (time, id), found with a group limit that
    prunes before the shuffle; events are then compared with it, so no user is ranked in full.
    """
    events = materialize(
        slice_events_by_users(ready, users, n).select("user_id", "track_id", "track_name", "artist_name",
                                                      "event_ts", "event_id"))
    edge = (ranked(events.select("user_id", "event_ts", "event_id"), ["user_id"], _newest(), "_r", holdout)
            .groupBy("user_id").agg(F.min(F.struct("event_ts", "event_id")).alias("_edge")))
    sizes = (events.groupBy("user_id").agg(count_rows().alias("_n")).filter(F.col("_n") >= min_events)
             .join(edge, "user_id"))
    kept = events.join(small(sizes, n), "user_id").withColumn(
        "_held", F.struct("event_ts", "event_id") >= F.col("_edge"))
    # The names of a track are those of its first user's newest event.
    newest = kept.groupBy("track_id", "user_id").agg(
        F.max_by(F.struct("track_name", "artist_name"), F.struct("event_ts", "event_id")).alias("m"))
    names = newest.groupBy("track_id").agg(F.min_by("m", "user_id").alias("m")).select(
        "track_id", F.coalesce(blank_to_null(F.col("m.track_name")), "track_id").alias("track_name"),
        F.coalesce(blank_to_null(F.col("m.artist_name")), F.lit(UNKNOWN_ARTIST)).alias("artist_name"))
    train = materialize(kept.filter("NOT _held").groupBy("user_id", "track_id").agg(count_rows().alias("plays")))
    held = kept.filter("_held").select("user_id", "track_id").distinct()
    train, test = _two_sided(train, materialize(novel_truth(held, train) if target == "novel" else held))
    if candidate_top_n > 0:
        train, test, top = candidate_restrict(train, test, candidate_top_n)
        total = top.agg(count_rows().alias("n")).scalar()
    else:
        total = slice_events_by_users(ready, users, n).agg(F.countDistinct("track_id").alias("n")).scalar()
    return Holdout(materialize(train.join(names, "track_id")), materialize(test), total)


def _picks(recs: DataFrame, train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """Per source the first k distinct recommendations that are new to each test user."""
    fresh = (recs.join(test.select("user_id").distinct(), "user_id", "left_semi")
             .join(train.select("user_id", "track_id"), ["user_id", "track_id"], "left_anti")
             .groupBy("source", "user_id", "track_id")
             .agg(F.min_by(F.struct("recommendation_rank", "track_name", "artist_name"), "recommendation_rank").alias("r"))
             .select("source", "user_id", "track_id", "r.*"))
    return ranked(fresh, ["source", "user_id"], [F.col("recommendation_rank").asc(), F.col("track_id").asc()], "pick", k)


def _block_overlap():
    """Sum of Jaccard similarities over the user pairs of two blocks, from one bit per (list, track).

    A closure, so tasks get it by value and need no copy of this package.
    """
    def overlap(keys: tuple, block: pd.DataFrame) -> pd.DataFrame:
        source, left, right = keys
        column, _ = pd.factorize(np.concatenate(block["tracks"].to_list()))
        size = block["tracks"].map(len).to_numpy()
        row = np.repeat(np.arange(len(block)), size)
        bits = np.zeros((len(block), int(column.max()) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
        first = np.flatnonzero(block["side"] == "L")
        second = np.flatnonzero(block["side"] == "R") if left != right else first
        users, total = block["users"].to_numpy(np.float64), 0.0
        for at, one in enumerate(first):
            other = second[at + 1:] if left == right else second
            shared = np.bitwise_count(bits[one] & bits[other]).sum(1, dtype=np.int64)
            total += users[one] * float((shared / np.maximum(size[one] + size[other] - shared, 1) * users[other]).sum())
        return pd.DataFrame({"source": [source], "similarity": [total]})
    return overlap


def pairwise_similarity(picks: DataFrame) -> DataFrame:
    """One row per source: users with recommendations and the summed Jaccard similarity of all their pairs.

    Equal lists are folded to one with a count. Lists are then cut into blocks and each pair of
    blocks is one task that returns a single number, so user pairs are never rows.
    """
    picks = picks if "source" in picks.columns else picks.withColumn("source", F.lit(""))
    lists = picks.groupBy("source", "user_id").agg(F.array_sort(F.collect_list("track_id")).alias("tracks"))
    folded = materialize(lists.groupBy("source", "tracks").agg(count_rows().alias("users"))
                         .withColumn("user_no", F.xxhash64("tracks")))
    sizes = small(folded.groupBy("source").agg(F.ceil(count_rows() / BLOCK).cast("int").alias("blocks")), 1000)
    placed = folded.join(sizes, "source").withColumn("b", F.pmod("user_no", F.col("blocks")).cast("int"))
    left = placed.withColumn("other", F.explode(F.sequence(F.col("b"), F.col("blocks") - 1))).select(
        "source", F.col("b").alias("i"), F.col("other").alias("j"), F.lit("L").alias("side"), "tracks", "users")
    right = placed.filter(F.col("b") > 0).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select(
        "source", F.col("other").alias("i"), F.col("b").alias("j"), F.lit("R").alias("side"), "tracks", "users")
    across = (left.unionByName(right).groupBy("source", "i", "j")
              .applyInPandas(_block_overlap(), "source string, similarity double"))
    own = folded.select("source", (F.col("users") * (F.col("users") - 1) / 2).cast("double").alias("similarity"))
    total = across.unionByName(own).groupBy("source").agg(F.sum("similarity").alias("similarity"))
    # A row per source.
    return total.join(small(folded.groupBy("source").agg(F.sum("users").alias("users_with_recs")), 1000), "source")


def _ideal(size: Column, k: int) -> Column:
    best = F.sequence(F.lit(1), F.least(size, F.lit(k)).cast("int"))
    return F.aggregate(best, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1.0)))


def evaluate_sources(recs: DataFrame, sources: Sequence[str], train: DataFrame, test: DataFrame, total_tracks: Column,
                     k: int = 20) -> DataFrame:
    """One row of quality metrics per source, all in one pass. recs: source, user_id, recommendation_rank, track_id,
    names; a source of `sources` without rows has its row, too."""
    picks = materialize(_picks(recs, train, test, k))
    truth = test.select("user_id", "track_id").distinct()
    hits = (picks.join(truth, ["user_id", "track_id"], "left_semi").groupBy("source", "user_id")
            .agg(count_rows().alias("hits"), F.sum(F.lit(1.0) / F.log2(F.col("pick") + 1.0)).alias("dcg")))
    every = F.explode(F.array(*[F.lit(x) for x in sources])).alias("source")
    per_user = (truth.groupBy("user_id").agg(count_rows().alias("size")).select("*", every)
                .join(hits, ["source", "user_id"], "left")
                .withColumn("hits", F.coalesce("hits", F.lit(0)))
                .withColumn("dcg", F.coalesce("dcg", F.lit(0.0))))
    evaluated = per_user.groupBy("source").agg(
        count_rows().alias("users_evaluated"),
        F.avg(F.col("hits") / F.lit(float(k))).alias("precision_at_k"),
        F.avg(F.col("hits") / F.col("size")).alias("recall_at_k"),
        F.avg(F.col("dcg") / _ideal(F.col("size"), k)).alias("ndcg_at_k"),
        F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate_at_k"))
    is_readable = readable(F.col("track_name"), F.col("artist_name"), F.col("track_id")).cast("double")
    served = picks.groupBy("source").agg(F.countDistinct("track_id").alias("_items"), F.avg(is_readable).alias("_readable"))
    labels = recs.sparkSession.range(1).select(every)
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    n = F.coalesce("users_with_recs", none)
    n_rows = len(sources)
    return (labels.join(small(evaluated, n_rows), "source", "left").join(small(served, n_rows), "source", "left")
            .join(small(pairwise_similarity(picks), n_rows), "source", "left")
            .withColumn("users_evaluated", F.coalesce("users_evaluated", none))
            .select("source", "users_evaluated", n.alias("users_with_recs"),
                    (n / F.greatest("users_evaluated", F.lit(1))).alias("user_coverage"),
                    *[F.coalesce(m, zero).alias(m) for m in ("precision_at_k", "recall_at_k", "ndcg_at_k", "hit_rate_at_k")],
                    (F.coalesce("_items", none) / F.greatest(total_tracks, F.lit(1))).alias("item_coverage_at_k"),
                    F.when(n > 1, 1 - F.coalesce("similarity", zero) / (n * (n - 1) / 2)).otherwise(zero)
                    .alias("personalization_at_k"),
                    F.coalesce("_readable", zero).alias("readable_rate_at_k")))


def evaluate_recs(source: str, recs: DataFrame, train: DataFrame, test: DataFrame, total_tracks: Column,
                  k: int = 20) -> DataFrame:
    """One row of quality metrics. recs: user_id, recommendation_rank, track_id, names."""
    named = recs.withColumn("source", F.lit(source))
    return evaluate_sources(named, [source], train, test, total_tracks, k)


def best_weights(grid: DataFrame) -> DataFrame:
    """The best row by (ndcg, hit rate, precision); the earlier combination wins ties."""
    return grid.orderBy(F.col("ndcg_at_k").desc(), F.col("hit_rate_at_k").desc(),
                        F.col("precision_at_k").desc(), F.col("combo").asc()).limit(1)


def temporal_eval(ready: DataFrame, users: DataFrame, sources: Sequence[str] = ("pop", "mf", "hybrid", "dense"),
                  k: int = 20, holdout: int = 5, min_events: int = 20, target: str = "novel",
                  candidate_top_n: int = 0, mf: DataFrame | None = None, dense: DataFrame | None = None,
                  grid: Sequence[tuple[float, float, float]] | None = None, factors: int = 48,
                  iterations: int = 4) -> DataFrame:
    """Metrics per source, and of a grid of hybrid weights those of the best. `mf` evaluates stored rows; without it
    factors are trained on the split.

    All sources and weight triples are ranked and evaluated together, so the number of jobs doesn't depend on them.
    Nothing is cut before played tracks are left out: popular and hybrid rows have none, so k of them are enough, and
    of stored rows all ranks are read.
    """
    split = build_holdout(ready, users, holdout, min_events, target, candidate_top_n)
    test_users = split.test.select("user_id").distinct()
    if mf is None and {"mf", "hybrid"} & set(sources):
        from earshot.operators.factors import recs_mf, train_mf
        from earshot.operators.history import interaction_weights

        user_vecs, item_vecs = train_mf(interaction_weights(split.train), factors, iterations)
        mf = materialize(recs_mf(user_vecs, item_vecs, split.train, max(5 * k, 200)))
    rows, labels, trials = [], [], []

    def add(recs: DataFrame, source: Column) -> None:
        rows.append(recs.select(source.alias("source"), "user_id", "recommendation_rank", "track_id", "track_name",
                                "artist_name"))

    if "pop" in sources:
        add(recs_popularity(split.train, test_users, k), F.lit("pop"))
        labels.append("pop")
    if "mf" in sources:
        add(mf, F.lit("mf"))
        labels.append("mf")
    if "hybrid" in sources:
        wanted = split.train.select("track_id").distinct()
        allowed = mf if candidate_top_n <= 0 else mf.join(wanted, "track_id", "left_semi")
        settings = HybridSettings.evaluation(k)
        triples = [tuple(w) for w in grid or [settings.weights]]
        trials = ["hybrid(w={:.2f},{:.2f},{:.2f})".format(*w) for w in triples]
        parts = weighted(hybrid_components(split.train, allowed, settings, test_users), settings, triples)
        add(parts, F.get(F.array(*[F.lit(f"{i}:{x}") for i, x in enumerate(trials)]), F.col("combo")))
        labels += [f"{i}:{x}" for i, x in enumerate(trials)]
    if "dense" in sources and dense is not None:
        add(dense, F.lit("dense"))
        labels.append("dense")
    recs = rows[0]
    for more in rows[1:]:
        recs = recs.unionByName(more)
    out = materialize(evaluate_sources(recs, labels, split.train, split.test, split.total_tracks, k))
    combo = F.regexp_extract("source", r"^(\d+):", 1)
    tried = out.filter(combo != "").withColumn("combo", combo.cast("int")).withColumn(
        "source", F.regexp_replace("source", r"^\d+:", ""))
    out = out.filter(combo == "").select(*METRICS)
    return out.unionByName(best_weights(tried).select(*METRICS)) if trials else out
