"""Mixing sources to target weights: sizes per source, a repetition rate each, whole copies plus one random copy.

The random copy has the fraction of the rate as its chance, for every document. To keep a source's taken words near its
target all the same, the copies of a source are spread evenly over its documents in order of size: the documents are
counted by stratum (a class of sizes within an eighth of each other, and one of 64 hash values); a stratum of n documents
after p earlier ones is due floor((p + n) f + start) - floor(p f + start) copies, where f is the fraction and start is drawn
once a source, and each of its documents draws with the chance due / n. Over the draws of start that is f. Only counts of
strata are exchanged; texts stay where they are.

Native columns only. A target above `max_rate` times its source's size stops there and the excess is shared again by
weight. That fixed point has a closed form: with sources ordered by limit / weight, the first ones stop at their limits
and the rest share what is left, so prefix sums over the table of sources give the level in one pass.

Defined cases: a null text has size 0; null is a source of its own, after all others. Repeated rows (same id) make the
same draws. A source of size 0 has target 0. Very long texts count whole; one that is most of its source is taken or left
as a whole, so its source can be off by it. Sources of equal limit per weight go by code point. An empty table gives an
empty table. Other columns are kept only if named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import bounded, whole, word_count
from earshot.session import materialize

#: A draw is this many hex digits of an md5, read as a fraction.
DIGITS = 13

#: Hash values that documents of one size class are spread over.
BUCKETS = 64


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) decided by the id and the seed alone."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16 ** DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_rate: float = 3.0) -> DataFrame:
    """`sizes` (its_source, source_size; one row per source) with weight, target and rate.

    Weights are dealt in code-point order of the sources, null last; targets add up to all sizes.
    """
    order = Window.orderBy(F.col("its_source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.select("its_source", "source_size", F.element_at(
        F.array(*[F.lit(w) for w in weights]), place + 1).cast("long").alias("weight"))
    limit = F.col("source_size") * max_rate
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("its_source").asc_nulls_last())
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_rate
    spent = F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = weighted.select(
        "*", F.row_number().over(by_limit).alias("nth"),
        ((F.sum("source_size").over(everything) - capped)
         / (F.sum("weight").over(everything) - spent)).alias("level"))
    fits = F.col("level") <= limit / F.col("weight")
    level = F.min(F.when(fits, F.struct("nth", "level"))).over(everything)["level"]
    target = leveled.select("its_source", "source_size", "weight",
                            F.least(F.col("weight") * level, limit).alias("target"))
    return target.select("*", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                         .otherwise(F.lit(0.0)).alias("rate"))


def stratum(size: Column, doc_id: Column, seed: str) -> Column:
    """Size class, then hash: classes ascend with the size, eight to each power of two."""
    bits = F.length(F.bin(size))
    leading = F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0)))
    return (bits * 16 + leading) * BUCKETS + F.floor(draw(doc_id, f"{seed}:place") * BUCKETS)


def stratum_chances(strata: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """`strata` (its_source, its_stratum, n) with source_size, target and rate, and the chance of one more copy."""
    rated = strata.join(targets.withColumnRenamed("its_source", "named_source"),
                        F.col("its_source").eqNullSafe(F.col("named_source")))
    earlier = Window.partitionBy("its_source").orderBy("its_stratum").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    fraction, start = F.col("rate") - F.floor("rate"), draw(F.col("its_source"), f"{seed}:start")
    due = F.floor((before + F.col("n")) * fraction + start) - F.floor(before * fraction + start)
    return rated.select("its_source", "its_stratum", "source_size", "target", "rate", (due / F.col("n")).alias("chance"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), max_rate: float = 3.0, seed: str = "mix",
        carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document with size, source_size, target, rate and copies, the number of times the mix emits it.

    Columns: the id, the columns of `carry`, size, source_size, target, rate, copies. `copies` is floor(rate), plus one
    if the document's draw is below the chance of its stratum.
    """
    # A generated column is computed once a row: the stratum and the join key would count the words anew at each use.
    named = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate((doc_id, *carry))],
                        F.col(source).alias("doc_source"),
                        F.inline(F.array(F.struct(word_count(whole(text)).alias("size")))))
    placed = named.withColumn("stratum", stratum(F.col("size"), F.col("carry_0"), seed))
    strata = materialize(placed.groupBy(F.col("doc_source").alias("its_source"), F.col("stratum").alias("its_stratum"))
                         .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    sizes = strata.groupBy("its_source").agg(F.sum("words").alias("source_size"))
    targets = bounded(source_targets(sizes, weights, max_rate))
    chances = bounded(stratum_chances(strata, targets, seed), F.lit(6))
    joined = placed.join(chances, F.col("doc_source").eqNullSafe(F.col("its_source"))
                         & (F.col("stratum") == F.col("its_stratum")))
    copies = F.floor("rate") + (draw(F.col("carry_0"), seed) < F.col("chance")).cast("long")
    return joined.select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate((doc_id, *carry))],
                         "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of `mix`, each as often as its copies say; `copies` gives way to `copy` (0, 1, ...)."""
    rows = mixed.where(F.col("copies") > 0)
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")) \
        .drop("copies")
