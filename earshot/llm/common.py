"""Columns and helpers the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_text(column: str) -> Column:
    """An id as text: pandas would turn whole numbers beside nulls into floating ones."""
    return F.col(column).cast("string").alias("doc_id")


def id_back(df: DataFrame, kind) -> DataFrame:
    """The table with its text ids in their own type again."""
    return df.withColumn("doc_id", F.col("doc_id").cast(kind))


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once a row, also where lambdas inside the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hash of each window of `width` words; fewer words give one hash of all, none gives no hash."""
    count = F.size(words)
    full = F.transform(F.sequence(F.lit(0), count - width),
                       lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return (F.when(count >= width, full)
            .when(count > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast("array<bigint>")))


def bounded(df: DataFrame, weight: Column | None = None, limit: int = 1_000_000) -> DataFrame:
    """The table computed once, with a broadcast hint only if its counted cells are within `limit`; beyond it
    the join shuffles. `weight` counts the cells of a row (1 if not given)."""
    kept = materialize(df)
    cells = kept.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(kept) if cells <= limit else kept


def literal_array(values: list, kind: str) -> Column:
    """A constant array of integers, built as one literal however long it is."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bisect(below, n: int) -> Column:
    """How many of n ordered bounds are below a row, where `below(i)` says so of bound i (true ones come first)."""
    zero = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        open_ = acc["lo"] < acc["hi"]
        up = open_ & below(mid)
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(open_ & ~up, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length() + 1))), zero, step)["lo"]


def spread_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, limit: int = 200_000) -> DataFrame:
    """Rows of `left` with the one row of `right` for their `key` (left join), also where one key has most of the rows.

    `right` is broadcast only if its counted rows are within `limit`. Beyond it its rows are repeated over `salts`
    parts, and the rows of a key are dealt over these by their place in the input.
    """
    kept = materialize(right)
    if kept.count() <= limit:
        return left.join(F.broadcast(kept), key, "left")
    salted = left.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    parts = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(parts, [key, "salt"], "left").drop("salt")
