"""Sharding by histogram sort: shards of near-equal bytes, cut at exact positions, then one exchange.

The sort key is the text's hash, then the id's hash, so equal texts are neighbours. Each round splits the key range
around every unsettled boundary into equal probes and counts the exact bytes and rows below them in all partitions; a
boundary settles when a probe is within its tolerance, and narrows to the probe that holds it otherwise. A boundary is
put between two texts if that is within the tolerance and goes into a group of equal texts only if the group is larger.
Shards are cut into slices by the same rounds, so that many tasks number the rows of one shard; the counts below a
slice are its offset. Only counts per probe reach the driver: rounds need at most slices x probes of them.

Defined cases: a null text has size 1 and is a group of its own beside the empty text. Rows that repeat both text and
id can't be told apart by the key: no boundary goes between them. An empty table gives an empty table. Very long
texts count whole and may fill a shard by themselves. Other columns are kept only if named.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.llm.common import bisect, literal_array
from earshot.session import materialize

TOP = (1 << 63) - 1

#: Rows one task numbers, about.
SLICE_ROWS = 4_000_000


@dataclass
class Boundary:
    """Where a slice starts: a target number of bytes below it, and the key range that still holds it."""

    target: float
    tolerance: float
    lo: int = 0
    hi: int = TOP
    text_key: int | None = None  # set once the range is one text and its ids are searched
    below: tuple[int, int] = (0, 0)  # bytes and rows below `lo`
    key: tuple[int, int] | None = None  # settled

    def settle(self, at: int, below: tuple[int, int]) -> None:
        self.key = (at, 0) if self.text_key is None else (self.text_key, at)
        self.below = below


def sort_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two non-negative numbers: the text's hash and the id's."""
    known = F.when(text.isNull(), F.lit(0)).otherwise(F.lit(1))
    return (F.shiftrightunsigned(F.xxhash64(text, known), 1).alias("k1"),
            F.shiftrightunsigned(F.xxhash64(doc_id), 1).alias("k2"))


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _count(keys: DataFrame, ranges: list[tuple[int | None, int, int]], probes: int) -> dict:
    """For each range (text key or None, lo, hi): its probes in order as (bytes, rows, least key, largest key)."""
    found = {r: [] for r in ranges}
    for on_ids in (False, True):
        part = sorted(r for r in ranges if (r[0] is not None) == on_ids)
        if not part:
            continue
        lows = literal_array([r[0] if on_ids else r[1] for r in part], "bigint")
        column = F.col("k1")
        n = len(part)
        place = bisect(lambda i: F.get(lows, i) <= column, n) - 1
        inside = keys.select("*", place.alias("place")).where("place >= 0")
        if on_ids:
            # Several ranges of one text can't be told apart by the text alone: take its last range that starts below.
            same = [(r[0], r[1]) for r in part]
            a, b = literal_array([x for x, _ in same], "bigint"), literal_array([y for _, y in same], "bigint")
            inside = keys.select("*", (bisect(lambda i: (F.get(a, i) < F.col("k1")) | (
                (F.get(a, i) == F.col("k1")) & (F.get(b, i) <= F.col("k2"))), n) - 1).alias("place")) \
                .where("place >= 0").where(F.get(a, F.col("place")) == F.col("k1"))
            column = F.col("k2")
        lo = F.get(literal_array([r[1] for r in part], "bigint"), F.col("place"))
        hi = F.get(literal_array([r[2] for r in part], "bigint"), F.col("place"))
        step = F.get(literal_array([(r[2] - r[1]) // probes + 1 for r in part], "bigint"), F.col("place"))
        counted = (inside.select("place", "size", column.alias("k"), lo.alias("lo"), hi.alias("hi"), step.alias("step"))
                   .where("k >= lo AND k <= hi")
                   .groupBy("place", F.expr("(k - lo) div step").alias("probe"))
                   .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("k").alias("least"),
                        F.max("k").alias("largest")).collect())
        for r in sorted(counted, key=lambda r: (r["place"], r["probe"])):
            found[part[r["place"]]].append((r["bytes"], r["rows"], r["least"], r["largest"]))
    return found


def boundaries(keys: DataFrame, shards: int, slices: int, tolerance: float = 0.005, probes: int = 64) -> list[Boundary]:
    """Starts of all slices but the first, for a table of k1, k2, size. Every `slices`-th starts a shard."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = shards * slices
    share = total / parts
    marks = [Boundary(share * i, share * slices * tolerance if i % slices == 0 else share * 0.2)
             for i in range(1, parts)]
    while any(m.key is None for m in marks):
        waiting = [m for m in marks if m.key is None]
        found = _count(keys, list({(m.text_key, m.lo, m.hi) for m in waiting}), probes)
        for m in waiting:
            size, rows = m.below
            cells = found[(m.text_key, m.lo, m.hi)]
            for n, (more, count, least, largest) in enumerate(cells):
                if size + more >= m.target or n == len(cells) - 1:
                    before, after = m.target - size, size + more - m.target
                    close = min(before, abs(after)) <= m.tolerance
                    if close or (least == largest and m.text_key is not None):
                        m.settle(*((least, (size, rows)) if before <= after
                                   else (largest + 1, (size + more, rows + count))))
                    elif least == largest:
                        m.text_key, m.lo, m.hi, m.below = least, 0, TOP, (size, rows)
                    else:
                        m.lo, m.hi, m.below = least, largest, (size, rows)
                    break
                size, rows = size + more, rows + count
            else:
                m.settle(m.lo, m.below)
    # Two boundaries within one tolerance may settle in either order; a slice between them is then empty.
    order = sorted((m.key, m.below) for m in marks)
    for m, (key, below) in zip(marks, order):
        m.key, m.below = key, below
    return marks


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", slices: int | None = None,
          tolerance: float = 0.005, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document with its shard and its slot there.

    Columns: the id, the columns of `carry`, size, text_crc32, shard, slot (0, 1, ... in key order within the shard).
    A shard is numbered in `slices` tasks; their default number follows the rows.
    """
    named = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate((doc_id, *carry))],
                        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
                        byte_size(F.col(text)).alias("size"), *sort_key(F.col(doc_id), F.col(text)))
    keys = materialize(named.select("k1", "k2", "size"))
    slices = slices or max(32, math.ceil(keys.count() / (shards * SLICE_ROWS)))
    marks = boundaries(keys, shards, slices, tolerance)
    first = literal_array([m.key[0] for m in marks], "bigint")
    second = literal_array([m.key[1] for m in marks], "bigint")
    place = bisect(lambda i: (F.get(first, i) < F.col("k1")) | (
        (F.get(first, i) == F.col("k1")) & (F.get(second, i) <= F.col("k2"))), len(marks))
    rows_below = [0, *(m.below[1] for m in marks)]
    offsets = literal_array([rows_below[i] - rows_below[i // slices * slices] for i in range(shards * slices)], "bigint")
    order = Window.partitionBy("slice").orderBy("k1", "k2", "carry_0")
    placed = named.select("*", place.alias("slice"))
    return placed.select(
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate((doc_id, *carry))], "size", "text_crc32",
        F.floor(F.col("slice") / slices).cast("int").alias("shard"),
        (F.get(offsets, F.col("slice")) + F.row_number().over(order) - 1).alias("slot"))
