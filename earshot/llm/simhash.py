"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits share a variant within radius/2 of each, so every fingerprint emits all variants
within radius/2 and equal variants meet. Instead of 2081 rows a fingerprint (64 bits, radius 4), the shuffle carries a
fingerprint once to each variant *prefix* its ball reaches; the task that holds a prefix spells out the variants with
that prefix, sorts them and verifies what collides. The prefix grows with the number of distinct fingerprints, so a
task holds a bounded number of them. Equal fingerprints are folded first, and a set that meets in one variant gives a
chain of links, never all its pairs. Components come from joins of links, in rounds that each end in a checkpoint.

Defined cases: a text without words (or null) has fingerprint zero, linked like any other. Repeated rows share a
fingerprint and so a component. A null id never is the smallest unless all ids of a component are null. An empty table
gives an empty table. Very long texts are shingled whole, by one task each. A bit set in exactly half the hashes is 0.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from earshot.llm.common import bounded, id_back, id_text
from earshot.session import materialize

SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bits set in over half the XXH64 hashes of the text's word shingles (A-Z lowered, ASCII spaces), unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    elif len(words) <= width:
        starts, ends = starts[:1], ends[-1:]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())),
                         np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += part.sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes))
    return int(bits.view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """`doc_id` and the signed 64-bit `fp` of each row's whole text."""
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, width) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": values.view(np.int64)})

    rows = docs.select(id_text(doc_id), F.col(text).alias("text"))
    return id_back(rows.mapInPandas(job, "doc_id string, fp long"), docs.schema[doc_id].dataType)


#: Variants a task spells out at once; it holds some 80 bytes for each.
SPELLED = 1 << 20


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks of at most `most` of the lowest `bits` bits."""
    found, last = [np.zeros(1, np.uint64)], [(0, -1)]
    for _ in range(most):
        last = [(mask | 1 << b, b) for mask, top in last for b in range(top + 1, bits)]
        found.append(np.array([m for m, _ in last], np.uint64))
    return np.concatenate(found)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def collisions(points: np.ndarray, prefix: int, prefix_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of `points` (distinct, unsigned) that meet in a variant with the given prefix and are within
    `radius`. All points of one variant are chained, so no link between them is lost."""
    half, low = radius // 2, 64 - prefix_bits
    apart = np.bitwise_count((points >> np.uint64(low)) ^ np.uint64(prefix)) if prefix_bits else \
        np.zeros(len(points), np.uint8)
    body = points & np.uint64((1 << low) - 1)
    keys, owners = [], []
    for used in range(half + 1):
        own = np.flatnonzero(apart == used)
        masks = _flips(low, half - used)
        keys.append((body[own][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    del keys, owners
    place_bits = max(1, int(len(key)).bit_length())
    packed = _mixed(key) & ~np.uint64((1 << place_bits) - 1) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    group = packed >> np.uint64(place_bits)
    equal = group[1:] == group[:-1]
    member = np.zeros(len(group), bool)
    member[1:] |= equal
    member[:-1] |= equal
    at = (packed[member] & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    at = at[np.lexsort((owner[at], key[at]))]
    same = key[at][1:] == key[at][:-1]
    a, b = owner[at][:-1][same], owner[at][1:][same]
    near = np.bitwise_count(points[a] ^ points[b]) <= radius
    pairs = np.unique(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def spelled_variants(points: np.ndarray, prefix: int, prefix_bits: int, radius: int) -> int:
    """How many variants of `points` have the prefix, counted without spelling them."""
    half, low = radius // 2, 64 - prefix_bits
    apart = np.bitwise_count((points >> np.uint64(low)) ^ np.uint64(prefix)) if prefix_bits else \
        np.zeros(len(points), np.uint8)
    return sum(int(np.count_nonzero(apart == used)) * sum(math.comb(low, k) for k in range(half - used + 1))
               for used in range(half + 1))


def ball_roots(points: np.ndarray, prefix: int, prefix_bits: int, radius: int, spelled: int = SPELLED) -> np.ndarray:
    """Smallest index of each point's component under the links that meet in a variant with the prefix.

    Where more than `spelled` variants have it, they are gone through by four further bits at a time, so memory holds
    however many points begin alike: distinct points within radius 2 of 60 leading bits are some 29 000 at most.
    """
    root = np.arange(len(points))
    waiting = [(root, prefix, prefix_bits)]
    while waiting:
        at, start, bits = waiting.pop()
        if bits < 60 and spelled_variants(points[at], start, bits, radius) > spelled:
            for wider in range(start << 4, (start << 4) + 16):
                near = np.bitwise_count((points[at] >> np.uint64(60 - bits)) ^ np.uint64(wider)) <= radius // 2
                waiting.append((at[near], wider, bits + 4))
            continue
        a, b = collisions(points[at], start, bits, radius)
        if len(a):
            moved = np.flatnonzero(root != np.arange(len(points)))
            root = _roots(len(points), np.concatenate([moved, at[a]]), np.concatenate([root[moved], at[b]]))
    return root


def ball_links(distinct: DataFrame, radius: int = 4, per_prefix: int = 2048, most: int = 1 << 18) -> DataFrame:
    """Links between distinct `fp` values: in each prefix task the fingerprints of a component point at its smallest.

    The prefix has about one value per `per_prefix` fingerprints and grows until no task gets more than `most`, or to 40
    bits; a task spells out a bounded number of variants at once, whatever it gets (`ball_roots`).
    """
    if radius not in (0, 2, 4):
        raise ValueError("the radius is 0, 2 or 4: all that meets in a variant is then within it")
    count = distinct.count()
    bits = min(40, max(4, math.ceil(math.log2(max(1, count) / per_prefix)) if count else 4))
    while True:
        masks = F.array(*[F.lit(int(m)) for m in _flips(bits, radius // 2)])
        reached = distinct.select("fp", F.explode(F.transform(
            masks, lambda m: F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(m.cast("long")))).alias("prefix"))
        top = reached.groupBy("prefix").count().agg(F.max("count")).first()[0] or 0
        if top <= most or bits >= 40:
            break
        bits += 2

    def job(key, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(rows["fp"].to_numpy(np.int64).view(np.uint64))
        root = ball_roots(points, int(key[0]), bits, radius)
        moved = np.flatnonzero(root != np.arange(len(points)))
        return pd.DataFrame({"a": points[moved].view(np.int64), "b": points[root[moved]].view(np.int64)})

    return reached.groupBy("prefix").applyInPandas(job, "a long, b long").distinct()


def connect(links: DataFrame, rounds: int = 60) -> DataFrame:
    """`node`, `root` for every node of the links (a, b): the smallest node of its component.

    Large-star and small-star steps in turn, until the links no longer change: each node ends as a leaf of its root.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())

    state = mark(edges)
    for _ in range(rounds if state[0] else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("x"), "m", "u"))
        edges = materialize(small.select(F.col("x").alias("u"), F.col("m").alias("v"))
                            .union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = mark(edges)
        if new == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = new
    if state[0]:
        raise RuntimeError("links did not settle; raise `rounds`")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def smallest_of_root(rooted: DataFrame, value: str, name: str, large: int = 1000) -> DataFrame:
    """Rows with the smallest `value` of their `root`. Roots of more than `large` rows, of which there are few, are
    looked up apart, so that no task gets all rows of a root."""
    rooted = materialize(rooted)
    sizes = materialize(rooted.groupBy("root").agg(F.min(value).alias(name), F.count(F.lit(1)).alias("members")))
    found = rooted.join(bounded(sizes.where(F.col("members") > large).select("root", name)), "root", "left")
    rest = found.where(F.col(name).isNull()).drop(name)
    few = sizes.where(F.col("members") <= large).select("root", name)
    return found.where(F.col(name).isNotNull()).unionByName(rest.join(few, "root", "left"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4,
                    radius: int = 4) -> DataFrame:
    """One row per input row: `doc_id`, `fp` (signed) and `component_id`, the smallest id reachable over links."""
    marked = materialize(fingerprints(docs, doc_id, text, width))
    first = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connect(ball_links(first.select("fp"), radius))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = smallest_of_root(rooted, "first_id", "component_id")
    classes = materialize(named.select(F.col("fp").alias("class_fp"), "component_id"))
    return marked.join(classes, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")
