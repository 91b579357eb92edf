"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits.

A text's word shingles are hashed once; the top bits of a hash name its bin and a bin keeps its least hash. An empty bin
takes the value of a filled bin that hashing of (bin, attempt) finds, alike for all texts. The low `bits` bits of each
bin are packed. Two fingerprints that agree in a share p of their bins have the likeness (p - 2^-bits) / (1 - 2^-bits):
the correction for bins that agree by chance.

`with_next` fingerprints each document, the text that an edit makes of it with the next document, and compares them. The
documents are dealt into ranges of ids, each about `slice_chars` long, and each range gets one more row: the first
document of the range that follows. So the texts are exchanged once, and a task streams through its sorted rows.

Defined cases: a null text is empty; fewer than five words are one shingle; a text without words has no bins, an
all-zero fingerprint, likeness 1 to another such text and 0 to others. Repeated rows and ids follow one another in the
order of their texts. A null id comes last. A single document is its own next one. An empty table gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from earshot.llm.common import bisect, id_back, id_text, literal_array, whole
from earshot.session import materialize

SHINGLE = 5
#: Ranges of ids at most, so that their bounds fit in one literal; beyond it ranges get longer and tasks still stream.
MOST_SLICES = 1 << 16


def shingles(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles; fewer words give one, none gives none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.fromiter((xxh64_intdigest(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist())),
                       np.uint64, len(starts))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Fingerprints of `bins` (a power of two) bins with `bits` (1, 2, 4 or 8) bits each."""

    def __init__(self, bins: int = 256, bits: int = 4):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins is a power of two, bits one of 1, 2, 4, 8")
        self.bins, self.bits = bins, bits
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.edges = np.arange(bins, dtype=np.uint64) << self.shift

    def _donor(self, empty: np.ndarray, attempt: int) -> np.ndarray:
        return (_spread(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1))
                % np.uint64(self.bins)).astype(np.int64)

    def sketch(self, hashes: np.ndarray) -> np.ndarray | None:
        """Low-order bits of each bin's least hash; None without hashes."""
        if not len(hashes):
            return None
        ordered = np.sort(hashes)
        at = np.searchsorted(ordered, self.edges)
        least = ordered[np.minimum(at, len(ordered) - 1)]
        filled = (at < len(ordered)) & ((least >> self.shift) == np.arange(self.bins, dtype=np.uint64))
        empty, attempt = np.flatnonzero(~filled), 0
        source = np.arange(self.bins)
        while len(empty):
            donor = self._donor(empty, attempt)
            good = filled[donor]
            source[empty[good]] = donor[good]
            empty, attempt = empty[~good], attempt + 1
        # The bins' own order shows in a hash's top bits only; the low bits of a mixed hash are even.
        return (_spread(least[source]) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def packed(self, sketch: np.ndarray | None) -> str:
        if sketch is None:
            return "0" * (self.bins * self.bits // 4)
        spread = np.unpackbits(sketch[:, None], axis=1)[:, 8 - self.bits:]
        return np.packbits(spread.ravel()).tobytes().hex()

    def unpacked(self, fingerprint: str) -> np.ndarray:
        raw = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(-1, self.bits)
        return np.packbits(np.pad(raw, ((0, 0), (8 - self.bits, 0))), axis=1).ravel()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Jaccard estimate with the chance agreement taken out, between 0 and 1."""
        if a is None or b is None:
            return float(a is None and b is None)
        chance = 0.5 ** self.bits
        return float(max(0.0, (np.mean(a == b) - chance) / (1 - chance)))


class _Document:
    """A text with what its own and its neighbour's fingerprint need."""

    def __init__(self, doc_id, text: str | None, sketcher: Sketcher):
        self.doc_id, self.text = doc_id, text or ""
        self.words = self.text.encode("utf-8", "surrogatepass").split()
        self.hashes = shingles(self.words)
        self.sketch = sketcher.sketch(self.hashes)


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edited_hashes(own: _Document, following: _Document) -> np.ndarray:
    """Shingle hashes of the edited text; only those across the seam are hashed, the others are known."""
    half = len(own.text) // 2
    kept = own.text[:len(own.text) - half].encode("utf-8", "surrogatepass")
    taken = following.text[:half].encode("utf-8", "surrogatepass")
    kept_words, taken_words = kept.split(), taken.split()
    head, tail = len(kept_words), len(taken_words)
    # Words that are surely whole: all but the last kept one, and all but the first and the last taken one.
    left, right = max(0, head - 1), max(0, tail - 2)
    if left < 2 * SHINGLE or right < 2 * SHINGLE:
        return shingles((kept + taken).split())
    seam = own.words[left - SHINGLE + 1:left]
    middle, first, last = kept_words[-1], taken_words[0], taken_words[-1]
    between = [middle, first] if kept[-1:].isspace() or taken[:1].isspace() else [middle + first]
    body = [*seam, *between, *following.words[1:SHINGLE]]
    ending = [*following.words[tail - SHINGLE:tail - 1], last]
    return np.concatenate([own.hashes[:left - SHINGLE + 1], shingles(body),
                           following.hashes[1:tail - SHINGLE], shingles(ending)])


def _slices(docs: DataFrame, doc_id: str, text: str, slice_chars: int) -> tuple[list[int], Column]:
    """Lower bounds of the id ranges but the first, and the range of a row (0: the smallest ids)."""
    total, low, high = docs.agg(F.sum(F.char_length(text)), F.min(doc_id), F.max(doc_id)).first()
    count = min(MOST_SLICES, max(1, -(-(total or 0) // slice_chars)))
    if count == 1 or low == high:
        return [], F.lit(0)
    marks = docs.agg(F.percentile_approx(doc_id, [i / count for i in range(1, count)], max(10_000, 4 * count))).first()[0]
    bounds = sorted(set(marks) - {low})
    listed = literal_array(bounds, "bigint")
    return bounds, F.when(F.col("key").isNull(), F.lit(0)).otherwise(
        bisect(lambda i: F.get(listed, i) <= F.col("key"), len(bounds)))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bins: int = 256, bits: int = 4,
              slice_chars: int = 2 << 20) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ids are whole numbers; the next document is the one with the next smaller id, the first one's after the last.
    """
    _, place = _slices(docs, doc_id, text, slice_chars)
    order = F.xxhash64("body")
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), whole(text).alias("body")) \
        .select("key", "body", place.alias("slice"))
    # The first row of a range (largest id, then text) follows the last row of the next higher range that has rows.
    heads = rows.groupBy("slice").agg(F.max(F.struct(
        F.col("key").isNotNull().alias("known"), "key", order.alias("hash"))).alias("head"))
    ring = Window.orderBy(F.col("slice").desc())
    around = Window.partitionBy()
    receivers = materialize(heads.select("head", F.coalesce(
        F.lag("slice").over(ring), F.min("slice").over(around)).alias("receiver")))
    # At most MOST_SLICES rows, so the texts aren't shuffled to find them.
    extra = (rows.withColumn("hash", order).join(F.broadcast(receivers.select(
        F.col("head.key").alias("head_key"), F.col("head.hash").alias("head_hash"), "receiver")),
        F.col("key").eqNullSafe(F.col("head_key")) & (F.col("hash") == F.col("head_hash")))
        .select("key", "body", F.col("receiver").alias("slice"), F.lit(True).alias("copied")))
    dealt = rows.withColumn("copied", F.lit(False)).unionByName(extra) \
        .repartition("slice").sortWithinPartitions(F.col("slice").desc(), "copied", F.col("key").desc_nulls_last(),
                                                   F.xxhash64("body").desc()) \
        .select(id_text("key"), "body", "slice", "copied")

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher, before, place_before = Sketcher(bins, bits), None, None
        for batch in batches:
            out = []
            for key, body, at, copied in zip(batch["doc_id"], batch["body"], batch["slice"], batch["copied"]):
                document = _Document(key, body, sketcher)
                if before is not None and place_before == at:
                    changed = sketcher.sketch(edited_hashes(before, document))
                    edited = edited_text(before.text, document.text)
                    out.append((before.doc_id, len(before.text),
                                hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                sketcher.packed(before.sketch), sketcher.packed(changed),
                                sketcher.likeness(before.sketch, changed),
                                sketcher.likeness(before.sketch, document.sketch)))
                before, place_before = (None if copied else document), at
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint",
                                             "edited_fingerprint", "near_edited", "near_next"])

    return id_back(dealt.mapInPandas(job, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, "
                                          "edited_fingerprint string, near_edited double, near_next double"), "long")
