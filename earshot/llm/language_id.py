"""Language ID by interpolated Kneser-Ney character models, one per language, with calibrated rejection.

All training texts are counted: each task counts the character n-grams of its texts, Spark adds the counts up. Lower
orders are continuation counts, discounts come from the counts of counts, and the interpolated probabilities are joins of
these tables; no n-gram is left out, however many there are. For scoring, the n-grams become sorted hash arrays with, per
hash, the log probability in each language and the log weight of backing off from it. The arrays come in pieces of at most
`piece_cells` cells: all languages at once if they fit, else one by one, and a language that doesn't fit by the middle two
characters of the four, which decide all that a place of a text looks up beyond the two short orders. Each piece goes over
all texts and adds its places' log probabilities, so memory is bounded and the sums are those of one whole table. A text's
score in a language is its cross-entropy, the mean over its characters.

The temperature that turns scores into a probability and the rejection level are set on texts that the counts did not
use. Rejection is a column of its own.

Defined cases: a null text or one without letters is `und` with score 0 and rejected; so is every text if nothing was
learned. Ties go to the language that sorts first. Repeated rows are predicted alike. Very long texts are read whole. An
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import bounded, id_back, id_text
from earshot.session import materialize

ORDER = 4
UNKNOWN = "und"
#: Temperatures tried, and steps of the score for the rejection level.
TEMPERATURES = tuple(0.05 * 1.35 ** i for i in range(16))
STEPS = 100
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its own number if it is a letter, else a space; made once per worker."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        alpha = [c for c in range(0x110000) if chr(c).isalpha()]
        table[alpha] = alpha
        _LETTERS.append(table)
    return _LETTERS[0]


def symbols(text: str) -> np.ndarray:
    """Lower-case letters with single spaces between runs, led by spaces for the first contexts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    if len(codes) and codes[0] == 32:
        codes = codes[1:]
    return np.concatenate([np.full(ORDER - 1, 32, np.uint32), codes, np.full(1, 32, np.uint32)[:len(codes) > 0]])


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place from ORDER - 1 on."""
    n = len(codes) - ORDER + 1
    h = np.full(n, order, np.uint64)
    wide = codes.astype(np.uint64)
    for k in range(order - 1, -1, -1):
        h = (h ^ wide[ORDER - 1 - k:ORDER - 1 - k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class SortedHashes:
    """A sorted hash array with values, and where each leading bit pattern starts."""

    keys: np.ndarray
    logs: np.ndarray
    back: np.ndarray
    bits: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.logs, self.back = self.keys[order], self.logs[order], self.back[order]
        self.bits = max(4, min(20, int(len(self.keys)).bit_length() + 1))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(self.keys, edges).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where the table lacks it."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        last = len(self.keys) - 1
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        at = np.minimum(at, last)
        behind = np.flatnonzero(self.keys[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] <= last]
            behind = behind[self.keys[at[behind]] < h[behind]]
        at = np.minimum(at, last)
        return np.where(self.keys[at] == h, at, -1)


@dataclass
class Piece:
    """Tables of all orders (index 0: single characters) for some languages, and for the places whose middle two
    characters fall to `part` of `parts`."""

    languages: list[str]
    tables: list[SortedHashes]
    floor: np.ndarray
    part: int = 0
    parts: int = 1

    def place_logs(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character in each language."""
        hashes = gram_hashes(codes, ORDER)
        at = self.tables[-1].find(hashes)
        logs = self.tables[-1].logs[at] if len(self.tables[-1].keys) else np.zeros((len(at), len(self.languages)))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            logs[missing] = self.lower(codes[missing[:, None] + np.arange(ORDER)[None, :]], ORDER - 1)
        return logs

    def lower(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Backed-off log probabilities of n-grams (right-aligned rows): their context's weight and the next order."""
        if order == 0:
            return np.repeat(self.floor[None, :], len(grams), 0)
        table = self.tables[order - 1]
        if not len(table.keys):
            return self.lower(grams, order - 1)
        context = table.find(_hash_rows(grams[:, ORDER - 1 - order:ORDER - 1], order))
        at = table.find(_hash_rows(grams[:, ORDER - order:], order))
        logs = table.logs[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            logs[missing] = self.lower(grams[missing], order - 1)
        return logs + np.where((context >= 0)[:, None], table.back[context], 0.0)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the log probabilities of each text's places in this piece, and its characters (0: no letters)."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            codes = symbols(text or "")
            n = len(codes) - ORDER + 1
            if n <= 0 or not (codes != 32).any():
                continue
            for low in range(0, n, 1 << 18):
                part = codes[low:low + (1 << 18) + ORDER - 1]
                logs = self.place_logs(part)
                if self.parts > 1:
                    logs = logs[part_of(part[1:-2], part[2:-1], self.parts) == self.part]
                total[i] += logs.sum(0)
            count[i] = n
        return total, count


def part_of(second, third, parts: int):
    """Part of a place by its middle two characters; for numbers and columns alike."""
    return (second * 31 + third) % parts


@dataclass
class Models:
    """All languages, the probability tables, how they are cut, and what calibration found."""

    languages: list[str]
    entries: DataFrame | None = None
    floors: dict[str, float] = field(default_factory=dict)
    groups: list[tuple[list[str], int]] = field(default_factory=list)
    temperature: float = 1.0
    reject_below: float = 0.0

    def pieces(self) -> Iterator[Piece]:
        """The pieces one after the other; each is all that the driver holds at a time."""
        for languages, parts in self.groups:
            mine = self.entries.where(F.col("lang").isin(languages))
            for part in range(parts):
                here = part_of(F.col("c2"), F.col("c3"), parts) == part
                first = part_of(F.col("c1"), F.col("c2"), parts) == part
                # Three characters are the end of a place and the context of another: they may be in two parts.
                rows = mine.where((F.col("size") < 3) | ((F.col("size") == 3) & (here | first)) | ((F.col("size") == 4) & here)) \
                    if parts > 1 else mine
                yield piece_of(languages, self.floors, rows.toPandas(), part, parts)


def _hash_rows(grams: np.ndarray, order: int) -> np.ndarray:
    h = np.full(len(grams), order, np.uint64)
    for k in range(order):
        h = (h ^ grams[:, k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


CODES = [f"c{k}" for k in range(1, ORDER + 1)]


def count_grams(labelled: DataFrame) -> DataFrame:
    """Rows (lang, c1 to c4, n): the code points of each n-gram of the highest order over all rows (`text`, `lang`)."""
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                codes = [symbols(t) for t in texts if t]
                codes = [c for c in codes if len(c) >= ORDER]
                if not codes:
                    continue
                hashes = np.concatenate([gram_hashes(c, ORDER) for c in codes])
                ends = np.concatenate([np.arange(len(c) - ORDER + 1) + at for c, at in zip(
                    codes, np.cumsum([0, *map(len, codes)]))])
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                grams = np.concatenate(codes)[ends[first][:, None] + np.arange(ORDER)[None, :]]
                yield pd.DataFrame(grams.astype(np.int64), columns=CODES).assign(lang=lang, n=n)

    columns = ", ".join(f"{c} int" for c in CODES)
    return labelled.select("text", "lang").mapInPandas(job, f"{columns}, lang string, n long") \
        .groupBy("lang", *CODES).agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Entries (size, lang, c1 to c4, logp, back) of all orders, and per language the log probability of a character
    never seen. `logp` is null for an n-gram that is only a context, `back` for one that is none."""
    levels = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before an n-gram
        longer = levels[size + 1]
        levels[size] = materialize(longer.groupBy("lang", *[F.col(f"c{k + 1}").alias(f"c{k}") for k in range(1, size + 1)])
                                   .agg(F.count(F.lit(1)).alias("n")))
    found, below, floors = [], None, {}
    for size in range(1, ORDER + 1):
        level, context = levels[size], ["lang", *CODES[:size - 1]]
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = F.greatest(F.lit(0.05), F.least(F.lit(0.95), ones / F.greatest(F.lit(1), ones + 2 * twos)))
        discounts = bounded(level.groupBy("lang").agg(discount.alias("discount")))
        contexts = level.groupBy(*context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")) \
            .join(discounts, "lang").withColumn("gamma", F.col("discount") * F.col("kinds") / F.col("total"))
        contexts = materialize(contexts)
        if size == 1:
            # One character more than seen shares what is left for those never seen.
            joined = level.join(contexts, "lang").withColumn("under", 1 / (F.col("kinds") + 1))
            floors = {r["lang"]: float(np.log(r["gamma"] / (r["kinds"] + 1))) for r in contexts.collect()}
        else:
            suffix = [F.col(f"c{k}").alias(f"c{k + 1}") for k in range(1, size)]
            joined = level.join(contexts, context).join(below.select("lang", *suffix, F.col("p").alias("under")),
                                                        ["lang", *CODES[1:size]])
            found[-1] = found[-1].join(contexts.select("lang", *CODES[:size - 1], F.log("gamma").alias("back")),
                                       ["lang", *CODES[:size - 1]], "full")
        share = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        below = materialize(joined.select("lang", *CODES[:size], (share + F.col("gamma") * F.col("under")).alias("p")))
        found.append(below.select("lang", *CODES[:size], F.log("p").alias("logp")))
    found[-1] = found[-1].withColumn("back", F.lit(None).cast("double"))
    every = None
    for size, rows in enumerate(found, 1):
        rest = [F.lit(None).cast("int").alias(c) for c in CODES[size:]]
        rows = rows.select(F.lit(size).alias("size"), "lang", *CODES[:size], *rest, "logp", "back")
        every = rows if every is None else every.unionByName(rows)
    return materialize(every), floors


def piece_of(languages: list[str], floors: dict[str, float], rows: pd.DataFrame, part: int = 0, parts: int = 1) -> Piece:
    """Sorted hash arrays of some entries; what a language hasn't seen is filled in by backing off."""
    piece = Piece(languages, [], np.array([floors[x] for x in languages]), part, parts)
    order = {x: k for k, x in enumerate(languages)}
    for size in range(1, ORDER + 1):
        own = rows[rows["size"] == size]
        grams = own[CODES[:size]].to_numpy(np.float64).astype(np.uint32).reshape(-1, size)
        keys, first, at = np.unique(_hash_rows(grams, size), return_index=True, return_inverse=True)
        logs, back = np.full((len(keys), len(languages)), np.nan), np.zeros((len(keys), len(languages)))
        lang = own["lang"].map(order).to_numpy(np.int64)
        logs[at, lang] = own["logp"].to_numpy(np.float64)
        back[at, lang] = own["back"].fillna(0.0).to_numpy(np.float64)
        if len(keys):
            whole = np.zeros((len(keys), ORDER), np.uint32)
            whole[:, ORDER - size:] = grams[first]
            logs = np.where(np.isnan(logs), piece.lower(whole, size - 1), logs)
        piece.tables.append(SortedHashes(keys, logs, back))
    return piece


def predict(rows: DataFrame, models: Models, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, lang_pred, score, rejected and the gap to each language's entropy."""
    carried = ", ".join(["doc_id string", "text string", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]])
    scored = rows.select(id_text("doc_id"), "text", *keep).withColumn("sums", F.array().cast("array<double>")) \
        .withColumn("letters", F.lit(0).cast("long"))

    def adder(piece: Piece, last: bool):
        def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                total, count = piece.sums(batch["text"].tolist())
                before = [np.asarray(x, float) for x in batch["sums"]]
                if piece.part:  # a further part of the same languages
                    own = len(piece.languages)
                    sums = [np.concatenate([b[:-own], b[-own:] + t]) for b, t in zip(before, total)]
                else:
                    sums = [np.concatenate([b, t]) for b, t in zip(before, total)]
                out = batch.assign(sums=sums, letters=count)
                yield out.assign(text=None) if last else out

        return job

    many = sum(parts for _, parts in models.groups)
    for k, piece in enumerate(models.pieces(), 1):
        scored = scored.mapInPandas(adder(piece, k == many), f"{carried}, sums array<double>, letters long")
        if k < many:
            scored = materialize(scored)  # one piece in a task at a time
    names = F.array(*[F.lit(x) for x in models.languages]).cast("array<string>")
    best = F.array_max("sums")
    known = (F.col("letters") > 0) & F.lit(bool(models.languages))
    gaps = F.transform("sums", lambda s: (best - s) / F.sqrt(F.greatest("letters", F.lit(1))))
    score = 1 / F.aggregate("gaps", F.lit(0.0), lambda a, g: a + F.exp(-g / F.lit(float(models.temperature))))
    found = scored.withColumn("gaps", gaps).select(
        "doc_id", *keep,
        F.when(known, F.get(names, F.array_position("sums", best).cast("int") - 1)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, score).otherwise(0.0).alias("score"),
        (~known | (score < models.reject_below)).alias("rejected"), "gaps")
    return id_back(found, rows.schema["doc_id"].dataType)


def calibrate(models: Models, labelled: DataFrame, accept: float = 0.99) -> Models:
    """Set temperature and rejection level on rows (`doc_id`, `text`, `lang`) that were not counted.

    The temperature is the likeliest of a fixed list; the level is the least score from which on at least the share
    `accept` of the predictions is right.
    """
    if not models.languages:
        return models
    seen = materialize(predict(labelled, models, ("lang",)).where(F.col("lang_pred") != UNKNOWN)
                       .select("lang", "lang_pred", "gaps"))
    names = F.array(*[F.lit(x) for x in models.languages])
    own = F.get("gaps", F.array_position(names, F.col("lang")).cast("int") - 1)

    def likelihood(t: float) -> Column:
        norm = F.log(F.aggregate("gaps", F.lit(0.0), lambda a, g: a + F.exp(-g / F.lit(t))))
        return F.sum(-own / F.lit(t) - norm)

    sums = seen.where(F.array_contains(names, F.col("lang"))).agg(
        *[likelihood(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    if sums[0] is None:
        return models
    models.temperature = TEMPERATURES[int(np.argmax([v for v in sums]))]
    score = 1 / F.aggregate("gaps", F.lit(0.0), lambda a, g: a + F.exp(-g / F.lit(models.temperature)))
    steps = seen.groupBy(F.floor(score * STEPS).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")) \
        .orderBy(F.desc("step")).collect()
    n = right = 0
    for r in steps:
        n, right = n + r["n"], right + r["right"]
        if right >= accept * n:
            models.reject_below = r["step"] / STEPS
    return models


def train(docs: DataFrame, fold: Column, piece_cells: int = 8_000_000, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang") -> Models:
    """Models from the rows of `docs` with a language: `fold` says which are counted (0), calibrate (1) or neither.

    `piece_cells` bounds what a task and the driver hold at a time (n-grams times languages of a piece, beyond the two
    short orders); it changes how often texts are read, not the result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
                       fold.alias("fold")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    entries, floors = probabilities(materialize(count_grams(rows.where("fold = 0"))))
    sizes = {r["lang"]: r["count"] for r in entries.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if sum(sizes.values()) * len(languages) <= piece_cells:
        groups = [(languages, 1)] if languages else []
    else:
        groups = [([x], -(-sizes[x] // piece_cells)) for x in languages]
    return calibrate(Models(languages, entries, floors, groups), rows.where("fold = 1"))


def held_out_languages(docs: DataFrame, piece_cells: int = 8_000_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; languages of the held-out quarter are never read."""
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    held_out = F.coalesce(part == 2, F.lit(False))
    models = train(docs, F.when(held_out, 2).when(part == 3, 1).otherwise(0), piece_cells)
    found = predict(docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
