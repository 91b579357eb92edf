"""Alignment of two tokenizers by interval coalescing, and how consistently ids of one go with ids of the other.

Tokens are byte ranges over the same bytes. All tokens of both sides of a batch of documents are sorted by start
(lexsort), a running maximum of their ends is kept (maximum.accumulate), and a group breaks where a start reaches that
maximum: there a token of either side has ended. In a group, every A token is expanded to the B tokens it overlaps;
pairs of ranges that end together are links. Where a space follows other text both sides always end a token, so texts are
cut there and each distinct chunk is encoded and aligned once a worker, as long as its table has room. The id pairs of a
document are kept folded, Spark adds them up over all documents and hands the sums back to each document.

Defined cases: a text that is null, empty, or that one of the tokenizers does not give back byte for byte has no tokens:
counts 0 and an empty digest. Very long texts are encoded whole. Repeated rows (also with the same id) count as
documents of their own. Ties for the most frequent partner all are best. An empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from earshot.llm.common import id_back, id_text
from earshot.session import materialize

#: Id pairs up to which their counts are broadcast.
MOST_PAIRS = 1_000_000
#: Chunks a worker remembers (those of at most SHORT characters); the table starts anew when it is full.
REMEMBERED, SHORT = 400_000, 48
#: A space between other text and more text: what follows is encoded as if it began a text, with its space.
CUT = re.compile(r"(?<=\S) (?=.)", re.S)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from
    U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TokenBytes:
    """Bytes of every id of a vocabulary, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.all = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.all[np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - size), size)].tobytes()


class Pair:
    """Tokenizer A (byte-level, its text led by a space) and tokenizer B (pieces, which adds that space itself)."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters, added = byte_alphabet(), {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        tokens = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            tokens[i] = added[i].encode() if i in added else bytes(letters[c] for c in token)
        self.a_bytes = TokenBytes(tokens)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ids = range(self.b.get_piece_size())
        self.b_bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                   for i, p in zip(ids, map(self.b.id_to_piece, ids))])
        self.a_words = [[sign + str(i) for i in range(len(tokens))] for sign in (",", ";")]
        self.b_words = [[sign + str(i) for i in range(len(ids))] for sign in (",", "|")]
        with open(a_path, encoding="utf-8") as file:
            splitting = json.load(file)["pre_tokenizer"] or {}
        #: Whether texts can be cut: A splits words before spaces, and no piece of B goes on with a space.
        self.cuts = splitting.get("type") == "ByteLevel" and splitting.get("use_regex", True) and \
            not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in ids)
        self.known: dict[str, tuple[str, bytes, bytes] | None] = {}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for each text; none where a side's bytes are not the text's."""
        none = np.zeros(0, np.int64)
        spaced = [" " + t for t in texts]
        out = []
        for text, a, b in zip(spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False),
                              self.b.encode(texts, num_threads=1)):
            a, b, raw = np.array(a.ids, np.int64), np.array(b, np.int64), text.encode("utf-8", "surrogatepass")
            good = len(raw) > 1 and self.a_bytes.joined(a) == raw and self.b_bytes.joined(b) == raw
            out.append((a, b) if good else (none, none))
        return out


@dataclass
class Aligned:
    """Tokens of one or more documents in group order: side (0: A, 1: B), id, byte range, group and document."""

    side: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    group: np.ndarray
    doc: np.ndarray

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (of A, of B) of all pairs of tokens in a group whose byte ranges overlap."""
        a, b = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        low = np.searchsorted(self.end[b], self.start[a], "right")
        many = np.searchsorted(self.start[b], self.end[a], "left") - low
        first = np.cumsum(many) - many
        return np.repeat(a, many), b[np.arange(many.sum()) + np.repeat(low - first, many)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The overlapping pairs whose ranges end together."""
        a, b = self.overlaps()
        same = self.end[a] == self.end[b]
        return a[same], b[same]


def coalesce(documents: list[tuple[np.ndarray, np.ndarray]], a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Groups of the tokens of several documents, each given as ids of A and of B over the same bytes."""
    ids = [np.concatenate([d[k] for d in documents] or [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1)]
    size = [a_size[ids[0]], b_size[ids[1]]]
    end = [np.cumsum(s) for s in size]  # both sides have the same bytes, so documents begin alike on both
    doc = [np.repeat(np.arange(len(documents)), [len(d[k]) for d in documents]) for k in (0, 1)]
    start = np.concatenate([end[0] - size[0], end[1] - size[1]])
    end, doc, ids = np.concatenate(end), np.concatenate(doc), np.concatenate(ids)
    side = np.repeat([0, 1], [len(size[0]), len(size[1])])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.cumsum(breaks) - 1
    # Within a group A comes before B, each in its own order.
    order, group = (x[np.lexsort((start[order], side[order], group))] for x in (order, group))
    return Aligned(side[order], ids[order], start[order], end[order], group, doc[order])


def written(pair: Pair, found: Aligned) -> list[str]:
    """The word of each token in `a1,a2|b1;a3|b2,b3`, led by what separates it from the token before."""
    new = np.ones(len(found.ids), bool)
    new[1:] = (found.group[1:] != found.group[:-1]) | (found.side[1:] != found.side[:-1])
    tables = (pair.a_words, pair.b_words)
    return [tables[s][n][i] for s, n, i in zip(found.side.tolist(), new.tolist(), found.ids.tolist())]


def learned(pair: Pair, chunks: list[str]) -> dict[str, tuple[str, bytes, bytes] | None]:
    """Per chunk its groups as text, its links' id pairs and its counts (n_a, n_b, n_groups); None if it has no tokens.

    Chunks that end in text are encoded in lines of many; a line that doesn't come back is encoded by its chunks.
    """
    out: dict[str, tuple[str, bytes, bytes] | None] = {}
    joined = [c for c in chunks if len(c) <= SHORT and not c[-1].isspace()]
    alone = [c for c in chunks if len(c) > SHORT or c[-1].isspace()]
    lines = [joined[i:i + 128] for i in range(0, len(joined), 128)] + [[c] for c in alone]
    while lines:
        encoded = pair.encode([" ".join(line) for line in lines])
        good = [(line, ids) for line, ids in zip(lines, encoded) if len(ids[0])]
        out.update({line[0]: None for line, ids in zip(lines, encoded) if len(line) == 1 and not len(ids[0])})
        lines = [[c] for line, ids in zip(lines, encoded) if len(line) > 1 and not len(ids[0]) for c in line]
        if not good:
            continue
        found = coalesce([ids for _, ids in good], pair.a_bytes.size, pair.b_bytes.size)
        order = [c for line, _ in good for c in line]
        stops = np.cumsum([len(c.encode("utf-8", "surrogatepass")) + 1 for c in order])
        of, words = np.searchsorted(stops, found.end), written(pair, found)
        first, last = np.searchsorted(of, np.arange(len(order))), np.searchsorted(of, np.arange(len(order)), "right")
        a, b = found.links()
        codes, link_stop = found.ids[a] * SIDE + found.ids[b], np.searchsorted(of[a], np.arange(len(order)), "right")
        counts = np.stack([np.bincount(of[found.side == 0], minlength=len(order)),
                           np.bincount(of[found.side == 1], minlength=len(order)),
                           np.bincount(of[np.diff(found.group, prepend=-1) > 0], minlength=len(order))], 1)
        raw, counted, low, size = codes.tobytes(), counts.tobytes(), 0, 3 * counts.itemsize
        for i, (chunk, p, q, stop) in enumerate(zip(order, first.tolist(), last.tolist(), (8 * link_stop).tolist())):
            out[chunk] = ("".join(words[p:q])[1:], raw[low:stop], counted[size * i:size * (i + 1)])
            low = stop
    return out


def looked_up(pair: Pair, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Per text its groups as text, its links' id pairs and its counts."""
    split = [(CUT.split(t) if pair.cuts else [t]) if t else [] for t in texts]
    distinct = set().union(*split)
    new = distinct.difference(pair.known)
    if len(pair.known) + len(new) > REMEMBERED:
        pair.known.clear()
        new = distinct
    new = sorted(new)
    for low in range(0, len(new), 1 << 14):
        pair.known.update(learned(pair, new[low:low + (1 << 14)]))
    for chunks in split:
        parts = list(map(pair.known.__getitem__, chunks))
        if not parts or None in parts:
            yield "", np.zeros(0, np.int64), np.zeros(3, np.int64)
            continue
        groups, pairs, counts = zip(*parts)
        yield ";".join(groups), np.frombuffer(b"".join(pairs), np.int64), \
            np.frombuffer(b"".join(counts), np.int64).reshape(-1, 3).sum(0)
    for chunk in new:
        if len(chunk) > SHORT:
            del pair.known[chunk]


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


FOUND = ("doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "pairs array<long>, times array<long>")
#: A pair of ids as one number: a * SIDE + b.
SIDE = 1 << 32


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of the groups and folded id pairs of the links of each row."""
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = pair_of(a_path, b_path)
        for batch in batches:
            for low in range(0, len(batch), 500):
                part, rows = batch.iloc[low:low + 500], []
                for groups, codes, counts in looked_up(pair, [t or "" for t in part["text"]]):
                    pairs, times = np.unique(codes, return_counts=True)
                    digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                    rows.append((*counts.tolist(), len(codes), digest, pairs, times))
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    return docs.select(id_text(doc_id), F.col(text).alias("text")).mapInPandas(job, FOUND)


def pair_counts(found: DataFrame) -> DataFrame:
    """Per id pair: `count`, how many links hold it in all rows, and `best`, whether no partner of its B id has more."""
    links = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    counts = links.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("count"))
    counts = materialize(counts)
    most = counts.groupBy((F.col("pair") % SIDE).alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("pair") % SIDE == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def consistency(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
                salts: int = 64) -> DataFrame:
    """One row per input row: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The pair table has at most one row per two ids of the vocabularies; it is broadcast only if its counted rows are few.
    Otherwise the join shuffles, with each pair's row repeated over `salts` parts, as frequent pairs are in all rows.
    """
    found = materialize(aligned(docs, a_path, b_path, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    counts = materialize(pair_counts(found))
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")) \
        .select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    spread = counts
    if counts.count() > MOST_PAIRS:
        links = links.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
        spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = links.join(spread, ["pair", "salt"])
    else:
        joined = links.join(F.broadcast(spread), "pair")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return id_back(out, docs.schema[doc_id].dataType)
