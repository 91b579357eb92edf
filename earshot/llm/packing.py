"""Cost-balanced packing of tokenised documents into training sequences.

A document of n ids costs n * linear + n^2 * quadratic (attention). Whole sequences are cut from long documents first.
The remainders are dealt into groups of bounded size; in a group, descending remainders go to the lowest-cost sequence
with room for all of it. A group opens as few sequences as its ids need; when no sequence has room, the remainder is
cut over the emptiest ones, so padding stays below one sequence a group.

Tokenising splits a text at ASCII white space, which the tokenizer's own splitting never crosses; ids of a chunk are
kept in a bounded table per worker, so frequent chunks are looked up. Ids travel once, packed in bytes.

Defined cases: a null or empty text is the end id alone. Repeated rows (also with the same id) are packed as documents of
their own. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from earshot.llm.common import id_back, id_text

#: Chunks and word pieces whose ids a worker remembers; a table starts anew when it is full.
REMEMBERED = 1_000_000
#: Characters whose lower case and normal form are plain: chunks of these alone are split into word pieces here.
PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
ALL_PLAIN = re.compile(PLAIN.pattern.replace("[", r"[\n", 1))
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ChunkIds:
    """Ids of chunks between white space as bytes, learned from the tokenizer and remembered.

    `whole` says that the tokenizer looks across white space, so that texts must be encoded in one. If its file splits
    words by a pattern and marks their ends, pieces common to many chunks are encoded once, in long lines.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.whole = self._direct(["a b\nc"])[0] != b"".join(self._direct(["a", "b", "c"]))
        splits = [x for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        suffix = rules["model"].get("end_of_word_suffix")
        self.pattern = None
        if suffix and len(splits) == 1 and splits[0]["behavior"] == "Removed" and splits[0]["invert"]:
            self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
            self.line_pattern = regex.compile("\\n|" + splits[0]["pattern"]["Regex"])
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        added = [t["content"] for t in rules.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, distinct: set[str]) -> None:
        """Remember pieces that are not known yet; all of `distinct` are known afterwards."""
        new = distinct.difference(self.pieces)
        if len(self.pieces) + len(new) > REMEMBERED:
            self.pieces.clear()
            new = distinct
        pieces = list(new)
        for low in range(0, len(pieces), 2048):
            part = pieces[low:low + 2048]
            lines = [" ".join(part[i:i + 64]) for i in range(0, len(part), 64)]
            ids = np.frombuffer(b"".join(self._direct(lines)), self.width)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or (len(cuts) and cuts[-1] != len(ids)):
                self.pieces.update(zip(part, self._direct(part)))
                continue
            raw, size = ids.tobytes(), ids.itemsize
            stops = (cuts * size).tolist()
            self.pieces.update(zip(part, (raw[a:b] for a, b in zip([0, *stops], stops))))

    def learn(self, chunks: list[str]) -> None:
        """Remember chunks that are not known yet."""
        plain = []
        if self.pattern:
            lines = "\n".join(chunks)
            if ALL_PLAIN.fullmatch(lines) and not self.added.search(lines):
                plain = chunks
            else:
                plain = [c for c in chunks if PLAIN.fullmatch(c) and not self.added.search(c)]
        if plain:
            # One search over all chunks; a line end marks where the pieces of a chunk stop.
            found = self.line_pattern.findall("\n".join(plain).lower() + "\n")
            distinct = set(found)
            distinct.discard("\n")
            self._learn_pieces(distinct)
            look, at, encoded = self.pieces, 0, []
            for _ in plain:
                stop = found.index("\n", at)
                encoded.append(look[found[at]] if stop == at + 1 else b"".join([look[p] for p in found[at:stop]]))
                at = stop + 1
            self.chunks.update(zip(plain, encoded))
        rest = chunks if not plain else [] if len(plain) == len(chunks) else list(set(chunks).difference(plain))
        if rest:
            self.chunks.update(zip(rest, self._direct(rest)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.whole:
            return [np.frombuffer(b, self.width) for b in self._direct(texts)]
        split = [_ascii_split(t) for t in texts]
        distinct = set().union(*split)
        new = distinct.difference(self.chunks)
        if len(self.chunks) + len(new) > REMEMBERED:
            self.chunks.clear()
            new = distinct
        new = list(new)
        for low in range(0, len(new), REMEMBERED // 4):
            self.learn(new[low:low + REMEMBERED // 4])
        look = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(look, chunks)), self.width) for chunks in split]


_TABLES: dict[str, ChunkIds] = {}


def chunk_table(path: str) -> ChunkIds:
    if path not in _TABLES:
        _TABLES[path] = ChunkIds(path)
    return _TABLES[path]


#: White space that str.split() knows beyond ASCII's six.
OTHER_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200b)), "\u2028",
               "\u2029", "\u202f", "\u205f", "\u3000")


def _ascii_split(text: str) -> list[str]:
    """Chunks between ASCII white space."""
    if any(c in text for c in (OTHER_SPACE[:4] if text.isascii() else OTHER_SPACE)):
        return [c.decode("utf-8", "surrogatepass") for c in text.encode("utf-8", "surrogatepass").split()]
    return text.split()


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def place(lengths: np.ndarray, size: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple]:
    """Pieces (item, start, length, sequence, offset) of items shorter than `size`, packed by cost."""
    total = int(lengths.sum())
    opened = -(-total // size)
    cost, room = np.zeros(opened), np.full(opened, size)
    pieces = []

    def put(item: int, start: int, length: int, at: int) -> None:
        pieces.append((item, start, length, at, int(size - room[at])))
        room[at] -= length
        cost[at] += linear * length + quadratic * length * length

    for item in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[item])
        while left:
            at = int(np.argmin(np.where(room >= left, cost, np.inf)))
            if room[at] >= left:
                put(item, start, left, at)
                break
            at = int(np.argmax(room))
            part = int(room[at])
            put(item, start, part, at)
            start, left = start + part, left - part
    return pieces


def tokenised(docs: DataFrame, tokenizer_path: str, groups: int, doc_id: str = "doc_id", text: str = "text",
              size: int = 2048, end_id: int = 1) -> DataFrame:
    """Rows (deal, doc_id, start, length, doc_tokens, crc, ids): whole sequences without ids, remainders with them.

    `deal` is the group; documents of a task are dealt in turn, from a place that the task's first document decides.
    """
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, turn = chunk_table(tokenizer_path), None
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for low in range(0, len(texts), 256):
                rows = []
                part = texts[low:low + 256]
                if turn is None:
                    turn = zlib.crc32(part[0].encode("utf-8", "surrogatepass"))
                for i, ids in enumerate(table.encode(part)):
                    ids = np.append(ids, np.array([end_id], ids.dtype))
                    n, key = len(ids), batch["doc_id"].iloc[low + i]
                    deal, turn = turn % groups, turn + 1
                    for at in range(0, n - size + 1, size):
                        rows.append((deal, key, at, size, n, crc32(ids[at:at + size]), None))
                    if n % size:
                        rest = ids[n - n % size:]
                        rows.append((deal, key, n - len(rest), len(rest), n, None, rest.astype("<u4").tobytes()
                                     if ids.dtype.itemsize == 4 else rest.tobytes()))
                yield pd.DataFrame(rows, columns=["deal", "doc_id", "start", "length", "doc_tokens", "crc", "ids"])

    return docs.select(id_text(doc_id), F.col(text).alias("text")).mapInPandas(
        job, "deal long, doc_id string, start long, length long, doc_tokens long, crc long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048,
         end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, group_chars: int = 4 << 20,
         group_rows: int = 1 << 14) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `group_chars` and `group_rows` are about how many characters and documents share a group, and bound what a task holds,
    also of very many empty texts.
    """
    chars, rows = docs.agg(F.sum(F.char_length(text)), F.count(F.lit(1))).first()
    groups = max(1, -(-(chars or 0) // group_chars), -(-rows // group_rows))

    def job(key, rows: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) << 32
        rows = rows.sort_values(["doc_id", "start", "doc_tokens"], kind="stable").reset_index(drop=True)
        full = rows["ids"].isna()
        done = rows[full].assign(sequence_id=base + np.arange(full.sum()), offset=0)
        rest = rows[~full].reset_index(drop=True)
        width = {2: "<u2", 4: "<u4"}
        ids = [np.frombuffer(b, width[len(b) // n]) for b, n in zip(rest["ids"], rest["length"])]
        pieces = place(rest["length"].to_numpy(np.int64), size, linear, quadratic)
        at = np.array([p[:1] + p[1:] for p in pieces], np.int64).reshape(-1, 5)
        cut = pd.DataFrame({
            "doc_id": rest["doc_id"].to_numpy()[at[:, 0]], "start": rest["start"].to_numpy()[at[:, 0]] + at[:, 1],
            "length": at[:, 2], "crc": [crc32(ids[i][s:s + n]) for i, s, n in at[:, :3].tolist()],
            "doc_tokens": rest["doc_tokens"].to_numpy()[at[:, 0]], "sequence_id": base + int(full.sum()) + at[:, 3],
            "offset": at[:, 4]})
        return pd.concat([done, cut]).rename(columns={"crc": "ids_crc32"})[
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    pieces = tokenised(docs, tokenizer_path, groups, doc_id, text, size, end_id).groupBy("deal").applyInPandas(job, PIECES)
    return id_back(pieces, docs.schema[doc_id].dataType)
