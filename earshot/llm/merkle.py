"""Merkle manifest of a dataset: a digest per row, a tree per group, a root over the groups, and each row's witness.

Rows are numbered within their group over all tasks, and aligned blocks of fan ** levels rows are folded apart. Inside a
block rows are appended one by one: an open subtree attaches partial witnesses to its members, and each sibling that
completes a run extends them by one step. The blocks' roots are appended in the same way in the next round, until a
group has one node, and the groups' roots last. Witnesses then go back down: a block joins the one witness of its root.
No task holds more than a block, and the driver holds no digest.

A node's digest is the lowercase hex sha256 of its run's digests as hex text. While several nodes remain, each run of
`fan` (the last may have fewer, even one) becomes one node; a lone node stays as it is.

Defined cases: a null value is `-` in its row's digest; null groups form one tree, which comes first. Null order keys
come first in their tree. Ties of the order key go by digest; repeated rows are leaves of their own. An empty text has
count 0. Very long texts are hashed whole. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import bounded
from earshot.operators.ranking import ranked
from earshot.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as UTF-8 byte count, colon, text; `-` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
             for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(digest: str, witness: str) -> str:
    """The root that a leaf and its witness give. A step of the witness is `left,right;`, the run's other digests."""
    for step in witness.split(";")[:-1]:
        left, _, right = step.partition(",")
        digest = sha256(left + digest + right)
    return digest


def height(size: int, fan: int = 8) -> int:
    """Steps from a leaf to the root of a tree of `size` leaves."""
    steps = 0
    while size > 1:
        size, steps = -(-size // fan), steps + 1
    return steps


class OpenSubtrees:
    """Nodes appended from left to right; a run that fills up closes, which extends the witness of all below it."""

    def __init__(self, fan: int = 8, witnesses: bool = True):
        self.fan, self.witnesses = fan, witnesses
        self.open: list[list[tuple[str, int]]] = [[]]
        self.partial: list[str] = []

    def append(self, digest: str) -> None:
        self.partial.append("")
        self._push(0, digest, len(self.partial) - 1)

    def _push(self, level: int, digest: str, first: int) -> None:
        while len(self.open) <= level:
            self.open.append([])
        self.open[level].append((digest, first))
        if len(self.open[level]) == self.fan:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        if self.witnesses:
            # Nodes of a level are contiguous, so a node's members end where the next one's begin.
            stops = [first for _, first in run[1:]] + [self._end(level)]
            for k, ((_, first), stop) in enumerate(zip(run, stops)):
                step = f"{''.join(digests[:k])},{''.join(digests[k + 1:])};"
                for i in range(first, stop):
                    self.partial[i] += step
        self._push(level + 1, sha256("".join(digests)), run[0][1])

    def _end(self, level: int) -> int:
        """Where the members of the last run of a level end: at the first node still open below it."""
        below = [nodes[0][1] for nodes in self.open[:level] if nodes]
        return min(below, default=len(self.partial))

    def close(self, levels: int) -> str:
        """Close what is open on the lowest `levels` levels; the digest of the one node above."""
        for level in range(levels):
            if self.open[level]:
                self._close(level)
        return self.open[levels][0][0]


def _grown(rows: pd.DataFrame, fan: int, levels: int, witnesses: bool) -> tuple[str, list[str]]:
    """Root of a block and the witnesses of its rows, which are in order."""
    tree = OpenSubtrees(fan, witnesses)
    for digest in rows["digest"]:
        tree.append(digest)
    return tree.close(min(levels, height(int(rows["size"].iloc[0]), fan))), tree.partial


def climb(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """Rounds of nodes (tree, pos, size, digest): the given ones, their blocks' roots, and so on to one node a tree."""
    block = fan ** levels

    def job(key, rows: pd.DataFrame) -> pd.DataFrame:
        root, _ = _grown(rows.sort_values("pos"), fan, levels, False)
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "size": [-(-int(rows["size"].iloc[0]) // block)],
                             "digest": [root]})

    rounds, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        last = rounds[-1].select("tree", F.expr(f"pos div {block}").alias("block"), "pos", "size", "digest")
        rounds.append(materialize(last.groupBy("tree", "block").applyInPandas(
            job, "tree string, pos long, size long, digest string")))
        most = -(-most // block)
    return rounds


def extend(nodes: DataFrame, above: DataFrame, fan: int, levels: int, emit: Callable, schema: str) -> DataFrame:
    """What `emit(rows, witnesses, parent)` makes of each block's rows, their whole witnesses and the parent's row."""
    def job(rows: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        _, own = _grown(rows, fan, levels, True)
        parent = parents.iloc[0]
        return emit(rows, [w + parent["witness"] for w in own], parent)

    blocks = nodes.withColumn("block", F.expr(f"pos div {fan ** levels}"))
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "pos")).applyInPandas(job, schema)


def descend(rounds: list[DataFrame], above: DataFrame, fan: int, levels: int) -> DataFrame:
    """Witnesses (tree, pos, witness, subroot, root) of the second round's nodes, from those of the last round's."""
    def emit(rows: pd.DataFrame, witnesses: list[str], parent) -> pd.DataFrame:
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "witness": witnesses,
                             "subroot": parent["subroot"], "root": parent["root"]})

    for nodes in rounds[-2:0:-1]:
        above = extend(nodes, above, fan, levels, emit, "tree string, pos long, witness string, subroot string, root string")
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", order: str = "doc_id",
             altered: dict[str, Column] | None = None, fan: int = 8, levels: int = 3,
             witness: bool = False) -> DataFrame:
    """One row per input row: `order`, leaf, subroot, root, proof_sha256, folded_root, verified, and on wish the witness.

    `altered` replaces fields before the rows are checked against their witnesses: folded_root is what the altered row
    and its stored witness give, and verified says whether that is the root.
    """
    now = {f: F.col(f) for f in fields} | (altered or {})
    leaves = materialize(docs.select(
        F.col(order).alias("key"),
        F.when(F.col(tree).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(tree).cast("string"))).alias("tree"),
        row_digest([F.col(f) for f in fields]).alias("digest"), row_digest([now[f] for f in fields]).alias("found"),
        F.monotonically_increasing_id().alias("row")))
    sizes = bounded(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("size")))
    placed = ranked(leaves, ["tree"], [F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")], "nth")
    nodes = materialize(placed.join(sizes, "tree").select(
        "tree", (F.col("nth") - 1).alias("pos"), "size", "digest", "found", F.col("key").cast("string").alias("key")))
    rounds = climb(nodes, fan, levels)

    tops = rounds[-1].select(F.col("tree").alias("name"), "digest")
    count = tops.count()
    groups = materialize(ranked(tops, [], [F.col("name")], "nth").select(
        F.lit("").alias("tree"), (F.col("nth") - 1).alias("pos"), F.lit(count).cast("long").alias("size"), "digest", "name"))
    over = climb(groups.drop("name"), fan, levels)
    start = over[-1].select("tree", "pos", F.lit("").alias("witness"), F.lit("").alias("subroot"), F.col("digest").alias("root"))

    def top(rows: pd.DataFrame, witnesses: list[str], parent) -> pd.DataFrame:
        return pd.DataFrame({"tree": rows["name"], "pos": 0, "witness": witnesses, "subroot": rows["digest"],
                             "root": parent["root"]})

    parents = "tree string, pos long, witness string, subroot string, root string"
    if len(over) > 1:
        above = extend(groups, descend(over, start, fan, levels), fan, levels, top, parents)
    else:
        above = groups.select(F.col("name").alias("tree"), "pos", F.lit("").alias("witness"), F.col("digest").alias("subroot"),
                              F.col("digest").alias("root"))

    def bottom(rows: pd.DataFrame, witnesses: list[str], parent) -> pd.DataFrame:
        folded = [fold(d, w) for d, w in zip(rows["found"], witnesses)]
        out = pd.DataFrame({"key": rows["key"], "leaf": rows["digest"], "subroot": parent["subroot"], "root": parent["root"],
                            "proof_sha256": [sha256(w.replace(",", "").replace(";", "")) for w in witnesses],
                            "folded_root": folded, "verified": [f == parent["root"] for f in folded]})
        return out.assign(witness=witnesses) if witness else out

    schema = ("key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean" + (", witness string" if witness else ""))
    # Trees of a single leaf have no round above them: the leaf is its own block's root.
    found = extend(nodes, descend(rounds, above, fan, levels) if len(rounds) > 1 else above, fan, levels, bottom, schema)
    return found.select(F.col("key").cast(docs.schema[order].dataType).alias(order),
                        *[c for c in found.columns if c != "key"])


def lowered_thirds(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z lowered where 3 divides the CRC-32 of the decimal id, as a planted tampering."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col(doc_id).cast("string")) % 3 == 0
    return F.when(hit, F.translate(text, letters, letters.lower())).otherwise(F.col(text))
