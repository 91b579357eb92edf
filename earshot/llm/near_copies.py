"""Near copies by Jaccard likeness of five-word shingles: SimHash balls and MinHash bands retrieve, the exact likeness of
each pair decides.

A text is the set of its shingle hashes; equal sets are folded first. A set has a SimHash fingerprint, and fingerprints
within four bits are found by ball hashing (module `simhash`). Copies of likeness 0.8 mostly differ in more bits, so a set
also has `bands` keys of `rows` least hashes each, and sets that share a key are candidates: at a likeness of 0.8 one of
24 keys of 5 is shared but for 7 in 100 000 pairs.

Rows of all keys are sorted over tasks by key, so a key with most of the sets is dealt over many tasks. Under a key, the
sets that share most keys with others come first; each set is tried with the first one, which all copies of an original
have in common, and with the `reach` sets before it: all pairs up to reach + 2 sets. What that leaves apart under a
larger key is compared whole: all sets of the key that aren't in its largest component are met with all others of the
key (of all keys with this component at once), in blocks of bounded size, and a block returns the links of its components only. So no pair that shares a key
and is alike enough ends in two components, and a large group of copies costs time in proportion to its size.

Defined cases: texts without words (or null) are copies of each other; fewer than five words are one shingle. Repeated
rows share a component. A null id never is the smallest unless all ids of a component are null. Very long texts are
compared whole. Ties of likeness need no order: components do not depend on it. An empty table gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from earshot.llm.common import bounded, id_back, id_text, whole
from earshot.llm.fingerprints import shingles
from earshot.llm.simhash import _roots, ball_links, connect, smallest_of_root
from earshot.session import materialize

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles (A-Z lowered, ASCII spaces)."""
    return np.unique(shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), width))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band: the least hashes of its `rows` permutations, mixed."""
    rng = np.random.default_rng(7)
    factor = rng.integers(0, 1 << 63, bands * rows, np.uint64) << np.uint64(1) | np.uint64(1)
    shift = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for low in range(0, len(hashes), 2048):
        part = (hashes[low:low + 2048][None, :] ^ shift[:, None]) * factor[:, None]
        np.minimum(least, part.min(1), out=least)
    key = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(29)
    return key


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: bits set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def _marked(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, node (the set's hash), size, fingerprint and band keys of each row."""
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "text_key": batch["text_key"],
                "node": np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64),
                "size": np.array([len(s) for s in sets], np.int64),
                "fp": np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64),
                "keys": [band_keys(s, bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]})

    named = docs.select(id_text(doc_id), F.col(text).alias("text"), F.xxhash64(whole(text)).alias("text_key"))
    marked = named.mapInPandas(job, "doc_id string, text_key long, node long, size long, fp long, keys array<long>")
    return id_back(marked, docs.schema[doc_id].dataType)


def _candidates(sets: DataFrame, least: float, reach: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a key and whose sizes allow the likeness."""
    keyed = sets.select("node", "size", F.explode("keys").alias("key"))
    large = bounded(keyed.groupBy("key").count().where(F.col("count") > reach + 2))
    weight = keyed.join(large, "key").groupBy("node").agg(F.sum("count").alias("weight"))
    ranked = sets.join(weight, "node", "left").select(
        "node", "size", (-F.coalesce("weight", F.lit(0))).alias("rank"), F.explode("keys").alias("key"))
    order = ["key", "rank", "node"]
    ordered = materialize(ranked.repartitionByRange(*order).sortWithinPartitions(*order))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The task's first key, and of its last key the first row and the last `reach` rows."""
        begin, head, tail = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            begin = int(batch["key"].iloc[0]) if begin is None else begin
            own = batch[batch["key"] == batch["key"].iloc[-1]]
            more = head is not None and head[0] == own["key"].iloc[0]
            tail = pd.concat([tail, own]).tail(reach) if more else own.tail(reach)
            head = head if more else tuple(int(own[c].iloc[0]) for c in ("key", "node", "size"))
        if head:
            yield pd.DataFrame([(TaskContext.get().partitionId(), begin, *head, tail["node"].tolist(),
                                 tail["size"].tolist())],
                               columns=["part", "begin", "key", "node", "size", "nodes", "sizes"])

    carried, last = {}, None
    for r in sorted(ordered.mapInPandas(ends, "part int, begin long, key long, node long, size long, "
                                              "nodes array<long>, sizes array<long>").collect()):
        goes_on = last is not None and last[0] == r["begin"]
        if goes_on:
            carried[r["part"]] = last
        tail = list(zip(r["nodes"], r["sizes"]))
        if goes_on and r["key"] == r["begin"]:
            last = (r["key"], last[1], (last[2] + tail)[-reach:])
        else:
            last = (r["key"], (r["node"], r["size"]), tail)

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = carried.get(TaskContext.get().partitionId())
        for batch in batches:
            if not len(batch):
                continue
            key, node, size = (batch[c].to_numpy(np.int64) for c in ("key", "node", "size"))
            # What came before under the first key: its first row and its last rows.
            lead = state is not None and state[0] == key[0]
            before = [state[1], *state[2]] if lead else []
            key = np.concatenate([np.full(len(before), key[0]), key])
            node = np.concatenate([np.array([n for n, _ in before], np.int64), node])
            size = np.concatenate([np.array([s for _, s in before], np.int64), size])
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(start)[np.cumsum(start) - 1]
            found = [(first, np.arange(len(key)))]
            for k in range(1, reach + 1):
                at = np.flatnonzero(key[k:] == key[:-k])
                found.append((at, at + k))
            a, b = (np.concatenate(x) for x in zip(*found))
            may = (node[a] != node[b]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-6)
            a, b = node[a[may]], node[b[may]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
            own = int(first[-1])
            from_ = max(own, len(key) - reach)
            state = (int(key[-1]), (int(node[own]), int(size[own])),
                     list(zip(node[from_:].tolist(), size[from_:].tolist())))

    return ordered.mapInPandas(job, "a long, b long").distinct()


def _ball_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints the ball hashing links, or that share one."""
    first = materialize(sets.groupBy("fp").agg(F.min("node").alias("a")))
    shared = sets.join(first, "fp").select("a", F.col("node").alias("b")).where("a <> b")
    near = ball_links(first.select("fp"))
    ends = near.join(first.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a") \
        .join(first.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    return shared.union(ends.select(F.least("x", "y"), F.greatest("x", "y")))


#: Hashes that a block compares at once, and 64-bit words of packed bits.
AT_ONCE = 1 << 18


def _packed(owner: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """A row of bits per set: which of the hashes that several sets share it has."""
    _, column, many = np.unique(values, return_inverse=True, return_counts=True)
    shared = many > 1
    place = np.cumsum(shared) - 1
    used = shared[column]
    packed = np.zeros((count, int(shared.sum()) // 64 + 1), np.uint64)
    at = place[column[used]]
    np.bitwise_or.at(packed, (owner[used], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return packed


def _in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share. Hashes are taken by value, one range after the other, so memory is bounded
    however long the texts are."""
    both = np.zeros((len(sets), len(sets)), np.int64)
    pieces = -(-sum(map(len, sets)) // AT_ONCE)
    edges = [(1 << 64) * k // pieces for k in range(1, pieces)]
    cuts = [np.concatenate([[0], np.searchsorted(s, np.array(edges, np.uint64)), [len(s)]]).astype(np.int64) for s in sets]
    for k in range(pieces):
        part = [s[c[k]:c[k + 1]] for s, c in zip(sets, cuts)]
        owner = np.repeat(np.arange(len(sets)), [len(p) for p in part])
        packed = _packed(owner, np.concatenate(part), len(sets))
        step = max(1, AT_ONCE // (packed.shape[1] * len(sets)))
        width = max(1, AT_ONCE // (step * len(sets)))
        for low in range(0, len(sets), step):
            for left in range(0, packed.shape[1], width):
                words = packed[:, left:left + width]
                both[low:low + step] += np.bitwise_count(words[low:low + step, None, :] & words[None, :, :]).sum(2, dtype=np.int64)
    return both


def block_links(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (places) that join the components of sets of likeness `least` or more: exact, by packed bits of the
    hashes that several sets share."""
    size = np.array([len(s) for s in sets], np.int64)
    both = _in_common(sets)
    alike = both >= least * (size[:, None] + size[None, :] - both)
    alike &= component[:, None] != component[None, :]
    a, b = np.nonzero(np.triu(alike, 1))
    # One link per component joined: of a spanning forest over the components in the block.
    names, of = np.unique(component, return_inverse=True)
    root, links = _roots(len(names), of[a], of[b]), []
    top = np.arange(len(names))

    def at(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    joins = int((root != np.arange(len(names))).sum())
    for x, y in zip(a.tolist(), b.tolist()):
        if len(links) == joins:
            break
        p, q = at(of[x]), at(of[y])
        if p != q:
            top[max(p, q)] = min(p, q)
            links.append((x, y))
    return links


def _left_apart(sets: DataFrame, roots: DataFrame, bodies_of, least: float, width: int, reach: int, block: int) -> DataFrame:
    """Links (a, b) between components under keys of more than reach + 2 sets, from whole comparisons in blocks."""
    keyed = sets.select("node", F.explode("keys").alias("key"))
    large = bounded(keyed.groupBy("key").count().where(F.col("count") > reach + 2))
    members = materialize(keyed.join(large.select("key"), "key").join(roots, "node", "left")
                          .select("key", "node", F.coalesce("root", "node").alias("component")))
    per = members.groupBy("key", "component").count()
    keys = per.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"),
                                  F.max("count").alias("in_main"), F.sum("count").alias("all")) \
        .where(F.col("all") > F.col("in_main"))
    # Keys with one main component are compared together: their sets are sent once, not once a key.
    told = materialize(members.join(bounded(keys.select("key", "main")), "key")
                       .select(F.col("main").alias("key"), "node", "component").distinct()
                       .withColumn("rest", F.col("component") != F.col("key")))
    parts = bounded(told.groupBy("key").agg(
        F.ceil(F.count_if(~F.col("rest")) / block).cast("int").alias("main_parts"),
        F.ceil(F.count_if("rest") / block).cast("int").alias("rest_parts")))
    told = told.join(parts, "key")
    count = F.when(F.col("rest"), F.col("rest_parts")).otherwise(F.col("main_parts"))
    told = told.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), count).cast("int"))
    others = F.sequence(F.lit(0), F.col("rest_parts") - 1)
    mains = F.sequence(F.lit(0), F.col("main_parts") - 1)

    def cell(kind: str, i, j):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    part = F.col("part")
    cells = F.when(F.col("rest"), F.concat(
        F.transform(others, lambda j: cell("rest", F.least(part, j), F.greatest(part, j))),
        F.transform(mains, lambda j: cell("main", part, j)))).otherwise(F.transform(others, lambda i: cell("main", i, part)))
    placed = told.select("node", "component", "key", F.explode(cells).alias("cell")).select("node", "component", "key", "cell.*")
    rows = placed.join(bodies_of(placed.select("node").distinct()), "node")

    def job(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in rows["body"]]
        node = rows["node"].to_numpy(np.int64)
        links = block_links(node, rows["component"].to_numpy(np.int64), sets, least)
        return pd.DataFrame([(node[x], node[y]) for x, y in links], columns=["a", "b"], dtype=np.int64)

    return rows.groupBy("key", "kind", "i", "j").applyInPandas(job, "a long, b long").distinct()


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, width: int = 5,
                 bands: int = 24, rows: int = 5, reach: int = 3, block: int = 256) -> DataFrame:
    """One row per input row: `doc_id`, `text_key` (hash of the whole text), `root` (the same for all of a component) and
    `component_id`, the smallest id reachable over pairs of `least` likeness."""
    marked = materialize(_marked(docs, doc_id, text, width, bands, rows))
    sets = materialize(marked.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("size").alias("size"),
        F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    pairs = materialize(_candidates(sets.select("node", "size", "keys"), least, reach)
                        .union(_ball_pairs(sets.select("node", "fp"))).distinct())

    def bodies_of(nodes: DataFrame) -> DataFrame:
        wanted = sets.join(nodes, "node", "left_semi").select("node", "text_key")
        return materialize(docs.select(F.xxhash64(whole(text)).alias("text_key"), F.col(text).alias("body"))
                           .join(wanted, "text_key").groupBy("node").agg(F.first("body").alias("body")))

    bodies = bodies_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}

            def own(node: int, body: str) -> np.ndarray:
                if node not in known:
                    known[node] = shingle_set(body, width)
                return known[node]

            good = [likeness(own(a, x), own(b, y)) >= least for a, b, x, y in zip(
                batch["a"], batch["b"], batch["a_body"], batch["b_body"])]
            yield batch.loc[good, ["a", "b"]]

    links = materialize(pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("a_body")), "a")
                        .join(bodies.select(F.col("node").alias("b"), F.col("body").alias("b_body")), "b")
                        .mapInPandas(job, "a long, b long"))
    roots = connect(links)
    more = materialize(_left_apart(sets, roots, bodies_of, least, width, reach, block))
    if not more.isEmpty():
        roots = connect(links.union(more))
    rooted = sets.select("node", "first_id").join(roots, "node", "left") \
        .select("node", "first_id", F.coalesce("root", "node").alias("root"))
    named = smallest_of_root(rooted, "first_id", "component_id")
    classes = materialize(named.select(F.col("node").alias("class_node"), "root", "component_id"))
    return marked.join(classes, F.col("node") == F.col("class_node")).select("doc_id", "text_key", "root", "component_id")


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: `doc_id` and `component_id`; options as of `near_classes`."""
    return near_classes(docs, **options).select("doc_id", "component_id")
