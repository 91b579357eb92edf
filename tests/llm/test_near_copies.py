"""Near copies under hot keys, and what the pipeline's stages do with odd rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from earshot.llm import near_copies
from tests.llm.test_text_operators import cases, prose


def changed(words, rng, places, tag):
    out = list(words)
    for i in rng.choice(len(words), places, replace=False):
        out[i] = f"{tag}{rng.integers(0, 1 << 40)}"
    return out


def plain_components(sets, least=0.8):
    """Smallest place of each place's component, over all pairs."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    bits = np.zeros((len(sets), len(values)), np.float32)
    bits[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column] = 1
    both, size = bits @ bits.T, np.array([len(s) for s in sets])
    root = list(range(len(sets)))
    for a, b in zip(*np.nonzero(both >= least * (size[:, None] + size[None, :] - both))):
        low, high = sorted((root[a], root[b]))
        if low != high:
            root = [low if r == high else r for r in root]
    return root


def test_pairs_under_a_hot_key_are_all_found(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 400)]
    texts = []
    for _ in range(400):  # originals unlike each other that share keys, each with a copy
        original = changed(base, rng, 11, "o")
        texts += [" ".join(original), " ".join(changed(original, rng, 8, "c"))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(rows, block=64).collect()}
    want = plain_components([near_copies.shingle_set(t) for t in texts])
    assert len(set(want)) > 100 and got == dict(enumerate(want))


def test_blocks_compare_exactly():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 180, replace=False), rng.integers(0, 1 << 63, int(k)).astype(np.uint64)]))
            for k in rng.integers(0, 40, 60)]
    links = near_copies.block_links(np.arange(60), np.arange(60), sets, 0.8)
    assert all(near_copies.likeness(sets[a], sets[b]) >= 0.8 for a, b in links)
    want, root = plain_components(sets), list(range(60))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    assert root == want and len(links) == 60 - len(set(want))


def test_dedup_keeps_different_texts_of_an_id_and_without_one(spark):
    rows = [(None, prose(i, 60), "en", "s", 1) for i in range(4)] + [(7, prose(10, 60), "en", "s", 1), (7, prose(11, 60), "en", "s", 1)]
    rows += [(7, prose(10, 60), "en", "s", 1), (9, prose(10, 60), "en", "s", 1), (None, prose(10, 60), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("text_key", F.lit("other")).withColumn("root", F.lit(1))
    got = corpus_pipeline.dedup_stage(spark, docs.repartition(3), "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(
        [(None, prose(i, 60)) for i in range(4)] + [(7, prose(10, 60)), (7, prose(11, 60))])


def test_odd_rows_pass_through_all_stages(spark):
    rows = [r[:5] for r in cases()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("root", "node", "text_key", "kept", "size", "copies", "row", "spans"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert {r["doc_id"] for r in docs.collect()} <= {r[0] for r in rows}
    assert docs.count() > 0
