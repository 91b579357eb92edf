"""What a Python task holds does not follow the length of texts or the number of fingerprints."""

import tracemalloc

import numpy as np

from earshot.llm import near_copies, simhash


def peak_mb(job):
    tracemalloc.start()
    try:
        out = job()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_balls_of_many_fingerprints_are_spelt_in_parts():
    points = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 24_000, np.uint64))
    whole = simhash.ball_roots(points, 5, 4, 4, spelled=1 << 23)
    root, most = peak_mb(lambda: simhash.ball_roots(points, 5, 4, 4))
    assert np.array_equal(root, whole) and most < 130


def test_blocks_of_long_texts_are_compared_in_parts():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 1 << 64, 120_000, np.uint64))
    sets = [np.sort(rng.choice(pool, int(rng.integers(1, 20_000)), replace=False)) for _ in range(60)]
    sets += [np.sort(rng.choice(s, int(len(s) * 0.85) + 1, replace=False)) for s in sets[:30]] + [np.zeros(0, np.uint64)]
    both, most = peak_mb(lambda: near_copies._in_common(sets))
    for i, j in [(0, 1), (0, 60), (5, 65), (29, 89), (90, 3), (40, 50)]:
        assert both[i, j] == len(np.intersect1d(sets[i], sets[j]))
    names = np.arange(len(sets))
    links = near_copies.block_links(names, names, sets, 0.8)
    assert sorted(links) == [(i, 60 + i) for i in range(30)] and most < 40
    assert near_copies.block_links(names[:2], names[:2], [sets[-1], sets[-1]], 0.8) == [(0, 1)]
