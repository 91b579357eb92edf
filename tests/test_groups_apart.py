"""Tracks that share a value with the user count as seen, without a row per pair."""

import numpy as np

from earshot.operators import factors as M
from tests.conftest import rows


def test_groups_apart_equal_listed_pairs(spark):
    rng = np.random.default_rng(7)
    made = [(f"{side}{i:02d}", rng.integers(-2, 3, 4).astype(float).tolist(), str(i % 3) if i % 5 else None)
            for side in "ut" for i in range(40)]
    every = spark.createDataFrame(made, "id string, vec array<double>, g string")
    users = every.filter("id LIKE 'u%'").withColumnRenamed("id", "user_id")
    items = every.filter("id LIKE 't%'").withColumnRenamed("id", "track_id")
    pairs = users.select("user_id", "g").join(items.select("track_id", "g"), "g")
    got = rows(M.topk_scores(users, items, None, 6, item_block=16, apart="g"))
    assert got == rows(M.topk_scores(users, items, pairs, 6, item_block=16)) and len(got) == 240
