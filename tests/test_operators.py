"""Operators on small tables against brute force, including hot groups and several blocks."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.operators import evaluation as V
from earshot.operators import factors as M
from earshot.operators import people as N
from earshot.operators import rules as R
from earshot.operators import slices as S
from earshot.operators.ranking import ranked
from tests.conftest import rows


@pytest.mark.parametrize("group", [["g"], []])
def test_ranked_equals_window_with_hot_and_null_groups(spark, group):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 7 != 0, (F.col("id") % 50).cast("string")).alias("g"),
        (F.xxhash64("id") % 5).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id").asc()]
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    assert rows(ranked(df, group, order, "r")) == rows(plain)
    assert rows(ranked(df, group, order, "r", 4)) == rows(plain.filter("r <= 4"))


def test_hot_group_is_numbered_in_several_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), "id")
    out = ranked(df, ["g"], [F.col("id").asc()], "r")
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 4000 and out.filter("r <> id + 1").isEmpty()


def events(spark, data):
    base = "source string, user_id string, track_id string, artist_id string, event_ts timestamp_ntz, event_type string, track_name string, artist_name string, event_id string"
    return spark.createDataFrame(data, base)


def listen(i, user, track, artist, day, kind="play"):
    import datetime as dt
    return ("s", user, track, artist, dt.datetime(2024, 1, 1) + dt.timedelta(days=day, minutes=i % 1440), kind, f"song {track}", f"band {artist}", f"{i:06d}")


def test_window_includes_its_bound(spark):
    ev = events(spark, [listen(0, "u", "a", "x", 0), listen(0, "u", "b", "x", 7), listen(1, "u", "c", "x", -1)])
    assert [r.track_id for r in S.within_days(ev, 7).orderBy("track_id").collect()] == ["a", "b"]
    assert S.within_days(ev.limit(0), 7).count() == 0


@pytest.mark.parametrize("ready", [True, False])
def test_pruned_recommendations_equal_the_full_ranking(spark, ready):
    rng = random.Random(5)
    data = []
    for i in range(700):
        artist = "hot" if rng.random() < 0.4 else f"a{rng.randrange(6)}"
        track = f"{artist}-{rng.randrange(12)}" if rng.random() < 0.85 else f"shared-{rng.randrange(4)}"
        data.append(listen(i, f"u{rng.randrange(25)}", track, artist if rng.random() < 0.95 or ready else None, rng.randrange(30)))
    ev = events(spark, data).filter("NOT (track_id = 'hot-3' AND user_id = 'u1')")
    full = R.recs_rule(ev, ready=ready)
    want = rows(full.filter("recommendation_rank <= 6"))
    assert rows(R.recs_rule(ev, ready=ready, max_rank=6)) == want and len(want) > 100
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    assert rows(R.recs_rule(ev, ready=ready, users=users, max_rank=6)) == [r for r in want if r[0] in ("u1", "u2")]


def test_block_similarity_and_metrics(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 3)
    rng = random.Random(1)
    lists = {f"u{i}": rng.sample([f"t{j}" for j in range(9)], rng.randrange(1, 5)) for i in range(20)} | {"x": ["t1"], "y": ["t1"]}
    picks = spark.createDataFrame([(u, t) for u, ts in lists.items() for t in ts], "user_id string, track_id string")
    want = sum(len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in itertools.combinations(lists.values(), 2))
    got = V.pairwise_similarity(picks).first()
    assert got.users_with_recs == 22 and abs(got.similarity - want) < 1e-9

    train = spark.createDataFrame([(u, "old") for u in "abc"], "user_id string, track_id string")
    test = spark.createDataFrame([(u, f"new-{u}") for u in "abc"], "user_id string, track_id string")
    schema = "user_id string, recommendation_rank long, track_id string, track_name string, artist_name string"
    perfect = spark.createDataFrame([(u, r, t, "n", "a") for u in "abc" for r, t in ((1, "old"), (2, f"new-{u}"), (3, f"new-{u}"))], schema)
    m = V.evaluate_recs("p", perfect, train, test, F.lit(4), k=1).first()
    assert (m.ndcg_at_k, m.recall_at_k, m.precision_at_k, m.hit_rate_at_k, m.user_coverage) == (1, 1, 1, 1, 1)
    assert m.personalization_at_k == 1 and m.item_coverage_at_k == 0.75 and m.readable_rate_at_k == 1
    same = spark.createDataFrame([(u, 1, "z", "5", "a") for u in "ab"], schema)
    m = V.evaluate_recs("s", same, train, test, F.lit(4), k=2).first()
    assert m.personalization_at_k == 0 and m.users_with_recs == 2 and m.readable_rate_at_k == 0 and m.hit_rate_at_k == 0
    none = V.evaluate_recs("n", same.limit(0), train, test, F.lit(4)).first()
    assert none.users_with_recs == 0 and none.personalization_at_k == 0 and none.users_evaluated == 3


def test_first_weights_win_ties(spark):
    grid = spark.createDataFrame([(0.2, 0.1, 0.1, 1), (0.2, 0.1, 0.1, 0), (0.1, 0.9, 0.9, 2)],
                                 "ndcg_at_k double, hit_rate_at_k double, precision_at_k double, combo int")
    assert V.best_weights(grid).first().combo == 0


def test_block_scores_equal_dense_scores(spark, monkeypatch):
    monkeypatch.setattr(M, "USER_BLOCK", 4)
    monkeypatch.setattr(M, "ITEM_BLOCK", 5)
    rng = np.random.default_rng(0)
    u, t = rng.normal(size=(9, 3)), rng.normal(size=(23, 3))
    seen = {(i, j) for i in range(9) for j in range(23) if i == 0 or rng.random() < 0.3} - {(0, 7)}
    frame = lambda v, p, c: spark.createDataFrame([(f"{p}{i:02d}", [float(x) for x in r]) for i, r in enumerate(v)], f"{c} string, vec array<double>")
    got = M.topk_scores(frame(u, "u", "user_id"), frame(t, "t", "track_id"),
                        spark.createDataFrame([(f"u{i:02d}", f"t{j:02d}") for i, j in seen], "user_id string, track_id string"), 4)
    want = []
    for i in range(9):
        free = sorted((-(u[i] @ t[j]), j) for j in range(23) if (i, j) not in seen)[:4]
        want += [(f"u{i:02d}", rank, f"t{j:02d}") for rank, (_, j) in enumerate(free, 1)]
    assert [r[:3] for r in rows(got)] == sorted(want)


def test_trained_recommendations_keep_their_promises(spark):
    rng = random.Random(2)
    plays = {(f"u{i}", f"t{(i % 2) * 20 + rng.randrange(20)}") for i in range(12) for _ in range(8)}
    hist = spark.createDataFrame([(u, t, f"n{t}", "a", 1 + rng.randrange(9)) for u, t in sorted(plays)],
                                 "user_id string, track_id string, track_name string, artist_name string, plays long")
    from earshot.operators.history import interaction_weights
    weights = interaction_weights(hist)
    assert weights.filter("weight < 0.1 OR weight > 1").isEmpty()
    runs = [rows(M.recs_mf(*M.train_mf(weights, 4, 3), hist, 5).select("user_id", "recommendation_rank", "track_id", "recommendation_score")) for _ in range(2)]
    assert [r[:3] for r in runs[0]] == [r[:3] for r in runs[1]]
    assert not {(r[0], r[2]) for r in runs[0]} & plays
    for user, mine in itertools.groupby(runs[0], key=lambda r: r[0]):
        mine = list(mine)
        assert [r[1] for r in mine] == list(range(1, 6)) and all(a[3] >= b[3] for a, b in zip(mine, mine[1:]))


def test_display_names_are_unique_in_one_pass(spark):
    users = [(f"user-{i}", (i * 37) % 11) for i in range(157)]
    first, last = ("Ann", "Ben", "Cy"), ("Low", "May")
    got = dict(rows(N.display_names(spark.createDataFrame(users, "user_id string, plays long"), first, last)))
    taken, want = {}, {}
    for user, _ in sorted(users, key=lambda x: (-x[1], x[0])):
        slot = int(hashlib.sha256(user.encode()).hexdigest()[:12], 16) % 6
        taken[slot] = taken.get(slot, 0) + 1
        want[user] = f"{first[slot % 3]} {last[slot // 3]}" + (f" {taken[slot]}" if taken[slot] > 1 else "")
    assert got == want and len(set(got.values())) == len(users)


def test_references_resolve_as_one_by_one(spark):
    names = {"1": "Aarav Edwards", "2": "Abigail Johnson", "3": "Abigail Jones", "4": "Li", "5": "Zoe Ox", "6": "Outsider Person"}
    model = ["1", "2", "3", "4", "5"]
    refs = ["1", "AARAV edwards", "aarav", "abigail", "Arav Edwards", "Abigail Johnsen", "zo ox", "99", "  ", "nobody here", "outsidr person", "zeo ox", "a-b!"]

    def norm(s):
        return re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]+", " ", s.lower())).strip()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def ratio(a, b):
        return 1 - distance(a, b) / max(len(a), len(b), 1)

    def one(ref):
        key = ref.strip()
        if not key:
            return ref
        if key in model:
            return key
        exact = [u for u, n in names.items() if n.lower() == key.lower()]
        if exact:
            return exact[0]
        if len(key) < 3 or not any(c.isalpha() for c in key):
            return key
        part = [u for u, n in names.items() if key.lower() in n.lower()]
        if len(part) == 1:
            return part[0]
        q = norm(key)
        if len(key) < 4 or not q:
            return key
        scored = []
        for u in model:
            n = norm(names[u])
            scored.append((max([ratio(q, n)] + [ratio(q, t) for t in n.split()]) + (0.03 if set(q.split()) & set(n.split()) else 0), u))
        scored.sort(key=lambda x: (-x[0], names[x[1]]))
        (best, u), (second, _) = scored[:2]
        return u if best >= 0.84 and (best - second >= 0.05 or best >= 0.92) else key

    got = N.resolve_users(spark.createDataFrame([(r,) for r in refs], "ref string"),
                          spark.createDataFrame(list(names.items()), "user_id string, display_name string"),
                          spark.createDataFrame([(u,) for u in model], "user_id string"))
    assert {r.ref: r.user_id for r in got.collect()} == {r: one(r) for r in refs}


def test_plans_have_no_products_and_limit_before_the_shuffle(spark):
    ev = events(spark, [listen(i, f"u{i % 3}", f"t{i % 5}", "x", i % 9) for i in range(20)])
    from earshot.operators.popularity import user_top_tracks
    limited = user_top_tracks(ev, max_rank=3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in limited and "Cartesian" not in limited and "NestedLoop" not in limited
    recs = R.recs_rule(ev, max_rank=3)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in recs and "Cartesian" not in recs and "NestedLoop" not in recs


def test_topk_skips_slices_whose_norms_cannot_reach(spark):
    import numpy as np

    from earshot.operators import factors as M

    rng = np.random.default_rng(0)
    users = [(f"u{i}", rng.normal(size=6).tolist()) for i in range(20)]
    items = [(f"t{i:04d}", (rng.normal(size=6) * 2.0 ** (-i / 60)).tolist()) for i in range(600)]
    items += [("t9999", items[3][1])]  # equal scores go to the smaller id
    seen = [(u, t) for u, _ in users[:5] for t, _ in items[:40]]
    got = M.topk_scores(spark.createDataFrame(users, "user_id string, vec array<double>"),
                        spark.createDataFrame(items, "track_id string, vec array<double>"),
                        spark.createDataFrame(seen, "user_id string, track_id string"), k=7, item_block=40)
    mine = {(r.user_id, r.recommendation_rank): r.track_id for r in got.collect()}
    played = set(seen)
    for user, vec in users:
        best = sorted((-float(np.dot(vec, v)), t) for t, v in items if (user, t) not in played)[:7]
        assert [mine[user, i + 1] for i in range(7)] == [t for _, t in best]
    bounds = [2.0 ** -k for k in range(10)]
    open_ = M.open_slices(spark.createDataFrame([("a", 1.0, 0.1), ("b", 1.0, None), ("c", 0.01, 0.1)],
                                                "user_id string, norm double, least double"), bounds, 2, 10)
    count = {r.user_id: r["count"] for r in open_.groupBy("user_id").count().collect()}
    assert count == {"a": 2, "b": 8}  # slices below 0.1 are not scored for a, none for c


def test_sources_evaluated_together_equal_each_alone(spark):
    from earshot.operators import evaluation as E

    frame = spark.createDataFrame
    train = frame([("u1", "t1"), ("u2", "t2"), ("u3", "t1")], "user_id string, track_id string")
    test = frame([("u1", "t5"), ("u2", "t6"), ("u3", "t7")], "user_id string, track_id string")
    rows_of = [("a", u, r, f"t{(r * k) % 9}", "n", "x") for u, k in (("u1", 1), ("u2", 2), ("u3", 5)) for r in range(1, 9)]
    rows_of += [("b", "u1", 1, "t5", "n", "x")]
    recs = frame(rows_of, "source string, user_id string, recommendation_rank int, track_id string, track_name string, artist_name string")
    total = F.lit(9)
    both = {r.source: r for r in E.evaluate_sources(recs, ["a", "b", "none"], train, test, total, 3).collect()}
    for name in ("a", "b"):
        own = E.evaluate_recs(name, recs.filter(F.col("source") == name).drop("source"), train, test, total, 3).first()
        assert tuple(own) == tuple(both[name])
    assert both["none"].users_evaluated == 3 and both["none"].users_with_recs == 0 and both["b"].hit_rate_at_k == 1 / 3
