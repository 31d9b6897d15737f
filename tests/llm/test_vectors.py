import os

import numpy as np
import pytest

from quadrat.llm import metric_join, neighbours

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0] * 8, [NAN] + [1.0] * 7, [INF] + [1.0] * 7, [None] + [1.0] * 7]


def vectors(seed, n=300, size=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x[50:90] = x[10] + rng.normal(size=(40, size)) * 0.05
    x[100:130] = x[11]
    x[130:140] = x[11] * 3
    return x


def table(spark, x, labels, odd=True):
    rows = [(i * 5, r.tolist(), lab) for i, (r, lab) in enumerate(zip(x, labels, strict=True))]
    rows += [(100_000 + i, v, 1) for i, v in enumerate(ODD)] if odd else []
    return spark.createDataFrame([(*r, "z", 0) for r in rows], "vec_id long, embedding array<double>, label int, rep string, n int").repartition(4)


def exact_links(rows, threshold):
    ids = [r[0] for r in rows]
    links = {i: set() for i in ids}
    for a, x, la in rows:
        for b, y, lb in rows:
            if a != b and la is not None and la == lb and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a].add(b)
    low = {}
    for i in sorted(ids):
        if i not in low:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in low:
                    low[j] = i
                    todo += links[j]
    return {i: (len(links[i]), low[i], low[i] == i) for i in ids}


def test_links_same_as_brute_force(spark):
    for seed, cell in ((1, 1024), (2, 20)):
        x = vectors(seed)
        labels = [None if i % 29 == 0 else i % 2 for i in range(len(x))]
        want = exact_links([(i * 5, v, lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))], 0.98)
        want |= {100_000 + i: (0, 100_000 + i, True) for i in range(len(ODD))}
        got = metric_join.near_vectors(table(spark, x, labels), 0.98, cell).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_links_of_repeated_ids_and_extreme_norms(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.05], 1), (2, [1e200, 1e198], 1), (3, [1e-200, 0.0], 1), (4, [-0.0, 1.0], 1), (5, [0.0, 1.0], 1), (6, [0.0, 2.0], 1), (6, [0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in metric_join.near_vectors(df).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 4), (5, 3, 4), (6, 3, 4), (6, 3, 4)]


def test_cells_hold_every_close_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, cell, home = metric_join.cells(x, x[:12], np.full(400, 12), 0.2)
    member = np.zeros((400, 12), bool)
    member[row, cell] = True
    at = np.zeros(400, int)
    at[row[home]] = cell[home]
    close = (x @ x.T) >= 0.98
    i, j = np.nonzero(close)
    assert member[j, at[i]].all() and member.mean() < 0.9


def test_neighbours_exact_when_all_are_reranked(spark):
    x = vectors(4)[:60]
    df = table(spark, x, [0] * len(x))
    got = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), 5, least=12).collect()
    want = []
    for i in range(0, len(x), 4):
        best = sorted((-(x[j] @ x[i]), j * 5) for j in range(len(x)) if j != i)[:5]
        want += [(i * 5, r + 1, v) for r, (_, v) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want
    assert all(abs(r.score - x[r.query_id // 5] @ x[r.vec_id // 5]) < 1e-12 for r in got)
    few = neighbours.nearest(df.filter("vec_id < 15"), df.filter("vec_id < 15"), 5).collect()
    assert len(few) == 6


def test_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = table(spark, x, [0] * len(x), odd=False)
    got = neighbours.nearest(df, df.filter("vec_id % 500 = 0"), 20, shard=2000).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, len(x), 100):
        s = x @ x[i]
        s[i] = -9
        hits += len(found[i * 5] & {int(j) * 5 for j in np.argsort(-s)[:20]})
    assert hits / (60 * 20) >= 0.9


def test_recall_and_scores_on_the_test_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    df = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    rows = [(i, v) for i, v in rows if v is not None and len(v) and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    place, hits = {i: k for k, i in enumerate(ids.tolist())}, 0
    for i, got in found.items():
        s = x @ x[place[i]]
        s[place[i]] = -9
        hits += sum(score >= np.sort(s)[-20] - 1e-9 for score in got.values())
        assert len(got) == 20 and all(abs(score - s[place[v]]) < 1e-9 for v, score in got.items())
    assert len(found) == (ids % 20 == 0).sum() and hits / (20 * len(found)) >= 0.9


def test_copies_go_by_the_smaller_id(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.permutation(3000)[:1000]] = x[0]
    df = table(spark, x, [0] * len(x), odd=False)
    for least in (2, 300):
        got = neighbours.nearest(df, df.filter("vec_id = 0"), 20, least=least).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [i * 5 for i in range(1, 3000) if (x[i] == x[0]).all()][:20]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert metric_join.near_vectors(df).count() == 0
    assert neighbours.nearest(df, df).count() == 0
