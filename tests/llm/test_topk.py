from __future__ import annotations

import numpy as np
import pytest

from foldspark.llm import topk


def brute(rows, queries, k):
    out = []
    for own, q in queries:
        v = [int(x) for x in np.floor(1024 * np.array(q))]
        scored = []
        for i, r in rows:
            if i != own and len(r) == len(q):
                scored.append((-max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(v, np.floor(1024 * np.array(r)))))), i))
        out += [(own, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def clean(rows):
    return [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    out = [(i, [float(x) for x in centres[i % 6] + 0.2 * rng.normal(size=5).round(1)]) for i in range(900)]
    out += [(i, [1.0, 2.0]) for i in range(900, 930)]  # ties, another length
    out += [(0, out[0][1]), (7, out[7][1]), (None, [1.0] * 5), (2000, None), (2100, []), (2200, [1.0, None, 1.0, 1.0, 1.0]), (2300, [float("nan")] * 5), (2400, [float("inf")] * 5)]
    return out


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, `meta.k` int").repartition(5)
    want = brute(clean(rows), [(i, v) for i, v in clean(rows) if i % 100 == 0], 10)
    for options in ({}, {"block": 3, "pilot": 50, "shard_rows": 70}, {"pilot": 0}):
        got = topk.top_k(df, df.filter("vec_id % 100 = 0"), **options)
        assert sorted(map(tuple, got.collect())) == want


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (100, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, df).collect())) == [(0, 1, 100, 1024 * 2048), (100, 1, 0, 1024 * 2048)]
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_scores_beyond_doubles_are_exact(spark):
    data = [(0, [3e9, 1.5]), (1, [2.5e9, 7.25]), (2, [-3e12, 1.0]), (3, [3e30, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df).collect())) == brute(data, data, 10)


def test_tree_prunes_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 900
    vectors = np.floor(np.repeat(centres, 500, axis=0) + rng.normal(size=(20000, 8)) * 10)
    tree, seen = topk.BallTree(np.arange(20000), vectors), []
    scores = tree.scores
    tree.scores = lambda a, b, q: seen.append(b - a) or scores(a, b, q)
    best = topk.Best(10, -np.inf)
    tree.search(-1, vectors[0], tree.bounds(vectors[:1])[0], best)
    assert sum(seen) < 6000 and best.least == sorted(vectors @ vectors[0])[-10]


def test_ids_as_text_and_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(120)]
    df = spark.createDataFrame([(str(i), v) for i, v in rows] + [("no number", [1.0] * 3)], "vec_id string, embedding array<double>")
    monkeypatch.setattr(topk, "MOST_ROOTS", 2)
    assert sorted(map(tuple, topk.top_k(df, df.filter("try_cast(vec_id as int) % 40 = 0"), shard_rows=10, block=2).collect())) == brute(rows, [r for r in rows if r[0] % 40 == 0], 10)


def test_packed_trees_are_the_same():
    rng = np.random.default_rng(8)
    vectors = np.floor(rng.normal(size=(900, 4)) * 1000)
    one = topk.BallTree(np.arange(900), vectors, 50)
    two = topk.BallTree.unpacked(4, *one.packed())
    assert (one.vectors == two.vectors).all() and one.children == two.children and one.spans == two.spans and one.largest == two.largest
