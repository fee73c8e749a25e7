"""Vectors and invariants of the relational operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foldspark.functions import arith, udtf
from foldspark.operators import assign as A
from foldspark.operators import coverage as C
from foldspark.operators import filters as P
from foldspark.operators import joins as J
from foldspark.operators import sets as U
from foldspark.operators import windows as W
from foldspark.params import Params

SCHEMA = "transcript_id long, read_id long, replicate int, begin long, end long, idx array<long>"


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        b = rng.randrange(0, 30)
        e = rng.randrange(b + 5, 41)
        rows.append((i % 2, i, i % 3, b, e, sorted(rng.sample(range(b, e), rng.randrange(0, 5)))))
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("length,size,offset,count,step", [(29, 7, 3, 8, 22 / 7), (28, 7, 3, 8, 3.0), (5, 4, 3, 1, 0.0), (5, 5, 3, 1, 0.0), (10, 9, 1, 2, 1.0)])
def test_grid_vectors(length, size, offset, count, step):
    g = W.grid(length, size, offset)
    assert g.count == count and abs(g.step - step) < 1e-12


def test_grid_starts(spark):
    assert [W.grid(29, 7, 3).start(i) for i in (0, 1, 4, 7)] == [0, 3, 13, 22]
    assert [W.grid(28, 7, 3).start(i) for i in (0, 1, 4, 7)] == [0, 3, 12, 21]
    udtf.register(spark)
    rows = [tuple(r) for r in spark.sql("select * from window_grid(29, 7, 3)").collect()]
    assert rows == [(i, W.grid(29, 7, 3).start(i), W.grid(29, 7, 3).start(i) + 7) for i in range(8)]
    out = W.window_grid(spark.createDataFrame([("t", 29), ("short", 5)], "transcript_id string, length long"), 7, 3).collect()
    assert sorted((r.transcript_id, r.start, r.stop) for r in out) == [("short", 0, 5)] + [("t", b, e) for _, b, e in rows]


def test_sizes_and_offsets():
    assert W.window_size(200, 100, 0, 75) == 100 and W.window_size(60, 100, 0, 75) == 60 and W.window_size(200, 0.9, 0, 75) == 67 and W.window_size(200, 100, 0.25, 75) == 50
    assert W.window_offset(100, 0.01) == 1 and W.window_offset(67, 0.05) == 3 and W.window_offset(10, 0.01) == 1 and W.window_offset(10, 2.5) == 3


@pytest.mark.parametrize("size,offset", [(10, 3), (7, 1), (40, 5), (12, 11)])
def test_window_reads_equal_the_theta_join(reads, size, offset):
    df, rows = reads
    g = W.grid(40, size, offset)
    got = sorted((r.read_id, r.window_idx, tuple(r.idx)) for r in J.window_reads(df, size, g.count, g.step).collect())
    want = [(r[1], w, tuple(i - g.start(w) for i in r[5] if g.start(w) <= i < g.start(w) + size)) for r in rows for w in range(g.count) if r[3] <= g.start(w) and r[4] >= g.start(w) + size]
    assert got == sorted(want)


def test_coverage_and_medians(reads):
    df, rows = reads
    got = {(r.transcript_id, r.base): r.coverage for r in C.base_coverage(df, ["transcript_id"], 40).collect()}
    assert got == {(t, b): sum(r[0] == t and r[3] <= b < r[4] for r in rows) for t in (0, 1) for b in range(40)}
    for r in C.median_read_length(df, ["transcript_id"]).collect():
        lengths = sorted(x[4] - x[3] for x in rows if x[0] == r.transcript_id)
        assert r.median_length == lengths[len(lengths) // 2]


def test_one_and_many_replicates_differ_at_the_minimum(spark):
    df = spark.createDataFrame([(100, 2), (100, 3), (99, 9)], "coverage int, mutations int")
    assert [r.mutations for r in df.filter(P.base_quality(100, 2, 0.0)).collect()] == [3]
    assert [r.mutations for r in df.filter(P.base_quality(100, 2, 0.0, at_least=True)).collect()] == [2, 3]
    assert df.filter(P.base_quality(100, 2, 0.0, first=False)).count() == 2


def test_consensus_segments(spark):
    runs = [(999, 1.0)] * 10 + [(1, 1.0)] * 5 + [(1, 0.5)] * 3 + [(2, 0.5)] * 4 + [(2, 1.0)] * 2 + [(999, 1.0)] * 5
    rows = [("t", i, i * 5, n, c) for i, (n, c) in enumerate(runs)]
    df = spark.createDataFrame(rows, "transcript_id string, window_idx int, start int, n_clusters int, confidence double").filter("window_idx >= 10 and window_idx < 24")
    got = [(r.n_clusters, r.confidence, r.start, r.stop) for r in W.confidence_segments(df, ["transcript_id"], 17).orderBy("start").collect()]
    assert got == [(1, 1.0, 50, 87), (1, 0.5, 75, 102), (2, 0.5, 90, 122), (2, 1.0, 110, 132)]


def test_consensus_is_the_lower_median(spark):
    rows = [("t", 0, r, n) for r, n in enumerate((1, 3, 2, 3))] + [("t", 1, r, n) for r, n in enumerate((2, 2, 5))]
    got = {r.window_idx: (r.n_clusters, r.confidence) for r in W.replicate_consensus(spark.createDataFrame(rows, "transcript_id string, window_idx int, replicate int, n_clusters int"), ["transcript_id", "window_idx"]).collect()}
    assert got == {0: (2, 0.25), 1: (2, 2 / 3)}


def test_assignment_splits_ties_and_covers_reads(spark):
    rows = [(0, i, 0, 0, 4, [0, 1]) for i in range(5)] + [(0, 10 + i, 0, 0, 4, [0]) for i in range(3)] + [(0, 20, 0, 0, 4, [3])]
    reads = spark.createDataFrame(rows, SCHEMA)
    w = [(0, b, c, v) for b, vs in enumerate([(0.9, 0.1), (0.1, 0.9), (0.5, 0.5), (0.2, 0.8)]) for c, v in enumerate(vs)]
    weights = spark.createDataFrame(w, "transcript_id long, base long, cluster int, weight double")
    unique = A.unique_reads(reads, ["transcript_id"])
    got = sorted((tuple(r.idx), r.cluster, r.ties, r.assigned) for r in A.assign(unique, weights, ["transcript_id"]).collect())
    assert got == [((0,), 0, 1, 3), ((0, 1), 0, 2, 2), ((0, 1), 1, 2, 2), ((3,), 1, 1, 1)]
    assert sorted(r.assigned for r in A.assign(unique, weights, ["transcript_id"], skip_ambiguous=True).collect()) == [0, 0, 1, 3]
    assigned = A.assign(unique, weights, ["transcript_id"])
    each = A.read_clusters(reads, assigned, ["transcript_id"], 7).collect()
    assert sorted(r.cluster is None for r in each) == [False] * 8 + [True]
    assert sum(r.cluster == 0 for r in each) == 5 and sum(r.cluster == 1 for r in each) == 3
    shares = {r.cluster: r.fraction for r in A.cluster_fractions(assigned, ["transcript_id"]).collect()}
    assert shares == {0: 5 / 8, 1: 3 / 8}


def test_sets(spark, reads):
    df, _ = reads
    flat = df.select("transcript_id", "read_id", F.array_join(F.transform("idx", lambda x: x.cast("string")), ",").alias("idx"))
    assert U.differences(flat, flat.repartition(5)).count() == 0
    assert [r.surplus for r in U.differences(flat, flat.unionByName(flat.filter("read_id = 3"))).collect()] == [-1]
    assert U.combinations(spark.createDataFrame([(i,) for i in (3, 1, 2, 4, 4)], "x int"), "x", 2).count() == 6


def test_numbers_and_options():
    assert arith.factorial(22) == 1124000727777607680000 and arith.binomial(60, 30) == 118264581564861424 and arith.binomial(5, 9) == 0 and arith.gcd(12, 18) == 6
    for f in (lambda: arith.factorial(23), lambda: arith.binomial(100, 50), lambda: Params(max_clusters=0), lambda: Params(win_len=5), lambda: Params(min_permutations=9, max_permutations=8)):
        with pytest.raises((ValueError, OverflowError)):
            f()
    assert arith.binomial_float(100, 50) > 1e29


def test_plans_hold_no_theta_join(spark, reads):
    df, _ = reads
    for plan in (J.window_reads(df, 10, 11, 3.0), J.comutation_matrix(df, ["transcript_id"])):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text and "Join" not in text
