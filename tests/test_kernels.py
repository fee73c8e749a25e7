from __future__ import annotations

import random
from itertools import permutations

import numpy as np
import pytest

from foldspark.kernels import detect, distributions, graph_cut, merge, regions, smoothing, spectral
from foldspark.params import Params


def test_adjacency_and_perturbation():
    rng = np.random.default_rng(1)
    idx = [sorted(rng.choice(20, rng.integers(0, 6), replace=False).tolist()) for _ in range(300)]
    x = spectral.incidence(idx, 20)
    a = spectral.adjacency(x)
    assert a[3, 7] == sum(3 in i and 7 in i for i in idx) and a[4, 4] == sum(4 in i for i in idx)
    for _ in range(20):
        assert (spectral.perturbed(x, rng).sum(axis=0) == x.sum(axis=0)).all()
        assert (spectral.rows_perturbed(x, rng).sum(axis=1) == x.sum(axis=1)).all()
    c = spectral.clip(a, 0.2)
    for i in range(20):
        for j in range(i + 1, 20):
            assert c[i, j] == c[j, i] == (0 if a[i, j] > 0.2 * a[i, i] else a[i, j])
    lap = spectral.normalized_laplacian(a)
    assert np.allclose(lap, lap.T) and abs(np.linalg.eigvalsh(lap)[0]) < 1e-9


def test_bipartition_finds_two_blocks():
    a = np.kron(np.eye(2), np.ones((8, 8))) * 10 + 0.1
    labels = spectral.bipartition(a)
    assert len(set(labels[:8])) == len(set(labels[8:])) == 1 and labels[0] != labels[8]


@pytest.mark.parametrize("shape,scale", [(1.42, 0.8), (3.5, 0.8), (1.2, 2.5), (3.5, 2.5), (1.2, 8e-5), (3.5, 8e-5)])
def test_weibull(shape, scale):
    x = np.random.default_rng(2).weibull(shape, 2000) * scale
    k, s = distributions.weibull_fit(x)
    assert abs(k - shape) / shape < 0.08 and abs(s - scale) / scale < 0.08
    best = distributions.weibull_log_likelihood(x, k, s)
    assert all(best >= distributions.weibull_log_likelihood(x, k * f, s * g) - 1e-6 for f in (0.97, 1, 1.03) for g in (0.97, 1, 1.03))
    mean, sd = distributions.weibull_moments(k, s)
    assert abs(mean - x.mean()) / mean < 0.05 and abs(sd - x.std()) / sd < 0.1


def test_kolmogorov_smirnov():
    # Published values of the distribution and of its critical points.
    assert abs(distributions.ks_cdf(10, 0.274) - 0.6284796154565) < 1e-9
    assert abs(distributions.ks_critical(10, 0.10) - 0.36866) < 5e-4
    assert abs(distributions.ks_critical(20, 0.10) - 0.26473) < 5e-4
    assert abs(distributions.ks_critical(100, 0.10) - 0.12067) < 1e-3
    rng, n = np.random.default_rng(3), 15
    u = np.sort(rng.random((20000, n)), axis=1)
    d = np.maximum(np.arange(1, n + 1) / n - u, u - np.arange(n) / n).max(axis=1)
    assert abs((d < 0.25).mean() - distributions.ks_cdf(n, 0.25)) < 0.01


def simulated(profiles, n, rate=0.12, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        p = profiles[rng.integers(len(profiles))]
        out.append(np.flatnonzero(rng.random(len(p)) < rate * p).tolist())
    return out


def test_detection_of_one_and_two():
    bases = 60
    one = [np.ones(bases)]
    two = [np.r_[np.ones(30), np.zeros(30)], np.r_[np.zeros(30), np.ones(30)]]
    allowed, coverage = np.ones(bases, dtype=bool), np.full(bases, 4000)
    p = Params(max_permutations=30)
    assert detect.detect(simulated(two, 4000), coverage, allowed, p, 1).n_clusters == 2
    assert detect.detect(simulated(one, 4000), coverage, allowed, p, 1).n_clusters in (0, 1)
    few = detect.detect(simulated(two, 60), np.full(bases, 60), allowed, p, 1)
    assert few.n_clusters == 0 and few.status == "few reads"


def test_null_model_from_sums_equals_permuted_reads():
    rng = np.random.default_rng(12)
    x = (rng.random((900, 12)) < 0.15).astype(np.float32)
    by_sums, by_rows, kept_sums, kept_rows = np.zeros((12, 12)), np.zeros((12, 12)), 0, 0
    for _ in range(300):
        a, n = detect.null_adjacency(900, x.sum(axis=0), 2, rng, rows=250)
        by_sums, kept_sums = by_sums + a, kept_sums + n
        y = spectral.perturbed(x, rng)
        y = y[y.sum(axis=1) >= 2]
        by_rows, kept_rows = by_rows + spectral.adjacency(y), kept_rows + len(y)
    off = ~np.eye(12, dtype=bool)
    assert abs(kept_sums / kept_rows - 1) < 0.01
    assert np.abs(by_sums[off] / by_rows[off] - 1).max() < 0.1 and abs(by_sums[off].sum() / by_rows[off].sum() - 1) < 0.01
    whole, n = detect.null_adjacency(900, x.sum(axis=0), 0, rng, rows=100)
    assert n == 900 and (np.diag(whole) == x.sum(axis=0)).all()


def test_hard_cut_finds_planted_parts():
    rng = np.random.default_rng(7)
    parts = [[0, 4, 6, 8, 9], [1, 5, 10], [2, 3, 7, 11, 12]]
    g = np.zeros((13, 13))
    for p in parts:
        for i in p:
            for j in p:
                if i < j:
                    g[i, j] = g[j, i] = rng.integers(2, 5)
    g[0, 1] = g[1, 0] = g[3, 10] = g[10, 3] = 1
    labels = graph_cut.hard_cut(-g, 3, 20, 1)
    assert sorted(sorted(np.flatnonzero(labels == c).tolist()) for c in range(3)) == sorted(parts)


def test_soft_cut_moves_never_make_it_worse():
    rng = np.random.default_rng(8)
    a = np.kron(np.eye(2), np.ones((9, 9))) * 20 + rng.integers(0, 3, (18, 18))
    a = (a + a.T) / 2
    g = graph_cut.cut_graph(a)
    start = graph_cut.random_start(18, 2, [g], 5, rng)
    w = graph_cut.descend(start, [g], 0.05)
    assert graph_cut.score(w, [g]) <= graph_cut.score(start, [g]) + 1e-9 and np.allclose(w.sum(axis=1), 1)
    w = graph_cut.soft_cut([g, g], 2, 0.05, 10, 3, 1)
    labels = w.argmax(axis=1)
    assert len(set(labels[:9])) == len(set(labels[9:])) == 1 and labels[0] != labels[9]
    lose, gain = graph_cut._values(w * 0.8 + 0.1, [g], 0.05)
    v = w * 0.8 + 0.1
    moved = v.copy()
    moved[4, 0] -= 0.05
    moved[4, 1] += 0.05
    assert abs(graph_cut.score(moved, [g]) - graph_cut.score(v, [g]) - lose[4, 0] - gain[4, 1]) < 1e-9


def test_matching():
    assert merge.matching(np.array([[abs(a - b) for b in (125, 12345, 7, 35, 980)] for a in (5, 30, 100, 1000, 10000)], dtype=float))[1] == (2, 3, 0, 4, 1)
    rng = np.random.default_rng(9)
    for k in (3, 5, 6):
        cost = rng.random((k, k))
        want = min(cost[np.arange(k), list(p)].sum() for p in permutations(range(k)))
        assert abs(merge.matching(cost)[0] - want) < 1e-12
    big = rng.random((9, 9))
    least, p = merge.matching(big)
    assert sorted(p) == list(range(9)) and abs(least - min(big[np.arange(9), list(q)].sum() for q in permutations(range(9)))) < 1e-9


def test_merging_recovers_permuted_windows():
    rng = np.random.default_rng(10)
    truth = rng.dirichlet([0.3, 0.3, 0.3], 80)
    windows = []
    for begin in range(0, 61, 4):
        w = truth[begin : begin + 20][:, rng.permutation(3)]
        windows.append(merge.single(begin, w, rng.integers(90, 110, 20)))
    out = merge.merge_windows(windows)
    assert (out.begin, out.end) == (0, 80) and len(out.members) == len(windows)
    errors = [np.abs(out.w[:, list(p)] - truth).max() for p in permutations(range(3))]
    assert min(errors) < 0.02
    a, b = merge.single(0, truth[:20], np.ones(20)), merge.single(40, truth[40:60], np.ones(20))
    assert merge.distance(a, b)[0] == float("inf") and merge.merge_windows([a, b]).end == 60


def test_region_vectors():
    size = 17
    starts, labels = list(range(0, 30, 3)), [2] * 10
    assert regions.range_stop(starts, labels, 0, size, 17) == 10
    starts, labels = list(range(30)), [2] * 10 + [3] * 10 + [2] * 10
    assert [regions.range_stop(starts, labels, i, 17, 17) - i for i in (0, 10, 20)] == [11, 11, 10]
    assert [(r.n_clusters, r.first, len(r.windows)) for r in regions.regions([0, 2, 4, 6], [1, 2, 1, 2], 20)] == [(1, 0, 1), (2, 1, 1), (1, 2, 1), (2, 3, 1)]
    ends = {2: 120, 1: 1}
    assert regions.suppressed([23, 25, 27, 29, 31], [2, 2, 1, 1, 2], 0, 100, 5, ends) == 2 and ends[2] == 120
    assert regions.suppressed([23, 25, 27, 29, 31], [2, 2, 1, 1, 2], 2, 100, 5, ends) == 2


def test_smoothing():
    none = [None] * 9
    assert smoothing.collapse_outliers([2, 2, 2, 2, 1, 2, 2, 2, 2], none, 1, 6) == [2] * 9
    assert smoothing.collapse_outliers([2, 2, 2, 2, 1, 2, 2, 2, 2], none, 0, 6) == [2, 2, 2, 2, 1, 2, 2, 2, 2]
    assert smoothing.fill_uninformative([0, 0, 3, 0, 2, 2, 0, 0, 2], none) == [3, 3, 3, 2, 2, 2, 2, 2, 2]
    assert smoothing.fill_uninformative([0, 0, 0], [None] * 3) == [0, 0, 0]
    capped = smoothing.collapse_outliers([3, 3, 3, 1, 3, 3, 3, 3, 3], [None, None, None, 1, None, None, None, None, None], 1, 2)
    assert capped == [3, 3, 3, 1, 3, 3, 3, 3, 3]
    rng = random.Random(11)
    for _ in range(300):
        labels = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        caps = [n + rng.randrange(3) if rng.random() < 0.3 else None for n in labels]
        out = smoothing.collapse_outliers(labels, caps, 2, 3)
        assert len(out) == len(labels) and all(c is None or n <= c for n, c in zip(out, caps))


def test_drawn_nulls_have_the_distribution_of_made_ones():
    from foldspark.kernels import detect, spectral

    rng, m = np.random.default_rng(3), np.array([900, 1200, 500, 2500, 1800, 700, 1500, 2000, 1000, 1300])
    for least in (1, 2, 3):
        both = []
        for draw in (detect.null_adjacency, detect.null_drawn):
            cells, kept, gaps = zip(*((a[np.triu_indices(10)], n, spectral.eigengaps(a)) for a, n in (draw(20_000, m, least, rng) for _ in range(150))))
            both.append((np.mean(cells, axis=0), np.std(cells, axis=0), np.mean(kept), np.mean(gaps, axis=0), np.std(gaps, axis=0)))
        made, drawn = both
        assert np.allclose(made[0], drawn[0], rtol=0.03, atol=1.5) and abs(made[2] / drawn[2] - 1) < 0.02
        assert np.allclose(made[1][made[0] > 5], drawn[1][made[0] > 5], rtol=0.35, atol=1.0)
        assert np.allclose(made[3], drawn[3], rtol=0.25, atol=0.01) and np.allclose(made[4], drawn[4], rtol=0.6, atol=0.01)


def test_the_null_of_a_hot_window_takes_no_longer():
    import time

    from foldspark.kernels import detect

    began = time.time()
    for _ in range(20):
        detect.null_drawn(10**9, np.full(100, 10**7), 2, np.random.default_rng(1))
    assert time.time() - began < 10
