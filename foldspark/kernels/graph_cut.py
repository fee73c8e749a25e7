"""Normalized cuts of the base-base graph: soft (weights in steps) and hard (labels).

A cluster's score is cut(c, rest) / cut(c, c); the sum over clusters, and over
replicates that share the weights, is made small. With S = w'Gw and R = w'G1 the
score of a cluster is R/S - 1, and moving a little of one base changes two
clusters by terms of Gw alone, so all moves are valued at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def cut_graph(a: np.ndarray, symmetric: bool = True) -> np.ndarray:
    """ln(1 + co-mutation) without its diagonal, as the off-diagonal of a normalized Laplacian; or as it is."""
    if not symmetric:
        return a - np.diag(np.diag(a))
    w = np.log1p(a - np.diag(np.diag(a)))
    d = w.sum(axis=1)
    root = 1 / np.sqrt(np.where(np.abs(d) < 1e-4, 1.0, d))
    return -w * np.outer(root, root)


def check_graph(a: np.ndarray) -> str:
    """Why a graph can't be cut, or ok."""
    off = np.abs(a - np.diag(np.diag(a))).sum(axis=1)
    return "isolated base" if len(a) and (off < 1e-6).any() else "ok"


def score(w: np.ndarray, graphs: list[np.ndarray]) -> float:
    """Sum over graphs and clusters; infinite where a cluster has no inner weight."""
    total = 0.0
    for g in graphs:
        inner = np.einsum("ic,ij,jc->c", w, g, w)
        if (np.abs(inner) < 1e-12).any():
            return float("inf")
        total += float((g.sum(axis=1) @ w / inner - 1).sum())
    return total


def compositions(n: int, k: int, step: int, least: int = 3) -> Iterator[tuple[int, ...]]:
    """Sizes, in steps, of k parts of n, largest first."""
    if k == 1:
        if n >= least:
            yield (n,)
        return
    for first in range(n - least * (k - 1), max(least, -(-n // k)) - 1, -step):
        for rest in compositions(n - first, k - 1, step, least):
            if rest[0] <= first:
                yield (first, *rest)


def one_hot(labels: np.ndarray, k: int) -> np.ndarray:
    return np.eye(k)[labels]


def random_start(n: int, k: int, graphs: list[np.ndarray], tries: int, rng: np.random.Generator) -> np.ndarray | None:
    """The best of ``tries`` random hard partitions for each composition of sizes."""
    best, least = None, float("inf")
    for sizes in compositions(n, k, max(n // (5 * k), 3)):
        labels = np.repeat(np.arange(k), sizes)
        for _ in range(tries):
            w = one_hot(rng.permutation(labels), k)
            if (s := score(w, graphs)) < least:
                best, least = w, s
    return best


def _values(w: np.ndarray, graphs: list[np.ndarray], delta: float) -> tuple[np.ndarray, np.ndarray]:
    """What each base's loss of delta from, and gain in, each cluster changes the score by."""
    lose, gain = np.zeros_like(w), np.zeros_like(w)
    for g in graphs:
        gw = g @ w
        rows = g.sum(axis=1)
        inner, all_ = (w * gw).sum(axis=0), rows @ w
        with np.errstate(divide="ignore", invalid="ignore"):
            now = all_ / inner
            for out, sign in ((lose, -1), (gain, 1)):
                below = inner + sign * 2 * delta * gw
                new = (all_ + sign * delta * rows[:, None]) / below
                out += np.where((np.abs(below) < 1e-12) | (new < 1), np.inf, new - now)
    return lose, gain


def descend(w: np.ndarray, graphs: list[np.ndarray], module: float, least_weight: float = 3.0, most_steps: int = 200_000) -> np.ndarray:
    """Greedy best moves of ``module``; where none helps, of growing steps, until a whole base moves. Every move lowers the score; the bound on moves is against rounding."""
    w, step, k = w.copy(), module, w.shape[1]
    for _ in range(most_steps):
        lose, gain = _values(w, graphs, step)
        lose[(w < step - 1e-9) | (w.sum(axis=0) - step <= least_weight)[None]] = np.inf
        best = np.full((len(w), k), np.inf)
        source = np.zeros((len(w), k), dtype=int)
        for b in range(k):
            others = lose.copy()
            others[:, b] = np.inf
            source[:, b] = others.argmin(axis=1)
            best[:, b] = others.min(axis=1) + gain[:, b]
        i, b = np.unravel_index(np.nanargmin(best), best.shape)
        if best[i, b] < -1e-12:
            w[i, source[i, b]] -= step
            w[i, b] += step
            step = module
        else:
            step += module
            if step > 1 + 1e-9:
                break
    w = np.clip(w, 0, 1)
    return w / w.sum(axis=1, keepdims=True)


def soft_cut(graphs: list[np.ndarray], k: int, module: float, tries: int, rounds: int, seed: int, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (bases by clusters) of the best of ``rounds`` descents; fewer clusters where there are too few bases."""
    n = len(graphs[0])
    k = max(1, min(k, n // 3))
    if k == 1:
        return np.ones((n, 1))
    best, least = None, float("inf")
    for r in range(rounds):
        rng = np.random.default_rng([seed, r])
        w = start if start is not None else random_start(n, k, graphs, tries, rng)
        if w is None:
            continue
        w = descend(w, graphs, module)
        if (s := score(w, graphs)) < least:
            best, least = w, s
    if best is None:
        best = np.zeros((n, k))
        best[:, 0] = 1
    return best


def hard_cut(g: np.ndarray, k: int, rounds: int, seed: int, start: np.ndarray | None = None) -> np.ndarray:
    """Labels of the best of ``rounds`` descents by single moves, at least three bases a cluster."""
    n = len(g)
    best, least = None, float("inf")
    for r in range(rounds):
        rng = np.random.default_rng([seed, r])
        if start is None:
            labels = np.concatenate([np.repeat(np.arange(k), 3), rng.integers(0, k, max(n - 3 * k, 0))])[:n]
            w = one_hot(rng.permutation(labels), k)
        else:
            w = one_hot(np.asarray(start), k)
        w = descend(w, [g], 1.0, least_weight=2.0)
        if (s := score(w, [g])) < least:
            best, least = w.argmax(axis=1), s
    return best if best is not None else np.zeros(n, dtype=int)
