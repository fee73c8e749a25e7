"""Windows of one region merged to one: agglomeration by cluster-matched distances.

Weights are held in 255ths. The distance of two (merged) windows is the least,
over all matchings of their clusters, of the summed deviations of all member
windows from the coverage-weighted mean, over the bases both cover, plus a
penalty for the bases only one covers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import permutations

import numpy as np

PENALTY = 0.5
MOST_EXHAUSTIVE = 8


def quantized(w: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(w, 0, 1) * 255 + 0.5) / 255


@dataclass
class Merged:
    """begin, weights [base, cluster], coverage, and the single windows it holds as (begin, weights)."""

    begin: int
    w: np.ndarray
    coverage: np.ndarray
    members: list[tuple[int, np.ndarray]] = field(default_factory=list)

    @property
    def end(self) -> int:
        return self.begin + len(self.w)

    def high(self) -> float:
        c = np.sort(self.coverage)
        return float(c[min(int(0.9 * len(c)), len(c) - 1)]) if len(c) else 0.0


def single(begin: int, w: np.ndarray, coverage: np.ndarray) -> Merged:
    q = quantized(np.asarray(w, dtype=float))
    return Merged(int(begin), q, np.asarray(coverage, dtype=float), [(int(begin), q)])


def matching(cost: np.ndarray) -> tuple[float, tuple[int, ...]]:
    """The cheapest bijection of rows to columns: all of them up to eight, shortest augmenting paths beyond."""
    k = len(cost)
    if k <= MOST_EXHAUSTIVE:
        rows = np.arange(k)
        return min(((float(cost[rows, list(p)].sum()), p) for p in permutations(range(k))), key=lambda x: x[0])
    u, v, taken = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1, dtype=int)
    for i in range(1, k + 1):
        taken[0], at = i, 0
        reach, used, way = np.full(k + 1, np.inf), np.zeros(k + 1, dtype=bool), np.zeros(k + 1, dtype=int)
        while True:
            used[at] = True
            row = taken[at]
            free = np.flatnonzero(~used[1:]) + 1
            new = cost[row - 1, free - 1] - u[row] - v[free]
            better = new < reach[free]
            reach[free[better]], way[free[better]] = new[better], at
            nxt = free[reach[free].argmin()]
            step = reach[nxt]
            u[taken[used]] += step
            v[used] -= step
            reach[~used] -= step
            at = nxt
            if not taken[at]:
                break
        while at:
            taken[at], at = taken[way[at]], way[at]
    p = [0] * k
    for j in range(1, k + 1):
        p[taken[j] - 1] = j - 1
    return float(cost[np.arange(k), p].sum()), tuple(p)


def distance(a: Merged, b: Merged) -> tuple[float, tuple[int, ...]]:
    """Infinite where no base that both cover has coverage and a member."""
    k = a.w.shape[1]
    identity = tuple(range(k))
    first, last = max(a.begin, b.begin), min(a.end, b.end)
    penalty = ((first - min(a.begin, b.begin)) + (max(a.end, b.end) - last)) * PENALTY / 2
    if first >= last:
        return float("inf"), identity
    ca, cb = a.coverage[first - a.begin : last - a.begin], b.coverage[first - b.begin : last - b.begin]
    both = ca + cb
    live = both > 0
    shares = np.divide(ca, both, out=np.zeros(len(both)), where=live)[:, None, None]
    wa, wb = a.w[first - a.begin : last - a.begin], b.w[first - b.begin : last - b.begin]
    mean = wa[:, :, None] * shares + wb[:, None, :] * (1 - shares)  # [base, cluster of a, cluster of b]
    cost, met = np.zeros((k, k)), False
    for side, cover, axis in ((a, ca, 2), (b, cb, 1)):
        scale = cover / (side.high() or 1.0)
        for begin, w in side.members:
            lo, hi = max(first, begin), min(last, begin + len(w))
            if lo >= hi or not live[lo - first : hi - first].any():
                continue
            met = True
            at = slice(lo - first, hi - first)
            own = np.expand_dims(w[lo - begin : hi - begin], axis)
            cost += (np.abs(own - mean[at]) * (scale[at] * live[at])[:, None, None]).sum(axis=0)
    if not met:
        return float("inf"), identity
    least, p = matching(cost)
    return least + penalty, p


def merged(a: Merged, b: Merged, p: tuple[int, ...]) -> Merged:
    """b's clusters relabelled to a's, weights averaged by coverage where both stand, copied elsewhere."""
    p = list(p)
    begin, end, k = min(a.begin, b.begin), max(a.end, b.end), a.w.shape[1]
    sums, cover, plain = np.zeros((end - begin, k)), np.zeros(end - begin), np.zeros((end - begin, k))
    sides = np.zeros(end - begin)
    for m, w in ((a, a.w), (b, b.w[:, p])):
        at = slice(m.begin - begin, m.end - begin)
        sums[at] += w * m.coverage[:, None]
        plain[at] += w
        cover[at] += m.coverage
        sides[at] += 1
    w = np.where(cover[:, None] > 0, sums / np.where(cover, cover, 1)[:, None], plain / np.maximum(sides, 1)[:, None])
    return Merged(begin, quantized(w), cover, a.members + [(s, v[:, p]) for s, v in b.members])


def merge_windows(windows: list[Merged]) -> Merged:
    """The closest pair is merged until one is left; of pairs that don't meet, the one that spans least."""
    live = sorted(windows, key=lambda m: m.begin)
    known = {(i, j): distance(live[i], live[j]) for i in range(len(live)) for j in range(i + 1, len(live)) if live[j].begin < live[i].end}
    left = dict(enumerate(live))
    while len(left) > 1:
        finite = [(d, ij) for ij, (d, _) in known.items() if d < float("inf")]
        if finite:
            i, j = min(finite)[1]
            p = known[i, j][1]
        else:
            i, j = min(((max(left[a].end, left[b].end) - min(left[a].begin, left[b].begin), (a, b)) for a in left for b in left if a < b))[1]
            p = tuple(range(left[i].w.shape[1]))
        left[i] = merged(left[i], left.pop(j), p)
        known = {ij: x for ij, x in known.items() if j not in ij and i not in ij}
        for o in left:
            if o != i and left[o].begin < left[i].end and left[i].begin < left[o].end:
                known[min(i, o), max(i, o)] = distance(left[min(i, o)], left[max(i, o)])
    return next(iter(left.values()))
