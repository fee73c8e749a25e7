"""How many conformations a window holds: eigengaps against a permutation null model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..params import Params
from .distributions import looks_weibull, weibull_cdf, weibull_fit, weibull_moments
from .spectral import adjacency, clip, eigengaps, incidence

SIGNIFICANT, UNDECIDED, NULL_LIKE = "significant", "undecided", "null-like"


@dataclass
class Detection:
    n_clusters: int
    status: str
    gaps: list[float] = field(default_factory=list)
    null_gaps: list[list[float]] = field(default_factory=list)
    bases: list[int] = field(default_factory=list)
    #: Numbers of all gaps that were found significant, also those beyond the last valid one.
    significant: list[int] = field(default_factory=list)


@dataclass
class Null:
    """The permuted values of one eigengap, and whether a Weibull distribution was found to fit them."""

    values: list[float] = field(default_factory=list)
    fits: bool = False

    def moments(self) -> tuple[float, float]:
        return float(np.mean(self.values)), float(np.std(self.values, ddof=1)) if len(self.values) > 1 else 0.0

    def distance(self, gap: float, fitted: bool) -> float:
        """How far beyond one standard deviation the gap lies."""
        mean, sd = weibull_moments(*weibull_fit(np.array(self.values))) if fitted else self.moments()
        return max(abs(gap - mean) - sd, 0.0)

    def verdict(self, gap: float, permutation: int, p: Params) -> tuple[str, bool]:
        """The verdict on a data gap, and whether the fitted distribution gave it."""
        if not self.fits:
            mean, sd = self.moments()
            if sd < p.min_null_stdev:
                return (SIGNIFICANT if abs(gap - mean) > 3 * sd else NULL_LIKE), False
            if permutation >= p.extra_permutations:
                return SIGNIFICANT, False
        shape, scale = weibull_fit(np.array(self.values))
        if not self.fits:
            self.fits = looks_weibull(np.array(self.values), shape, scale)
            if not self.fits:
                return UNDECIDED, True
        cdf = float(weibull_cdf(gap, shape, scale))
        tail = 2 * min(cdf, 1 - cdf)
        return (SIGNIFICANT if tail < p.alpha else UNDECIDED if tail < p.beta else NULL_LIKE), True


def base_filter(mutations: np.ndarray, coverage: np.ndarray, allowed: np.ndarray, p: Params) -> np.ndarray:
    """The bases of the first filter, by number."""
    share = np.divide(mutations, coverage, out=np.zeros(len(coverage)), where=coverage > 0)
    return np.flatnonzero(allowed & (coverage >= p.min_base_coverage) & (share > p.min_mutation_freq) & (mutations > p.min_base_mutations))


def null_adjacency(n_reads: int, mutations: np.ndarray, least: int, rng: np.random.Generator, rows: int = 50_000) -> tuple[np.ndarray, int]:
    """Co-mutation of reads with at least ``least`` marks, when every base's marks fall on random reads; and how many there are.

    What permuting the columns of the real reads gives, from their sums alone. Reads
    are made in blocks of bounded size: how many of a base's marks fall into a block
    is drawn first (without replacement; beyond a billion reads, where that draw
    isn't offered, with).
    """
    left, left_rows = mutations.astype(np.int64).copy(), int(n_reads)
    total, kept = np.zeros((len(left), len(left))), 0
    while left_rows > 0:
        m = min(rows, left_rows)
        if m == left_rows:
            here = left.copy()
        elif left_rows < 1_000_000_000:
            here = rng.hypergeometric(left, left_rows - left, m)
        else:
            here = np.minimum(rng.binomial(m, left / left_rows), left)
        x = np.zeros((m, len(left)), dtype=np.float32)
        for j, k in enumerate(np.minimum(here, m)):
            x[rng.choice(m, int(k), replace=False, shuffle=False), j] = 1
        x = x[x.sum(axis=1) >= least]
        total += x.T @ x
        kept += len(x)
        left -= here
        left_rows -= m
    return total, kept


#: Reads of a window up to which its permuted reads are made one by one.
MOST_MADE = 500_000


def _at_least(shares: np.ndarray, least: int) -> np.ndarray:
    """For each pair i, j (and, on the diagonal, each i): the chance of at least ``least`` marks on the other bases."""
    k = len(shares)
    if least <= 0:
        return np.ones((k, k))
    below = np.zeros((least, k, k))
    below[0] = 1.0
    for b, share in enumerate(shares):
        after = below * (1 - share)
        after[1:] += below[:-1] * share
        after[:, b, :], after[:, :, b] = below[:, b, :], below[:, :, b]
        below = after
    return 1 - below.sum(axis=0)


def null_drawn(n_reads: int, mutations: np.ndarray, least: int, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """What null_adjacency gives, drawn cell by cell: its work doesn't grow with the reads.

    Reads that carry two bases are hypergeometric (normal, at these numbers); of
    them, and of a base's reads, those with enough marks are a binomial share. Cells
    are drawn apart; in permuted reads they depend on each other only through marks
    that meet threefold.
    """
    m, n, k = mutations.astype(float), float(n_reads), len(mutations)
    shares = m / n
    mean = np.outer(m, m) / n
    sd = np.sqrt(mean * np.outer(1 - shares, 1 - shares) * n / max(n - 1, 1))
    pairs = np.clip(np.rint(rng.normal(mean, sd)), 0, np.minimum.outer(m, m))
    upper = np.triu(pairs, 1).astype(np.int64)
    upper = rng.binomial(upper, np.clip(_at_least(shares, least - 2), 0, 1))
    own = rng.binomial(mutations.astype(np.int64), np.clip(np.diag(_at_least(shares, least - 1)), 0, 1))
    marks = np.zeros(max(least, 1))
    marks[0] = 1.0
    for share in shares:
        marks[1:] = marks[1:] * (1 - share) + marks[:-1] * share
        marks[0] *= 1 - share
    kept = n_reads if least <= 0 else int(rng.binomial(int(n_reads), min(1.0, max(0.0, 1 - marks.sum()))))
    return (upper + upper.T + np.diag(own)).astype(float), kept


def detect(idx: list, coverage: np.ndarray, allowed: np.ndarray, p: Params, seed: int) -> Detection:
    """From the reads of a window (mutated bases each), its coverage, and which bases the probe may modify."""
    x = incidence(idx, len(coverage))
    bases = base_filter(x.sum(axis=0), coverage, allowed, p)
    x = x[:, bases]
    kept = x[x.sum(axis=1) >= p.min_read_mutations]
    return detect_counts(len(x), bases, x.sum(axis=0), coverage[bases], len(kept), adjacency(kept), p, seed)


def detect_counts(n_reads: int, bases: np.ndarray, mutations: np.ndarray, coverage: np.ndarray, n_filtered: int, a: np.ndarray, p: Params, seed: int) -> Detection:
    """From counts alone: all reads, the kept bases with their mutations and coverage, the reads with enough mutations on them, and their co-mutation.

    Its input is bounded by the square of a window's size, whatever the number of reads.
    """
    bases = np.asarray(bases)
    root = np.sqrt(coverage / coverage.max()) if len(bases) else np.ones(0)
    scale = np.outer(root, root)

    def gaps_of(matrix: np.ndarray) -> np.ndarray:
        return eigengaps(clip(np.divide(matrix, scale, out=np.zeros_like(scale), where=scale > 0), p.max_mutation_freq))

    if n_filtered < p.min_filtered_reads:
        return Detection(0, "few reads", bases=bases.tolist())
    if len(bases) < p.min_win_bases or len(bases) < 2:
        return Detection(0, "few bases", bases=bases.tolist())
    gaps = gaps_of(a)
    useful = min(len(gaps) // 2, p.max_clusters)
    if not gaps.any() or not useful:
        return Detection(0, "no gaps", gaps.tolist(), bases=bases.tolist())

    nulls, significant = [Null() for _ in gaps], []
    rng = np.random.default_rng(seed)

    def done(n: int, status: str) -> Detection:
        return Detection(n, status, gaps.tolist(), [g.values for g in nulls], bases.tolist(), significant)

    at, valid = (1, 0) if p.ignore_first_eigengap else (0, -1)

    def in_reach() -> bool:
        return at < useful and (at == 0 or (valid >= 0 and at <= valid + p.lookahead_eigengaps + 1))

    for permutation in range(p.max_permutations):
        # The reads of a hot window aren't made, so its task takes no longer than others.
        null, left = (null_adjacency if n_reads <= MOST_MADE else null_drawn)(n_reads, mutations, p.min_read_mutations, rng)
        if left < p.min_filtered_reads:
            return done(0, "few permuted reads")
        for g, value in zip(nulls, gaps_of(null), strict=True):
            g.values.append(max(float(value), 1e-6))
        if permutation < p.min_permutations:
            continue
        while in_reach():
            verdict, fitted = nulls[at].verdict(gaps[at], permutation, p)
            if verdict == UNDECIDED and (at == 0 or permutation < p.max_permutations - 1):
                break
            if verdict == SIGNIFICANT:
                significant.append(at)
                distance = nulls[at].distance(gaps[at], fitted)
                if distance >= p.eigengap_abs_thresh:
                    if distance >= p.eigengap_cum_rel_thresh * sum(nulls[g].distance(gaps[g], False) for g in range(at)):
                        valid = at
                elif at == 0:
                    return done(0, "small first gap")
            elif verdict == NULL_LIKE and at == 0:
                return done(0, "first gap like the null model")
            at += 1
        if not in_reach():
            return done(valid + 1, "ok")
    return done(0, "first gap undecided") if valid < 0 else done(valid + 1, "undecided")
