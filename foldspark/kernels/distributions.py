"""Weibull maximum likelihood and exact Kolmogorov-Smirnov critical values, without a statistics library."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp, gamma, log

import numpy as np


def weibull_fit(x: np.ndarray, most_shape: float = 1e4) -> tuple[float, float]:
    """Shape (at least 1) and scale of positive values.

    For a given shape the best scale is known, so the likelihood is a function of
    the shape alone, whose derivative has one root: it is bracketed and halved.
    """
    x = np.asarray(x, dtype=float)
    top = x.max()
    z = x / top
    logs = np.log(np.maximum(z, 1e-300))
    mean = logs.mean()

    def slope(k: float) -> float:
        p = np.exp(k * logs)
        return float((p * logs).sum() / p.sum() - 1 / k - mean)

    low, high = 1.0, 2.0
    if slope(low) >= 0:
        shape = 1.0
    else:
        while slope(high) < 0 and high < most_shape:
            low, high = high, high * 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if slope(mid) < 0 else (low, mid)
        shape = (low + high) / 2
    return shape, float(np.mean(z**shape) ** (1 / shape) * top)


def weibull_cdf(x, shape: float, scale: float):
    return -np.expm1(-((np.asarray(x, dtype=float) / scale) ** shape))


def weibull_moments(shape: float, scale: float) -> tuple[float, float]:
    one = gamma(1 + 1 / shape)
    return scale * one, scale * max(gamma(1 + 2 / shape) - one * one, 0.0) ** 0.5


def weibull_log_likelihood(x: np.ndarray, shape: float, scale: float) -> float:
    x = np.asarray(x, dtype=float)
    return float(len(x) * (log(shape) - shape * log(scale)) + (shape - 1) * np.log(x).sum() - ((x / scale) ** shape).sum())


def ks_cdf(n: int, d: float) -> float:
    """P(D_n < d), exactly (Marsaglia, Tsang and Wang, 2003): a middle cell of the n-th power of a band matrix."""
    if d <= 0:
        return 0.0
    if d >= 1:
        return 1.0
    k = ceil(n * d)
    h, m = k - n * d, 2 * k - 1
    i, j = np.indices((m, m))
    cells = (i - j + 1 >= 0).astype(float)
    edge = h ** np.arange(1, m + 1)
    cells[:, 0] -= edge
    cells[-1, :] -= edge[::-1]
    if 2 * h - 1 > 0:
        cells[-1, 0] += (2 * h - 1) ** m
    factorials = np.array([gamma(max(x, 0) + 1) if x < 170 else float("inf") for x in range(m + 1)])
    cells /= factorials[np.maximum(i - j + 1, 0)]
    power, shift = np.linalg.matrix_power(np.eye(m), 1), 0.0
    base, base_shift, left = cells, 0.0, n
    while left:
        if left & 1:
            power, shift = power @ base, shift + base_shift
        base, base_shift, left = base @ base, 2 * base_shift, left >> 1
        size = base[k - 1, k - 1]
        if size > 1e140:
            base, base_shift = base / size, base_shift + log(size)
    value = log(max(power[k - 1, k - 1], 1e-300)) + shift + sum(log(x / n) for x in range(1, n + 1))
    return min(1.0, max(0.0, exp(min(value, 0.0))))


@lru_cache(maxsize=4096)
def ks_critical(n: int, alpha: float) -> float:
    """The distance that D_n exceeds with probability alpha."""
    low, high = 0.5 / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - ks_cdf(n, mid) > alpha else (low, mid)
    return (low + high) / 2


def fit_distance(sample: np.ndarray, shape: float, scale: float) -> float:
    """The 90th percentile of |cdf - share of the running sum|."""
    v = np.sort(sample)
    gaps = np.sort(np.abs(weibull_cdf(v, shape, scale) - v.cumsum() / v.sum()))
    return float(gaps[max(int(len(v) * 0.90), 1) - 1])


def looks_weibull(sample: np.ndarray, shape: float, scale: float, alpha: float = 0.10) -> bool:
    """Whether the sample is closer to the distribution than the critical distance."""
    return fit_distance(sample, shape, scale) < ks_critical(len(sample), alpha)
