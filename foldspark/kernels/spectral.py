"""Dense linear algebra of one window: adjacency, Laplacian, eigengaps, null shuffles, bipartition."""

from __future__ import annotations

import numpy as np


def incidence(idx: list, n_bases: int) -> np.ndarray:
    """Reads by bases, 0 or 1."""
    x = np.zeros((len(idx), n_bases), dtype=np.float32)
    sizes = [len(i) for i in idx]
    if sum(sizes):
        x[np.repeat(np.arange(len(idx)), sizes), np.concatenate([np.asarray(i, dtype=int) for i in idx if len(i)])] = 1
    return x


def adjacency(x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Reads that carry both bases, over the root of the bases' weights (0 where one has none)."""
    a = (x.T @ x).astype(np.float64)
    if weights is not None:
        scale = np.sqrt(np.outer(weights, weights))
        a = np.divide(a, scale, out=np.zeros_like(a), where=scale > 0)
    return a


def clip(a: np.ndarray, most: float) -> np.ndarray:
    """Off-diagonal cells over ``most`` times the lower base's diagonal become 0."""
    upper = np.triu(a, 1)
    upper[upper > most * np.diag(a)[:, None]] = 0
    return upper + upper.T + np.diag(np.diag(a))


def normalized_laplacian(a: np.ndarray) -> np.ndarray:
    a = a - np.diag(np.diag(a))
    d = a.sum(axis=1)
    root = 1 / np.sqrt(np.where(np.abs(d) < 1e-4, 1.0, d))
    return (np.diag(d) - a) * np.outer(root, root)


def eigenvectors(a: np.ndarray) -> np.ndarray:
    """Of the normalized Laplacian, as columns by ascending eigenvalue."""
    return np.linalg.eigh(normalized_laplacian(a))[1]


def eigengaps(a: np.ndarray) -> np.ndarray:
    return np.diff(np.linalg.eigvalsh(normalized_laplacian(a)))


def perturbed(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each base's mutations put on reads drawn without replacement; column sums stay."""
    return rng.permuted(x, axis=0)


def rows_perturbed(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each read's mutations put on bases drawn without replacement; row sums stay."""
    return rng.permuted(x, axis=1)


def bipartition(a: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Labels 0 and 1 from two means on the Fiedler vector, started at its extremes."""
    v = np.linalg.eigh(normalized_laplacian(a))[1][:, 1]
    low, high = v.min(), v.max()
    labels = np.zeros(len(v), dtype=int)
    for _ in range(rounds):
        new = (np.abs(v - high) < np.abs(v - low)).astype(int)
        if (new == labels).all() and _:
            break
        labels = new
        if 0 < labels.sum() < len(v):
            low, high = v[labels == 0].mean(), v[labels == 1].mean()
    return labels
