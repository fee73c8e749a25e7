"""Whole-number helpers, exact or an error."""

from __future__ import annotations

from math import comb, gcd
from math import factorial as exact_factorial

MOST = 2**64 - 1


def factorial(n: int) -> int:
    if not 0 <= n <= 22:
        raise ValueError("factorial is defined from 0 to 22")
    return exact_factorial(n)


def binomial(n: int, k: int) -> int:
    """n over k; an error beyond 64 bits."""
    out = comb(n, k) if 0 <= k <= n else 0
    if out > MOST:
        raise OverflowError("binomial coefficient beyond 64 bits")
    return out


def binomial_float(n: int, k: int) -> float:
    return float(comb(n, k)) if 0 <= k <= n else 0.0


__all__ = ["binomial", "binomial_float", "factorial", "gcd"]
