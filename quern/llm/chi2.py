"""The chi-square distribution, for stopping tests and cut-offs."""

from __future__ import annotations

import math


def cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom <= x), by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    if x > a + 60 + 12 * math.sqrt(a):
        return 1.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while cdf(high, k) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, k) < p else (low, mid)
    return high
