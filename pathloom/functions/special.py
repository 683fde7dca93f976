"""Numbers that Spark has no function for: Student's t quantile, digamma at integers."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_cdf(t: float, df: float) -> float:
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t >= 0 else tail


def t_critical(delta: float, df: int) -> float:
    """The one-sided quantile at 1 - delta; 0 below one degree of freedom."""
    if df < 1 or not 0 < delta < 1:
        return 0.0
    if delta > 0.5:
        return -t_critical(1 - delta, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < 1 - delta:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < 1 - delta else (low, mid)
    return (low + high) / 2


def digamma(n: int) -> float:
    """At a positive integer: harmonic number less Euler's constant."""
    if n < 50:
        return sum(1 / k for k in range(1, n)) - 0.5772156649015329
    x = float(n)
    return math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
