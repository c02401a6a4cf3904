"""Tail areas and quantiles for the handful of numbers in a model summary."""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: power series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            return front * h
    raise ArithmeticError(f"the fraction does not settle for a = {a}, x = {x}")


def chi2_upper(x: float, df: float) -> float:
    return _gamma_upper(df / 2, x / 2)


def _beta_reg(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_reg(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * h
    raise ArithmeticError(f"the fraction does not settle for a = {a}, b = {b}, x = {x}")


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(df):
        return normal_two_sided(t)
    return _beta_reg(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    """Quantile for p above one half, by bisection on the tail area."""
    if not df > 0:
        return math.nan
    if df > 1e7:
        return normal_quantile(p)
    tail = 2 * (1 - p)
    lo, hi = 0.0, 2.0
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > tail else (lo, mid)
        if hi - lo <= 1e-14 * hi:
            break
    return (lo + hi) / 2
