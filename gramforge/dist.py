"""Distribution functions in numpy: normal, chi-square, t and F, with quantiles by bisection on the tails."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_TINY = 1e-300


def norm_pdf(x):
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


_erfc = np.frompyfunc(math.erfc, 1, 1)


def norm_cdf(x):
    return np.asarray(0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def norm_sf(x):
    return np.asarray(0.5 * _erfc(np.asarray(x, float) / math.sqrt(2)), float)


def lgamma(x):
    """Logarithm of the gamma function for positive arguments: recurrence to 8 and above, then Stirling's series."""
    x = np.array(x, float, copy=True)
    shift = np.ones_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift = np.where(low, shift * x, shift)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def digamma(x):
    """Recurrence up to 10, then the asymptotic series."""
    x = np.array(x, float, copy=True)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x):
    x = np.array(x, float, copy=True)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        out = np.where(low, out + 1 / (x * x), out)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    return 1 - front * _gamma_fraction(a, x)


def gamma_q(a: float, x: float) -> float:
    if x < a + 1:
        return 1 - gamma_p(a, x)
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * _gamma_fraction(a, x)


def _gamma_fraction(a: float, x: float) -> float:
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 or math.isnan(x) else gamma_q(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 or math.isnan(x) else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf(x: float, df: float) -> float:
    """Upper tail of Student's t."""
    if math.isnan(x):
        return math.nan
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x)) if math.isfinite(x) else 0.0
    return tail if x >= 0 else 1 - tail


def t_two_sided(x: float, df: float) -> float:
    return 2 * t_sf(abs(x), df)


def norm_two_sided(x: float) -> float:
    return float(2 * norm_sf(abs(x)))


def _invert(sf: Callable[[float], float], p: float, lo: float, hi: float) -> float:
    """x with sf(x) = p for a falling sf; the bracket is widened as needed."""
    while sf(hi) > p and hi < 1e300:
        hi *= 2
    while sf(lo) < p and lo > -1e300:
        lo = lo * 2 if lo < 0 else lo / 2
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if sf(mid) > p else (lo, mid)
    return 0.5 * (lo + hi)


def norm_ppf(p: float) -> float:
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    return 0.0 if p == 0.5 else _invert(lambda x: float(norm_sf(x)), 1 - p, -8.0, 8.0) if p > 1e-10 else -_invert(lambda x: float(norm_sf(x)), p, 0.0, 40.0)


def t_ppf(p: float, df: float) -> float:
    return _invert(lambda x: t_sf(x, df), 1 - p, -16.0, 16.0)


def chi2_ppf(p: float, df: float) -> float:
    return _invert(lambda x: chi2_sf(x, df), 1 - p, 1e-12, df + 16.0)


def f_ppf(p: float, d1: float, d2: float) -> float:
    return _invert(lambda x: f_sf(x, d1, d2), 1 - p, 1e-12, 16.0)
