"""Normal, t, chi-squared, F and beta distributions."""

from __future__ import annotations

import math
from collections.abc import Callable


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def beta_sf(x: float, a: float, b: float) -> float:
    return beta_cdf(1 - x, b, a)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_sf(t: float, df: float) -> float:
    if math.isinf(df):
        return norm_sf(t)
    half = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return half if t >= 0 else 1 - half


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return chi2_sf(f * d1, d1) if math.isinf(d2) else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: float) -> float:
    """Upper regularised incomplete gamma at half of each."""
    a, x = df / 2, x / 2
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
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def quantile(sf: Callable[[float], float], upper: float, lo: float = 0.0, hi: float = 1.0) -> float:
    """x with sf(x) = upper, for a falling sf, by doubling and bisection."""
    while sf(hi) > upper and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sf(mid) > upper else (lo, mid)
    return (lo + hi) / 2


def t_ppf(p: float, df: float) -> float:
    return quantile(lambda x: t_sf(x, df), 1 - p) if p >= 0.5 else -t_ppf(1 - p, df)


def norm_ppf(p: float) -> float:
    return quantile(norm_sf, 1 - p) if p >= 0.5 else -norm_ppf(1 - p)


def beta_ppf(p: float, a: float, b: float) -> float:
    return quantile(lambda x: beta_sf(x, a, b), 1 - p, 0.0, 1.0)
