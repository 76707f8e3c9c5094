"""Tail probabilities of the t, F, chi-squared, normal and studentized range distributions.

They are applied to finished test statistics, one number per test.
"""

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


# Beyond so many degrees of freedom log-gamma differences lose digits, and the limits are exact to more of them.
MANY = 1e6


def t_sf(t: float, dof: float) -> float:
    """P(T > t)."""
    if dof > MANY:
        return normal_sf(t)
    half = 0.5 * betainc(dof / 2, 0.5, dof / (dof + t * t))
    return half if t >= 0 else 1.0 - half


def f_sf(f: float, d1: float, d2: float) -> float:
    if f > 0 and d2 > MANY:
        return chi2_sf(f * d1, d1)
    if f > 0 and d1 > MANY:
        return 1.0 - chi2_sf(d2 / f, d2)
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, dof: float) -> float:
    """Upper regularised incomplete gamma: a series below the mean, a continued fraction above."""
    if dof > MANY and x > 0:
        # The cube root of x / dof is as good as normal.
        return normal_sf((math.cbrt(x / dof) - 1 + 2 / (9 * dof)) / math.sqrt(2 / (9 * dof)))
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(maxsize=4096)
def t_ppf(p: float, dof: float) -> float:
    """Quantile by bisection on the tail."""
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - t_sf(mid, dof) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def studentized_range_sf(q: float, k: int, dof: float) -> float:
    """P(range of k means / pooled s > q), by numeric integration over the means and over s."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 801)
    dz = z[1] - z[0]
    erf = np.vectorize(math.erf)
    cdf = lambda v: 0.5 * (1 + erf(v / math.sqrt(2)))
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    below = lambda w: k * float(np.sum(density * (cdf(z) - cdf(z - w)) ** (k - 1)) * dz)
    spread = 8 / math.sqrt(2 * dof)
    s = np.linspace(max(1e-6, 1 - spread), 1 + spread, 121)
    log_pdf = (
        math.log(2) + (dof / 2) * math.log(dof / 2) - math.lgamma(dof / 2) + (dof - 1) * np.log(s) - dof * s * s / 2
    )
    w = np.exp(log_pdf)
    return float(min(1.0, max(0.0, 1 - np.sum(w * np.array([below(q * x) for x in s])) / np.sum(w))))


def betainc_many(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``betainc`` of a whole batch: the fraction goes on for the rows that have not settled."""
    a, b, x = (np.asarray(v, float).copy() for v in np.broadcast_arrays(a, b, x))
    out = np.where(x <= 0, 0.0, 1.0)
    at = np.flatnonzero((x > 0) & (x < 1))
    a, b, x = a[at], b[at], x[at]
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) if len(at) else x
    swap = x >= (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    big = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c = np.ones(len(at))
    d = 1 / big(1 - (a + b) * x / (a + 1))
    h, todo = d.copy(), np.arange(len(at))
    for m in range(1, 1000):
        p, q, y = a[todo], b[todo], x[todo]
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d[todo] = 1 / big(1 + num * d[todo])
            c[todo] = big(1 + num / c[todo])
            h[todo] *= d[todo] * c[todo]
        todo = todo[np.abs(d[todo] * c[todo] - 1) >= 1e-15]
        if not len(todo):
            break
    value = front * h / a
    out[at] = np.where(swap, 1 - value, value)
    return out


def t_sf_many(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(T > t) of a batch."""
    t, dof = (np.asarray(v, float) for v in np.broadcast_arrays(t, dof))
    half = 0.5 * betainc_many(dof / 2, 0.5, dof / (dof + t * t))
    exact = np.where(t >= 0, half, 1 - half)
    return np.where(dof > MANY, 0.5 * np.vectorize(math.erfc, otypes=[float])(t / math.sqrt(2)), exact) if len(t) else exact


def _column(fn, *args: Column) -> Column:
    """Apply a scalar tail function to a few finished statistics."""

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(fn(*row)) for row in zip(*cols)], dtype="float64")

    return run(*[a.cast("double") for a in args])


def p_t(t: Column, dof: Column, alternative: str = "two-sided") -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, dof: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=t.index, dtype="float64")
        known = t.notna() & dof.notna()
        out[known] = t_sf_many(t[known].to_numpy(float), dof[known].to_numpy(float))
        return out.where(known, None)

    if alternative == "two-sided":
        return 2 * run(F.abs(t).cast("double"), dof.cast("double"))
    return run((t if alternative == "greater" else -t).cast("double"), dof.cast("double"))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, f, d1, d2)


def p_chi2(x: Column, dof: Column) -> Column:
    return _column(chi2_sf, x, dof)
