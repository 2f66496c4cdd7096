"""Distribution tails and normality tests in numpy, without scipy.

Upper tails are computed directly, never as one minus a lower tail, so that very
small p-values keep their relative accuracy.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)
_TINY = 1e-300


def lgamma(x):
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    out[x <= 0], out[x >= 1] = 0.0, 1.0
    ok = (x > 0) & (x < 1)
    swap = ok & (x > (a + 1) / (a + b + 2))
    aa, bb, xx = np.where(swap, b, a)[ok], np.where(swap, a, b)[ok], np.where(swap, 1 - x, x)[ok]
    if xx.size:
        front = np.exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
        value = front * _beta_fraction(aa, bb, xx)
        out[ok] = np.where(swap[ok], 1 - value, value)
    return out


def _beta_fraction(a, b, x, rounds: int = 500):
    """Continued fraction of the incomplete beta function by Lentz's method."""
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return h


def f_sf(f, d1, d2):
    """P(F > f) with d1 and d2 degrees of freedom; 1 for f <= 0, NaN stays."""
    f = np.asarray(f, float)
    with np.errstate(over="ignore", invalid="ignore"):
        out = betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * np.maximum(f, 0)))
    return np.where(np.isnan(f), np.nan, out)


def t_sf2(t, df):
    """Two-sided tail of Student's t."""
    return f_sf(np.square(np.asarray(t, float)), 1, df)


def gammaincc(a, x):
    """Regularised upper incomplete gamma function Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(x.shape)
    low = (x > 0) & (x < a + 1)
    high = x >= a + 1
    if low.any():
        aa, xx = a[low], x[low]
        term = total = 1 / aa
        n = aa.copy()
        for _ in range(1000):
            n = n + 1
            term = term * xx / n
            total = total + term
            if np.all(term < total * 1e-16):
                break
        out[low] = 1 - total * np.exp(-xx + aa * np.log(xx) - lgamma(aa))
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c = np.full_like(xx, 1 / _TINY)
        d = 1 / b
        h = d
        for i in range(1, 1000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[high] = np.exp(-xx + aa * np.log(xx) - lgamma(aa)) * h
    return out


def chi2_sf(x, df):
    """P(chi-square > x)."""
    x = np.asarray(x, float)
    if np.ndim(df) == 0 and df == 1:
        return np.asarray(_erfc(np.sqrt(np.maximum(x, 0) / 2)), float)
    return gammaincc(np.asarray(df, float) / 2, np.maximum(x, 0) / 2)


def normal_sf(z):
    return np.asarray(_erfc(np.asarray(z, float) / math.sqrt(2)), float) / 2


def kolmogorov_sf(d: float, n: float) -> float:
    """Asymptotic tail of the Kolmogorov statistic with Stephens' correction."""
    if n <= 0:
        return 1.0
    root = math.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * d
    if x < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * x**2)))))


#: Polynomials of Royston's approximation (fixed values).
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_MU_SMALL, _SD_SMALL = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
_MU_LARGE, _SD_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _poly(c, x: float) -> float:
    return sum(k * x**i for i, k in enumerate(c))


def shapiro_wilk(values) -> tuple[float, float]:
    """(W, p) of the Shapiro-Wilk test; (NaN, NaN) below 3 values or without spread."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or not np.isfinite(x).all() or x[-1] - x[0] < 1e-19:
        return math.nan, math.nan
    half = n // 2
    a = np.zeros(n)
    if n == 3:
        a[-1] = math.sqrt(0.5)
    else:
        inv = NormalDist().inv_cdf
        m = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        ss = float(m @ m)
        u = 1 / math.sqrt(n)
        last = m[-1] / math.sqrt(ss) + _poly(_C1, u)
        if n > 5:
            second = m[-2] / math.sqrt(ss) + _poly(_C2, u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[half:] = m[half:] / math.sqrt(phi)
            a[-2] = second
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[half:] = m[half:] / math.sqrt(phi)
        a[-1] = last
    a[:half] = -a[::-1][:half]
    if n % 2:
        a[half] = 0.0
    w = min(1.0, float(a @ x) ** 2 / float(np.sum((x - x.mean()) ** 2)))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    rest = max(1 - w, 1e-300)
    if n <= 11:
        edge = 0.459 * n - 2.273
        if math.log(rest) >= edge:
            return w, 0.0
        y, mu, sd = -math.log(edge - math.log(rest)), _poly(_MU_SMALL, n), math.exp(_poly(_SD_SMALL, n))
    else:
        u = math.log(n)
        y, mu, sd = math.log(rest), _poly(_MU_LARGE, u), math.exp(_poly(_SD_LARGE, u))
    return w, float(normal_sf((y - mu) / sd))


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Column form of f_sf; NULL where an argument is NULL."""
    return pd.Series(f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Column form of chi2_sf."""
    return pd.Series(gammaincc(df.to_numpy(float) / 2, np.maximum(x.to_numpy(float), 0) / 2))


def log_choose(n: int, k: int) -> float:
    """Logarithm of the binomial coefficient; 0 for k below 1."""
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 < k < n else 0.0


def neg_log10(p: Column) -> Column:
    """-log10 of a p-value; 323 where it is exactly zero."""
    return F.when(p == 0, 323.0).otherwise(-F.log10(p))
