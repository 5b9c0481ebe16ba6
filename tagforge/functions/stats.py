"""Special functions in numpy and math: log-gamma, tails of chi-square, normal and t."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        for _ in range(1000):
            k += 1
            term *= x / k
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_sf(q: float, df: float) -> float:
    return _gamma_q(df / 2.0, q / 2.0) if df > 0 else math.nan


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t)) if df > 0 else math.nan


def _nullable(f):
    return lambda *a: None if any(v is None or v != v for v in a) else f(*a)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(q: pd.Series, df: pd.Series) -> pd.Series:
    f = _nullable(chi2_sf)
    return pd.Series([f(a, b) for a, b in zip(q, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    f = _nullable(lambda v: 2 * normal_sf(abs(v)))
    return pd.Series([f(v) for v in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    f = _nullable(t_two_sided)
    return pd.Series([f(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")
