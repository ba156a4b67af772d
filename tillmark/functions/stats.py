"""Student t probabilities as a vectorised function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


_ln_gamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation), for all elements at a time."""
    away = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1.0 / away(1.0 - (a + b) * x / (a + 1))
    h, open_ = d.copy(), np.ones(len(x), dtype=bool)
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / away(1.0 + step * d)
            c = away(1.0 + step / c)
            h = np.where(open_, h * d * c, h)
        open_ &= np.abs(d * c - 1.0) >= 1e-14
        if not open_.any():
            break
    return h


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = (x >= 1).astype(float)
    inside = (x > 0) & (x < 1)
    a, b, x = a[inside], b[inside], x[inside]
    front = np.exp(_ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b) + a * np.log(x) + b * np.log1p(-x)) if len(x) else x
    low = x < (a + 1) / (a + b + 2)  # elsewhere the fraction of the complement converges faster
    fraction = _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x))
    part = front * fraction / np.where(low, a, b)
    out[inside] = np.where(low, part, 1.0 - part)
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values; NaN where t or the degrees of freedom are missing or not positive."""
    t, df = np.atleast_1d(np.asarray(t, dtype=float)), np.atleast_1d(np.asarray(df, dtype=float))
    out = np.full(len(t), np.nan)
    known = ~np.isnan(t) & ~np.isnan(df) & (df > 0)
    t, df = t[known], df[known]
    out[known] = _incomplete_beta(df / 2, np.full(len(df), 0.5), df / (df + t * t))
    return out


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value; the value of F(1, df) at t squared is the same."""
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))
