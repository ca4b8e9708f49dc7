"""Quantiles of the beta distribution, for Jeffreys intervals: no built-in has them, so numpy does, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def regularised(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b) by Lentz's continued fraction, on the side where it converges fast."""
    x, a, b = (np.asarray(v, dtype=np.float64) for v in np.broadcast_arrays(x, a, b))
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    inside = (x > 0) & (x < 1)
    safe = np.where(inside, x, 0.5)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(safe) + b * np.log1p(-safe)) / a
    tiny = 1e-300
    c, d = np.ones_like(safe), 1 - (a + b) * safe / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for odd in (False, True):
            if odd:
                k = -(a + m) * (a + b + m) * safe / ((a + 2 * m) * (a + 2 * m + 1))
            else:
                k = m * (b - m) * safe / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    value = np.where(inside, front * h, np.where(x >= 1, 1.0, 0.0))
    return np.where(turn, 1 - value, value)


def quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with I_x(a, b) = p, by bisection."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(52):
        mid = (low + high) / 2
        less = regularised(mid, a, b) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def jeffreys(x: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The central 95 % of Beta(x + 1/2, n - x + 1/2)."""
    a, b = x.to_numpy(dtype=float) + 0.5, (n - x).to_numpy(dtype=float) + 0.5
    return pd.DataFrame({"low": quantile(0.025, a, b), "high": quantile(0.975, a, b)})
