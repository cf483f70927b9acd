"""Two-sided Student-t tail as an Arrow-batched function (one row per series)."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# ship the function's code with the job: executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, modified Lentz."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(np.abs(d * c - 1) < 1e-12, h, np.nan)  # what has not settled is NULL, not a guess


def regularised_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b), using the symmetry that keeps the fraction convergent."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(
            log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)
        )
    value = np.where(z > 0, front * _beta_fraction(p, q, z) / p, 0.0)
    return np.where(flip, 1 - value, value)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) for df degrees of freedom; NULL in, NULL out."""
    tv, dv = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
    ok = np.isfinite(tv) & np.isfinite(dv) & (dv > 0)
    out = np.full(tv.shape, np.nan)
    if ok.any():
        d = dv[ok]
        out[ok] = regularised_beta(d / 2, np.full(d.shape, 0.5), d / (d + tv[ok] ** 2))
    return pd.Series(out)  # NaN crosses Arrow as NULL
