"""Welch's t-test from moments, and the incomplete beta function behind its p-value."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b) for arrays, by the continued fraction in its even and odd terms (modified Lentz)."""
    a, x = np.asarray(a, float), np.asarray(x, float)
    b = np.full_like(a, b)
    turn = x >= (a + 1) / (a + b + 2)
    p, q, t = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inner = (x > 0) & (x < 1)
    safe = np.where(inner, t, 0.5)
    tiny = 1e-300

    def away(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < tiny, tiny, v)

    c, d = np.ones_like(p), 1 / away(1 - (p + q) * safe / (p + 1))
    h = d.copy()
    live = np.ones(h.shape, bool)
    for m in range(1, 201):
        even = m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1))
        step = np.ones_like(h)
        for term in (even, odd):
            d = 1 / away(1 + term * d)
            c = away(1 + term / c)
            step = d * c
            h = np.where(live, h * step, h)
        live &= np.abs(step - 1) >= 3e-14
        if not live.any():
            break
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(p * np.log(safe) + q * np.log1p(-safe) - (log_gamma(p) + log_gamma(q) - log_gamma(p + q)))
    out = front * h / p
    out = np.where(turn, 1 - out, out)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(|T| >= t) of Student's t; null where t or dof is."""
    ok = t.notna() & dof.notna()
    tt, d = t.where(ok, 0.0).to_numpy(float), dof.where(ok, 1.0).to_numpy(float)
    return pd.Series(incomplete_beta(d / 2, 0.5, d / (d + tt * tt)), index=t.index).where(ok)


def welch_moments(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column, Column]:
    """(t, dof, p where no distribution is needed) from sizes, means and sample variances (null counts as 0).

    Without spread in both samples the p-value is 1 for equal means, else 0, and t and dof are null; an
    empty sample leaves all null.
    """
    v1, v2 = F.coalesce(v1, F.lit(0.0)), F.coalesce(v2, F.lit(0.0))
    some = (n1 > 0) & (n2 > 0)
    se2 = F.try_divide(v1, n1) + F.try_divide(v2, n2)
    flat = some & (se2 == 0)
    den = F.when(n1 > 1, v1 * v1 / (n1 * n1 * (n1 - 1.0))).otherwise(F.lit(0.0)) + F.when(n2 > 1, v2 * v2 / (n2 * n2 * (n2 - 1.0))).otherwise(F.lit(0.0))
    spread = some & (se2 > 0) & (den > 0)
    t = F.when(spread, F.abs(m1 - m2) / F.sqrt(se2))
    dof = F.when(spread, se2 * se2 / den)
    return t, dof, F.when(flat, F.when(m1 == m2, F.lit(1.0)).otherwise(F.lit(0.0)))
