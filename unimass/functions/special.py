"""Tail probabilities as Arrow UDFs: Spark has neither erf nor an incomplete beta."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients of the Stirling series for log-gamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(10):
        low = z < 10
        shift = shift - np.where(low, np.log(np.where(low, z, 1.0)), 0.0)
        z = np.where(low, z + 1, z)
    series = sum(c / z ** (2 * i + 1) for i, c in enumerate(STIRLING))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series + shift


def _beta_fraction(a, b, x, rounds=400, tiny=1e-300):
    """Continued fraction of the incomplete beta, modified Lentz steps on whole arrays."""
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, rounds + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / guard(1 + even * d)
        c = guard(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / guard(1 + odd * d)
        c = guard(1 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def beta_inc(a, b, x, y=None):
    """Regularised incomplete beta I_x(a, b); y = 1 - x may be given where x is near 1."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    y = 1 - x if y is None else np.broadcast_to(np.asarray(y, float), x.shape)
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    u, v = np.where(flip, y, x), np.where(flip, x, y)
    with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
        front = np.exp(
            p * np.log(u) + q * np.log(v) - np.log(p)
            + log_gamma(p + q) - log_gamma(p) - log_gamma(q)
        )
        part = np.where(u <= 0, 0.0, front * _beta_fraction(p, q, np.clip(u, 0, 1)))
    return np.where(flip, 1 - part, part)


def t_tail(t, df):
    """P(T > t) for Student's t, accurate far into the upper tail."""
    t, df = (np.asarray(v, float) for v in np.broadcast_arrays(t, df))
    sq = t * t
    upper = 0.5 * beta_inc(df / 2, np.full_like(df, 0.5), df / (df + sq), sq / (df + sq))
    return np.where(t >= 0, upper, 1 - upper)


def t_quantile(q, df):
    """Quantile of Student's t for q in (0, 1) by bisection."""
    q, df = (np.asarray(v, float) for v in np.broadcast_arrays(q, df))
    lo, hi = np.full(q.shape, -1e6), np.full(q.shape, 1e6)
    for _ in range(120):
        mid = (lo + hi) / 2
        below = 1 - t_tail(mid, df) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def signed_rank_p(w: float, n: int) -> float:
    """Exact two-sided p of the signed-rank statistic w = min(W+, W-), no ties."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for rank in range(1, n + 1):
        moved = np.zeros_like(counts)
        moved[rank:] = counts[:-rank]
        counts = (counts + moved) / 2
    return float(min(1.0, 2 * counts[: int(w) + 1].sum()))


def _column_udf(fn):
    """Arrow UDF of doubles; rows with a missing argument stay missing."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.to_numpy(float, na_value=np.nan), y.to_numpy(float, na_value=np.nan)
        ok = ~(np.isnan(x) | np.isnan(y))
        out = np.full(len(x), np.nan)
        if ok.any():
            out[ok] = fn(x[ok], y[ok])
        return pd.Series(out).where(ok, None)

    return run


def _lit(v):
    return F.lit(float(v)) if isinstance(v, (int, float)) else v


def t_sf(t, df):
    """Column: one-sided upper p of Student's t."""
    return _column_udf(t_tail)(_lit(t), _lit(df))


def t_ppf(q, df):
    """Column: Student t quantile."""
    return _column_udf(t_quantile)(_lit(q), _lit(df))


def normal_sf(z):
    """Column: one-sided upper p of the standard normal."""
    erfc = lambda a, _: np.fromiter((0.5 * math.erfc(v / math.sqrt(2)) for v in a), float, len(a))
    return _column_udf(erfc)(z, F.lit(0.0))


def normal_isf(p):
    """Column: z with P(Z > z) = p."""
    inv = NormalDist().inv_cdf
    cut = lambda a, _: np.fromiter(
        (-inv(min(max(v, 1e-300), 1 - 1e-16)) for v in a), float, len(a))
    return _column_udf(cut)(p, F.lit(0.0))


def binom_two_sided(k, n):
    """Column: two-sided sign-test p of k successes in n fair trials."""

    def tail(k, n):
        top = np.maximum(k, n - k)
        return np.minimum(1.0, 2 * beta_inc(top, n - top + 1, np.full_like(top, 0.5)))

    return _column_udf(tail)(k.cast("double"), n.cast("double"))


def wilcoxon_exact(w, n):
    """Column: exact two-sided signed-rank p for small n."""
    each = lambda w, n: np.array([signed_rank_p(a, int(b)) for a, b in zip(w, n)])
    return _column_udf(each)(w, n.cast("double"))
