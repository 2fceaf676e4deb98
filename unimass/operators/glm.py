"""Mass-univariate regression of run series on task events, one voxel block per task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.functions import special as sp
from unimass.session import spread
from unimass.sources.scans import DOMAINS

# Contrasts of the localizer as (domains above, domains below); a side shares its weight.
CONTRASTS = {
    "face>object": (("faces",), ("objects",)),
    "body>object": (("bodies",), ("objects",)),
    "place>object": (("places",), ("objects",)),
    "character>object": (("characters",), ("objects",)),
    "face>body": (("faces",), ("bodies",)),
    "visual>baseline": (("faces", "bodies", "objects", "places", "characters"), ()),
}


def contrast_weights(above, below, names) -> np.ndarray:
    """One weight for each name: the mean over the domains above less the mean over those below."""
    unknown = {*above, *below} - set(names)
    if unknown:
        raise ValueError(f"the design has no {sorted(unknown)}")
    side = lambda members: np.isin(list(names), members) / max(len(members), 1)
    return side(list(above)) - side(list(below))


def hrf(dt: float, length: float = 32.0) -> np.ndarray:
    """Double-gamma response with unit sum (Glover 1999): delays 6 and 12 s, dispersion 0.9,
    undershoot ratio 0.35."""
    t = np.arange(0, length, dt) - dt
    on = t > 0

    def gamma(delay, scale=0.9):
        shape, out = delay / scale, np.zeros_like(t)
        u = t[on] / scale
        out[on] = np.exp((shape - 1) * np.log(u) - u - math.lgamma(shape)) / scale
        return out

    h = gamma(6.0) - 0.35 * gamma(12.0)
    return h / h.sum()


def design_matrix(events: pd.DataFrame, n: int, tr: float, names, high_pass: float = 1 / 128,
                  oversampling: int = 16) -> np.ndarray:
    """Convolved boxcars of the named events, cosine drifts below high_pass, and a constant."""
    dt = tr / oversampling
    fine = np.zeros((len(names), n * oversampling + 1))
    for e in events.itertuples(index=False):
        if e.trial_type in names:
            a = int(round(e.onset / dt))
            b = max(a + 1, int(round((e.onset + e.duration) / dt)))
            fine[list(names).index(e.trial_type), max(a, 0):max(b, 0)] += 1
    h = hrf(dt)
    task = np.array([np.convolve(row, h)[: n * oversampling:oversampling] for row in fine]).T
    order = int(np.floor(2 * n * high_pass * tr))
    step = np.arange(n)
    drift = [math.sqrt(2 / n) * np.cos(np.pi * (step + 0.5) * k / n) for k in range(1, order + 1)]
    return np.column_stack([task, *drift, np.ones(n)])


def ols(x, y):
    """Coefficients, residual variance and (X'X)^-1 of y (n x v) on x, by QR."""
    q, r = np.linalg.qr(x)
    inv = np.linalg.pinv(r)
    beta = inv @ (q.T @ y)
    rest = y - x @ beta
    dof = max(len(x) - np.linalg.matrix_rank(x), 1)
    return beta, (rest ** 2).sum(0) / dof, inv @ inv.T, rest, dof


def _prewhiten(a, rho):
    out = a.copy()
    out[1:] -= rho * a[:-1]
    return out


def fit_run(x, y, weights: dict, ar1: bool = True, bins: int = 100):
    """Effect and its variance of each contrast, per voxel of one run.

    AR(1): residual autocorrelations are rounded to 1/bins and voxels of one value share a
    whitened refit.
    """
    v = y.shape[1]
    effect = {k: np.zeros(v) for k in weights}
    variance = {k: np.zeros(v) for k in weights}
    _, _, _, rest, dof = ols(x, y)
    norm = (rest ** 2).sum(0)
    rho = np.where(norm > 0, (rest[1:] * rest[:-1]).sum(0) / np.where(norm > 0, norm, 1), 0.0)
    rho = np.trunc(rho * bins) / bins if ar1 else np.zeros(v)
    for value in np.unique(rho):
        cols = rho == value
        beta, sigma, cov, _, dof = ols(_prewhiten(x, value), _prewhiten(y[:, cols], value))
        for name, w in weights.items():
            c = np.concatenate([w, np.zeros(x.shape[1] - len(w))])
            effect[name][cols] = c @ beta
            variance[name][cols] = sigma * (c @ cov @ c)
    return effect, variance, dof


def mass_glm(bold: DataFrame, events: DataFrame, tr: float, contrasts=CONTRASTS, names=DOMAINS,
             high_pass: float = 1 / 128, ar1: bool = True, block: int = 1024) -> DataFrame:
    """t and z of every contrast and voxel, fixed effects over runs.

    `bold` is (subject, run, voxel_id, t, value), `events` canonical events. A task fits one
    run of one block of voxels, whose events (a few hundred rows) come along by cogrouping.
    """
    series = bold.groupBy("subject", "run", "voxel_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("t", F.col("value").cast("double").alias("v")))),
        lambda e: e["v"]).alias("y"))  # as long as a run
    series = series.withColumn("voxel_block", F.floor(F.col("voxel_id") / block))
    blocks = series.select("subject", "run", (F.col("voxel_block") + 0).alias("voxel_block")).distinct()
    told = events.join(blocks, ["subject", "run"])
    weights = {k: contrast_weights(*sides, names) for k, sides in contrasts.items()}
    run_type = dict(bold.dtypes)["run"]

    def fit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame()
        left = left.sort_values("voxel_id")
        y = np.stack(left["y"]).T
        x = design_matrix(right, len(y), tr, list(names), high_pass)
        effect, variance, dof = fit_run(x, y, weights, ar1)
        return pd.concat([pd.DataFrame({
            "subject": left["subject"], "run": left["run"], "voxel_id": left["voxel_id"],
            "contrast": k, "effect": effect[k], "variance": variance[k], "dof": float(dof)})
            for k in weights])

    at = ["subject", "run", "voxel_block"]
    series, told = spread(at, series, told)
    runs = series.groupBy(*at).cogroup(told.groupBy(*at)).applyInPandas(
        fit, f"subject string, run {run_type}, voxel_id bigint, contrast string, effect double, "
             "variance double, dof double")
    return fixed_effects(runs)


def fixed_effects(runs: DataFrame) -> DataFrame:
    """Sum of effects over the root of the summed variances, as t and as z."""
    sums = runs.groupBy("subject", "voxel_id", "contrast").agg(
        F.sum("effect").alias("effect"), F.sum("variance").alias("variance"), F.sum("dof").alias("dof"))
    t = F.when(F.col("variance") > 0, F.col("effect") / F.sqrt("variance")).otherwise(0.0)
    sums = sums.withColumn("t", t)
    # the z of the same tail; the smaller tail keeps its digits
    tail = sp.t_sf(F.abs("t"), F.col("dof"))
    return sums.withColumn("_p", tail).withColumn("_z", sp.normal_isf(F.col("_p"))).select(
        "subject", "voxel_id", "contrast", "effect", "t", (F.signum("t") * F.col("_z")).alias("z"))
