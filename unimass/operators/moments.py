"""Grouped moments and everything that follows from them without a second scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = ("model", "layer", "unit_id")
EPS = 1e-10
ROUNDING = 1e-24  # variance of equal z-scores that were computed on different ways


def explode_units(blocks: DataFrame, block_size: int) -> DataFrame:
    """Block arrays -> one row per (image, unit); unit_id = block_id * block_size + position."""
    keep = [c for c in blocks.columns if c not in ("block_id", "acts")]
    return blocks.select(*keep, "block_id", F.posexplode("acts").alias("_pos", "act")).select(
        *keep, (F.col("block_id") * block_size + F.col("_pos")).alias("unit_id"), "act")


def unit_moments(acts: DataFrame, keys=UNIT, category="category", value="act") -> DataFrame:
    """n, mean and variance (ddof 1) per unit and category: the only shuffle of the big table."""
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    return acts.groupBy(*keys, category).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


def unit_profiles(moments: DataFrame, keys=UNIT, category="category") -> DataFrame:
    """One row per unit with its categories as an array; bounded by the number of categories.

    `centre` is the grand mean: sums of squares are taken about it, which keeps them exact
    when a mean is large next to its spread.
    """
    cell = F.struct(
        F.col(category).alias("category"), "n", "mean",
        F.coalesce(F.col("var") * (F.col("n") - 1), F.lit(0.0)).alias("m2"), "var")
    return moments.groupBy(*keys).agg(
        F.collect_list(cell).alias("cells"),
        F.sum("n").alias("n_all"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre"))


def _side(cells, pick):
    """Merged n, mean offset and sum of squares about the centre of the picked cells."""
    chosen = F.filter(cells, pick)
    zero = F.lit(0.0)
    n = F.aggregate(chosen, zero, lambda a, c: a + c["n"])
    shift = F.aggregate(chosen, zero, lambda a, c: a + c["n"] * (c["mean"] - F.col("centre")))
    about = F.aggregate(
        chosen, zero,
        lambda a, c: a + c["m2"] + c["n"] * (c["mean"] - F.col("centre")) ** 2)
    return n, shift, about


def dprime(profiles: DataFrame, targets: dict[str, list[str]], baseline: str | None = None,
           keys=UNIT, name: str = "sel_type") -> DataFrame:
    """d' of each target set against the rest, or against one baseline category.

    (m1 - m2) / sqrt(pooled variance + 1e-10), pooled by degrees of freedom (1 if none).
    """
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias(name), F.array(*[F.lit(c) for c in v]).alias("cats"))
        for k, v in targets.items()]))
    df = profiles.select("*", rows.alias("_t")).select("*", f"_t.{name}", "_t.cats")
    inside = lambda c: F.array_contains(F.col("cats"), c["category"])
    outside = (lambda c: ~inside(c)) if baseline is None else (
        lambda c: c["category"] == F.lit(baseline))
    n1, s1, q1 = _side(F.col("cells"), inside)
    n2, s2, q2 = _side(F.col("cells"), outside)
    df = df.select(*keys, name, n1.alias("n1"), s1.alias("s1"), q1.alias("q1"),
                   n2.alias("n2"), s2.alias("s2"), q2.alias("q2"))
    m1, m2 = F.try_divide("s1", "n1"), F.try_divide("s2", "n2")
    squares = F.col("q1") - F.col("n1") * m1 * m1 + F.col("q2") - F.col("n2") * m2 * m2
    dof = F.col("n1") + F.col("n2") - 2
    pooled = squares / F.when(dof > 0, dof).otherwise(1.0) + EPS
    return df.select(*keys, name, ((m1 - m2) / F.sqrt(F.greatest(pooled, F.lit(EPS)))).alias("dval"))


def dprime_table(profiles: DataFrame, face="face", body="body", baseline=None, keys=UNIT):
    """face_d, body_d and mixed_d per unit: one against all, or each against the baseline."""
    targets = {"face_d": [face], "body_d": [body], "mixed_d": [face, body]}
    long = dprime(profiles, targets, baseline, keys, "contrast")
    return long.groupBy(*keys).pivot("contrast", list(targets)).agg(F.first("dval"))


def unit_response_z(profiles: DataFrame, keys=UNIT) -> DataFrame:
    """(category mean - overall mean) / overall sd (ddof 1); missing where sd <= 1e-10."""
    n, _, about = _side(F.col("cells"), lambda c: F.lit(True))
    sd = F.sqrt(F.try_divide(about, n - 1))
    return (
        profiles.select(*keys, "centre", sd.alias("sd"), F.explode("cells").alias("c"))
        .select(*keys, F.col("c.category").alias("category"),
                F.when(F.col("sd") > EPS, (F.col("c.mean") - F.col("centre")) / F.col("sd"))
                .alias("z")))


def session_zscore(trials: DataFrame, keys=("subject", "session", "voxel_id"),
                   value="beta") -> DataFrame:
    """(x - mean) / sd (ddof 1) per voxel within a session; 0 where the sd is 0 or missing.

    Statistics come from a partial aggregate joined back, so that no session or voxel is
    ever gathered in one task.
    """
    x = F.when(~F.isnan(value), F.col(value))
    stats = trials.groupBy(*keys).agg(
        F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    z = F.when((F.col("_s") > 0) & ~F.isnan(value), (F.col(value) - F.col("_m")) / F.col("_s"))
    return trials.join(stats, list(keys)).withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_m", "_s")


def ncsnr(z_trials: DataFrame, keys=("subject", "voxel_id"), image="image_id", value="z",
          repeats: int = 3) -> DataFrame:
    """Noise-ceiling SNR from the images shown exactly `repeats` times; 0 if there is none.

    z-scores are of order one: a noise variance within their rounding is none.
    """
    per_image = z_trials.groupBy(*keys, image).agg(
        F.count("*").alias("n"), F.var_samp(value).alias("v"))
    noise = per_image.groupBy(*keys).agg(
        F.avg(F.when(F.col("n") == repeats, F.col("v"))).alias("var_noise"))
    snr = F.when(
        F.col("var_noise") > ROUNDING,
        F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("var_noise"))) / F.sqrt("var_noise"))
    return noise.select(*keys, F.coalesce(snr, F.lit(0.0)).alias("ncsnr"))


def average_repetitions(z_trials: DataFrame, keys=("subject", "image_id", "voxel_id"),
                        value="z") -> DataFrame:
    """Mean over the trials of an image."""
    return z_trials.groupBy(*keys).agg(F.avg(value).alias("resp"))


def trials_of_images(image_meta: DataFrame, trials: DataFrame) -> DataFrame:
    """Attach image_id to single trials through the exploded list of trial ids."""
    ids = image_meta.select("subject", "image_id", F.explode("trial_ids").alias("trial_id"))
    return trials.join(ids, ["subject", "trial_id"])


def cross_correlation(pairs: DataFrame, a="a", b="b", eps: float = 1e-5) -> DataFrame:
    """Entry (i, j) of the correlation of two paired embeddings, standardised per dimension.

    Each task adds up its own D x D products; only those sums are shuffled.
    """
    import numpy as np
    import pandas as pd

    def partial(batches):
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = np.stack(pdf[a]).astype(float), np.stack(pdf[b]).astype(float)
            x1 = np.hstack([np.ones((len(x), 1)), x])
            y1 = np.hstack([np.ones((len(y), 1)), y])
            grams = [x1.T @ y1, (x1 * x1).sum(0), (y1 * y1).sum(0)]
            total = grams if total is None else [u + v for u, v in zip(total, grams)]
        if total is not None:
            d = total[0].shape[0]
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"i": i - 1, "j": j - 1, "xy": total[0].ravel(),
                                "xx": total[1][i], "yy": total[2][j], "n": total[0][0, 0]})

    sums = pairs.select(a, b).mapInPandas(
        partial, "i int, j int, xy double, xx double, yy double, n double"
    ).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy", "n")])
    mean_a = sums.filter("i >= 0 and j = -1").select("i", F.col("xy").alias("sa"))
    mean_b = sums.filter("i = -1 and j >= 0").select("j", F.col("xy").alias("sb"))
    full = sums.filter("i >= 0 and j >= 0").join(mean_a, "i").join(mean_b, "j")
    ma, mb = F.col("sa") / F.col("n"), F.col("sb") / F.col("n")
    sd_a = F.sqrt(F.greatest(F.col("xx") / F.col("n") - ma * ma, F.lit(0.0)) + eps)
    sd_b = F.sqrt(F.greatest(F.col("yy") / F.col("n") - mb * mb, F.lit(0.0)) + eps)
    return full.select("i", "j", ((F.col("xy") / F.col("n") - ma * mb) / (sd_a * sd_b)).alias("c"))


def redundancy_score(corr: DataFrame, lambd: float = 0.0051) -> DataFrame:
    """Sum of (diagonal - 1)^2 plus lambda times the squared off-diagonal."""
    on = F.sum(F.when(F.col("i") == F.col("j"), (F.col("c") - 1) ** 2))
    off = F.sum(F.when(F.col("i") != F.col("j"), F.col("c") ** 2))
    return corr.agg(on.alias("on_diag"), off.alias("off_diag"), (on + lambd * off).alias("score"))
