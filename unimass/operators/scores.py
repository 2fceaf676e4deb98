"""Encoding results: variance portions, ROI scores, paired comparisons, maps and scales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.functions.columns import normalize_r2
from unimass.operators import curves as cu
from unimass.operators.inference import fdr_adjust_few, one_sample_t, type_pairs
from unimass.operators.ordering import exact_percentile

FIT = ("model", "layer", "subject", "voxel_id")
UNIT_KEYS = ("f", "b", "m", "ns")
ANALYSES = {"sep": UNIT_KEYS, "fb_varpart": ("r2_f", "r2_b", "r2_fb", "u_f", "u_b", "s_fb"),
            "delta_m": ("r2_fb", "r2_fbm", "delta_m")}
BLOCKS = ("f", "b", "m", "ns", "r2_fb", "r2_fbm", "u_f", "u_b", "s_fb", "delta_m")


def _wide(encoding: DataFrame, measures, keys=FIT) -> DataFrame:
    """One row per voxel; conditional aggregates because the measures are known."""
    return encoding.filter(F.col("measure").isin(*measures)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in measures])


def variance_partition(encoding: DataFrame, keys=FIT) -> DataFrame:
    """Unique, shared and added variance per voxel, long.

    r2_f and r2_b are the sub-models at the joint fit's penalty; r2_fbm is the fit with the
    mixed block, and r2_fb_in its face and body sub-model (r2_fb where it is absent).
    """
    wide = _wide(encoding, ("r2_f", "r2_b", "r2_fb", "r2_fbm", "r2_fb_in"), keys)
    inner = F.coalesce("r2_fb_in", "r2_fb")
    parts = {
        "u_f": F.col("r2_fb") - F.col("r2_b"),
        "u_b": F.col("r2_fb") - F.col("r2_f"),
        "s_fb": F.col("r2_f") + F.col("r2_b") - F.col("r2_fb"),
        "delta_m": F.col("r2_fbm") - inner,
    }
    return wide.select(*keys, *[v.alias(k) for k, v in parts.items()]).unpivot(
        list(keys), list(parts), "measure", "value")


def voxelwise_to_roi(encoding: DataFrame, regions: DataFrame, analysis: str = "sep",
                     significant: DataFrame | None = None) -> DataFrame:
    """Encoding values of the voxels of each ROI: (model, layer, subject, roi, voxel, measure).

    With `significant` voxels given, others are dropped, but only for subjects that have a
    permutation test.
    """
    rows = encoding.filter(F.col("measure").isin(*ANALYSES[analysis])).join(
        regions, ["subject", "voxel_id"])
    if significant is None:
        return rows
    kept = significant.select("subject", "voxel_id", F.lit(1).alias("_keep"))
    tested = significant.select("subject").distinct().withColumn("_tested", F.lit(1))
    return rows.join(kept, ["subject", "voxel_id"], "left").join(
        tested, "subject", "left"  # one row per subject
    ).filter(F.col("_tested").isNull() | F.col("_keep").isNotNull()).drop("_keep", "_tested")


def noise_ceiling_by_roi(nc: DataFrame, regions: DataFrame) -> DataFrame:
    """Noise-ceiling values per subject and ROI; significance never filters them."""
    return regions.join(nc.select("subject", "voxel_id", "nc"), ["subject", "voxel_id"])


def _finite(name):
    return F.when(~F.isnan(name), F.col(name))


def roi_scores(values: DataFrame, nc_rows: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """mean(value) / mean(nc) per model, layer, subject, ROI and measure.

    Two separate means: the ceiling is that of the whole ROI. An ROI without a positive
    ceiling is dropped, or has a missing score if it is to be kept.
    """
    means = values.groupBy("model", "layer", "subject", "roi", "measure").agg(
        F.avg(_finite("value")).alias("_m"), F.count("*").alias("n_voxels"))
    keys = ["model", "layer", "subject", "roi", "measure"]
    if nc_rows is None:
        return means.select(*keys, F.col("_m").alias("score"), "n_voxels")
    ceiling = nc_rows.groupBy("subject", "roi").agg(F.avg(_finite("nc")).alias("nc"))
    return means.join(ceiling.filter(F.col("nc") > 0), ["subject", "roi"], "left" if keep else "inner").select(
        *keys, (F.col("_m") / F.col("nc")).alias("score"), "n_voxels")


def _pair_rows(df: DataFrame, keys, measures, value) -> DataFrame:
    """a - b for every pair of measures, from one wide row per key."""
    wide = df.filter(F.col("measure").isin(*measures)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == m, F.col(value))).alias(f"m{i}")
          for i, m in enumerate(measures)])
    at = {m: F.col(f"m{i}") for i, m in enumerate(measures)}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (at[a] - at[b]).alias("diff"))
        for a, b in type_pairs(list(measures))]))
    return wide.select(*keys, pairs.alias("p")).select(*keys, "p.*").filter(
        F.col("diff").isNotNull() & ~F.isnan("diff"))


def random_effect_diff(scores: DataFrame, measures=UNIT_KEYS, pooled: bool = False) -> DataFrame:
    """One a - b per subject and ROI, or per subject averaged over the ROIs it has."""
    d = _pair_rows(scores, ["model", "layer", "subject", "roi"], measures, "score")
    if not pooled:
        return d
    return d.groupBy("model", "layer", "subject", "a", "b").agg(F.avg("diff").alias("diff"))


def fixed_effect_diff(values: DataFrame, nc_rows: DataFrame | None = None,
                      measures=UNIT_KEYS) -> DataFrame:
    """a - b of every voxel, scaled by its ROI's ceiling; subjects are pooled."""
    rows = values
    if nc_rows is not None:
        ceiling = nc_rows.groupBy("subject", "roi").agg(F.avg(_finite("nc")).alias("nc"))
        rows = values.join(ceiling.filter(F.col("nc") > 0), ["subject", "roi"]).withColumn(
            "value", F.col("value") / F.col("nc"))
    return _pair_rows(rows, ["model", "layer", "subject", "roi", "voxel_id"], measures, "value")


def pairwise_comparisons(scores: DataFrame, values: DataFrame, nc_rows: DataFrame | None = None,
                         effect: str = "random", measures=UNIT_KEYS) -> DataFrame:
    """t-tests of all pairs of unit types per ROI and for ALL of them, BH within each ROI."""
    if effect not in ("random", "fixed"):
        raise ValueError("effect must be 'random' or 'fixed'")
    if effect == "random":
        per_roi = random_effect_diff(scores, measures)
        every = random_effect_diff(scores, measures, pooled=True)
    else:
        per_roi = fixed_effect_diff(values, nc_rows, measures)
        every = per_roi
    keys = ["model", "layer", "roi", "a", "b"]
    pooled = every.select("model", "layer", F.lit("ALL").alias("roi"), "a", "b", "diff")
    rows = per_roi.select(*keys, "diff").unionByName(pooled)
    tests = one_sample_t(rows, keys)
    return fdr_adjust_few(tests, ["model", "layer", "roi"]).withColumn(
        "significant", F.col("p_adj") <= 0.05)


def dissociation_cells(scores: DataFrame, rois=("face", "body"), measures=("f", "b")) -> DataFrame:
    """One row per subject with every (ROI, measure) cell; incomplete subjects are dropped."""
    cells = [(r, m) for r in rois for m in measures]
    wide = scores.groupBy("model", "layer", "subject").agg(*[
        F.max(F.when((F.col("roi") == r) & (F.col("measure") == m), F.col("score")))
        .alias(f"{r}_{m}") for r, m in cells])
    return wide.dropna(subset=[f"{r}_{m}" for r, m in cells])


def double_dissociation(cells: DataFrame, rois=("face", "body"), measures=("f", "b"),
                        correct: bool = True) -> DataFrame:
    """Own-minus-other in both ROIs and their interaction, t-tested, BH over the three."""
    (ra, rb), (ma, mb) = rois, measures
    at = lambda r, m: F.col(f"{r}_{m}")
    diffs = {
        f"{ra}: {ma} - {mb}": at(ra, ma) - at(ra, mb),
        f"{rb}: {mb} - {ma}": at(rb, mb) - at(rb, ma),
        "interaction": (at(ra, ma) - at(ra, mb)) - (at(rb, ma) - at(rb, mb)),
    }
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("contrast"), v.alias("diff")) for k, v in diffs.items()]))
    long = cells.select("model", "layer", rows.alias("r")).select("model", "layer", "r.*")
    tests = one_sample_t(long, ["model", "layer", "contrast"])
    if not correct:
        return tests.withColumn("p_adj", F.col("p"))
    return fdr_adjust_few(tests, ["model", "layer"])


def responsive_percent(labels: DataFrame, types=("face", "body", "mixed")) -> DataFrame:
    """Per subject: 100 * (type and responsive) / responsive."""
    wide = labels.groupBy("subject", "voxel_id").agg(
        *[F.bool_or(F.col("label") == c).alias(c) for c in (*types, "responsive")])
    counts = wide.filter("responsive").groupBy("subject").agg(
        *[(100.0 * F.count_if(c) / F.count("*")).alias(c) for c in types])
    return counts.unpivot(["subject"], list(types), "label", "percent")


def percent_summary(percents: DataFrame) -> DataFrame:
    """Mean, sd and range over subjects."""
    return percents.groupBy("label").agg(
        F.avg("percent").alias("mean"), F.stddev_samp("percent").alias("sd"),
        F.min("percent").alias("min"), F.max("percent").alias("max"), F.count("*").alias("n"))


def block_map(encoding: DataFrame, voxels: DataFrame, blocks=UNIT_KEYS, normalize: bool = True,
              nc_min: float = 0.0, significant: DataFrame | None = None) -> DataFrame:
    """Value of each block per brain voxel, missing outside the fit or below significance.

    `voxels` is (subject, voxel_id, nc). Every fitted model, layer and subject gets a row for each
    voxel of the subject's brain. `significant` must hold tested subjects only: see require_tested.
    """
    unknown = set(blocks) - set(BLOCKS)
    if unknown:
        raise ValueError(f"unknown blocks {sorted(unknown)}; choose from {BLOCKS}")
    rows = encoding.filter(F.col("measure").isin(*blocks))
    if significant is not None:
        rows = rows.join(significant.select("subject", "voxel_id"), ["subject", "voxel_id"],
                         "left_semi")
    fitted = encoding.select("model", "layer", "subject").distinct()
    brain = fitted.join(voxels.select("subject", "voxel_id", "nc"), "subject").select(
        "*", F.explode(F.array(*[F.lit(b) for b in blocks])).alias("block"))
    rows = rows.select("model", "layer", "subject", "voxel_id",
                       F.col("measure").alias("block"), "value")
    out = brain.join(rows, ["model", "layer", "subject", "voxel_id", "block"], "left")
    value = normalize_r2(F.col("value"), F.col("nc"), nc_min) if normalize else F.col("value")
    return out.select("model", "layer", "subject", "voxel_id", "block", value.alias("value"))


def require_tested(encoding: DataFrame, thresholds: DataFrame) -> None:
    """Raise if a subject of the encoding has no stored permutation threshold."""
    subjects = encoding.select("subject").distinct().join(
        thresholds.select("subject").distinct(), "subject", "left_anti")
    untested = sorted(r["subject"] for r in subjects.limit(20).collect())
    if untested:
        raise ValueError(f"no permutation test was stored for {untested}")


def percentile_scale(values: DataFrame, keys=(), value="value", pct: float = 99,
                     vmin: float | None = None, vmax: float | None = None,
                     symmetric: bool = False) -> DataFrame:
    """Value range: lo (0 by default) to the pct-th percentile, at least 1e-6 wide.

    symmetric: -hi to hi of the absolute values.
    """
    keys = list(keys)
    if symmetric:
        values = values.withColumn(value, F.abs(value))
    groups = values.groupBy(*keys).agg(F.count("*").alias("_n"))
    if vmax is not None:
        hi, out = F.lit(float(vmax)), groups
    else:
        top = exact_percentile(values, keys, value, {"_hi": pct / 100})
        out = groups.join(top, keys, "left") if keys else top
        hi = F.coalesce("_hi", F.lit(1.0))
    if symmetric:
        hi = F.greatest(hi, F.lit(1e-6))
        return out.select(*keys, (-hi).alias("lo"), hi.alias("hi"))
    lo = F.lit(0.0 if vmin is None else float(vmin))
    return out.select(*keys, lo.alias("lo"), (
        hi if vmax is not None else F.greatest(hi, lo + 1e-6)).alias("hi"))


def map_scales(maps: DataFrame, per_panel: bool, pct: float = 95, panel="block") -> DataFrame:
    """Scale shared by all panels and subjects, or one per panel."""
    return percentile_scale(maps, [panel] if per_panel else [], pct=pct)


def rescale_maps(pixels: DataFrame, mode: str = "per_type", pct: float = 99) -> DataFrame:
    """Heat maps to 0..1: per type by its 99th percentile, or jointly by the image's range."""
    if mode not in ("per_type", "joint"):
        raise ValueError(f"mode must be 'per_type' or 'joint', got {mode!r}")
    if mode == "joint":
        ends = pixels.groupBy("image_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
        return pixels.join(ends, "image_id").withColumn(
            "value", (F.col("value") - F.col("_lo")) / width).drop("_lo", "_hi")
    keys = ["image_id", "sel_type"]
    # the percentile of (value - min) is the percentile of value, moved by the same min
    low = pixels.groupBy(*keys).agg(F.min("value").cast("double").alias("_lo"))
    high = exact_percentile(pixels, keys, "value", {"_hi": pct / 100})
    hi = F.col("_hi") - F.col("_lo")
    scaled = (F.col("value") - F.col("_lo")) / F.when(hi > 0, hi).otherwise(1.0)
    return pixels.join(low.join(high, keys), keys).withColumn(
        "value", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def map_differences(scaled: DataFrame, pairs) -> DataFrame:
    """a - b of two types' maps, pixel by pixel."""
    names = sorted({n for p in pairs for n in p})
    wide = scaled.groupBy("image_id", "y", "x").agg(
        *[F.max(F.when(F.col("sel_type") == n, F.col("value"))).alias(f"v{i}")
          for i, n in enumerate(names)])
    at = {n: F.col(f"v{i}") for i, n in enumerate(names)}
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (at[a] - at[b]).alias("diff"))
        for a, b in pairs]))
    return wide.select("image_id", "y", "x", rows.alias("r")).select("image_id", "y", "x", "r.*")


def encoding_report(scores: DataFrame, kind: str = "within", n_iter: int = 10000,
                    seed: int = 0) -> DataFrame:
    """Means behind the bar and line figures, with an error per model, layer, ROI, measure.

    kind = "within": Cousineau-Morey interval; "boot": bootstrap over subjects, one draw for
    all measures. Only subjects with every measure count.
    """
    keys = ["model", "layer", "roi"]
    size = scores.groupBy(*keys, "measure").agg(F.avg("n_voxels").alias("mean_voxels"))
    if kind == "within":
        out = cu.within_subject_ci(scores, keys, condition="measure")
    elif kind == "boot":
        from unimass.operators.resample import boot_mean_halfwidth

        out = boot_mean_halfwidth(scores, keys, n_iter=n_iter, seed=seed)
    else:
        raise ValueError("kind must be 'within' or 'boot'")
    return out.join(size, [*keys, "measure"])


def ventral_report(curves: DataFrame) -> DataFrame:
    """Mean and SEM per bin of binned curves; `gradient_stats` tests the same curves."""
    return cu.mean_sem(curves, ["key", "bin", "x"])
