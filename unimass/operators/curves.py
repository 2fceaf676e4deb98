"""Curves over layers or gradient bins: interpolation, means and errors, diet contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unimass.functions import special as sp


def interp_curve(layers: DataFrame, keys, n_grid: int = 10, position="layer_ord",
                 value="y") -> DataFrame:
    """Piecewise-linear curve on a 0..1 grid from equally spaced layers.

    Layers sit at linspace(0, 1, L); missing values are left out, the ends are held, and fewer
    than two points give a missing curve. A curve has as many points as a model has layers.
    """
    point = F.struct(F.col(position).alias("o"), F.col(value).cast("double").alias("v"))
    curve = layers.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("all"))
    place = F.transform("all", lambda e, i: F.struct(
        F.when(F.size("all") > 1, i / (F.size("all") - 1)).otherwise(0.0).alias("x"),
        e["v"].alias("v")))
    curve = curve.withColumn("pts", F.filter(
        place, lambda e: e["v"].isNotNull() & ~F.isnan(e["v"])))
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_grid - 1)), lambda i: F.struct(
        i.alias("bin"), (i / F.lit(max(n_grid - 1, 1))).alias("x"))))
    grid = curve.select(*keys, "pts", steps.alias("g")).select(*keys, "pts", "g.bin", "g.x")
    lo = F.element_at(F.filter("pts", lambda e: e["x"] <= F.col("x")), -1)
    hi = F.filter("pts", lambda e: e["x"] >= F.col("x"))
    grid = grid.withColumn("lo", F.when(F.size(F.filter(
        "pts", lambda e: e["x"] <= F.col("x"))) > 0, lo)).withColumn(
        "hi", F.when(F.size(hi) > 0, hi[0]))
    inside = F.when(
        F.col("lo.x") < F.col("hi.x"),
        F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (F.col("x") - F.col("lo.x"))
        / (F.col("hi.x") - F.col("lo.x"))).otherwise(F.coalesce("lo.v", "hi.v"))
    return grid.select(*keys, "bin", "x", F.when(F.size("pts") >= 2, inside).alias("y"))


def mean_sem(df: DataFrame, keys, value="y", min_n: int = 2, error: str = "sem") -> DataFrame:
    """Mean and SEM (or SD) over the finite rows; missing below min_n of them."""
    x = F.when(~F.isnan(value), F.col(value))
    n = F.count(x)
    err = F.stddev_samp(x) / F.sqrt(n) if error == "sem" else F.stddev_samp(x)
    return df.groupBy(*keys).agg(
        n.alias("n"), F.when(n >= min_n, F.avg(x)).alias("mean"),
        F.when(n >= min_n, err).alias("err"))


def mean_sem_rows(df: DataFrame, keys, value="y", single_zero: bool = False) -> DataFrame:
    """The same, but the error divides by all rows; a single row may count as error 0."""
    x = F.when(~F.isnan(value), F.col(value))
    n = F.count("*")
    err = F.stddev_samp(x) / F.sqrt(n)
    if single_zero:
        err = F.when(n == 1, F.lit(0.0)).otherwise(err)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(x).alias("mean"), err.alias("err"))


def within_subject_ci(scores: DataFrame, keys=(), subject="subject", condition="condition",
                      value="score", level: float = 0.95) -> DataFrame:
    """Condition means and Cousineau-Morey half widths, from subjects with every condition.

    keys + (condition) give one row; n_conditions is counted per keys group.
    """
    keys = list(keys)
    if not keys:
        whole = within_subject_ci(scores.withColumn("_all", F.lit(0)), ["_all"], subject,
                                  condition, value, level)
        return whole.drop("_all")
    x = F.when(~F.isnan(value), F.col(value))
    df = scores.select(*keys, subject, condition, x.alias("_x"))
    wanted = df.groupBy(*keys).agg(F.countDistinct(condition).alias("_c"))
    people = df.groupBy(*keys, subject).agg(
        F.count("_x").alias("_have"), F.avg("_x").alias("_own"))
    full = people.join(wanted, keys).filter(F.col("_have") == F.col("_c"))
    grand = full.groupBy(*keys).agg(
        F.avg("_own").alias("_grand"), F.count("*").alias("_s"), F.first("_c").alias("_nc"))
    full = full.select(*keys, subject, "_own")
    rows = df.join(full, [*keys, subject])
    rows = rows.join(grand, keys)
    norm = F.col("_x") - F.col("_own") + F.col("_grand")
    out = rows.groupBy(*keys, condition).agg(
        F.avg("_x").alias("mean"), F.stddev_samp(norm).alias("_sd"), F.first("_s").alias("n"),
        F.first("_nc").alias("_nc"))
    c, s = F.col("_nc"), F.col("n")
    morey = F.when(c > 1, F.sqrt(c / (c - 1))).otherwise(1.0)
    crit = sp.t_ppf(F.lit(0.5 + level / 2), F.greatest(s - 1, F.lit(1)).cast("double"))
    return out.withColumn("_crit", crit).select(
        *keys, condition, "n", "mean",
        (F.col("_crit") * F.col("_sd") / F.sqrt(s) * morey).alias("ci_half"))


def gradient_bin(d, n_grid: int = 10):
    """Column: bin of a normalised position; missing stays missing."""
    ok = F.when(~F.isnan(d), d)
    return F.least(F.greatest((ok * n_grid).cast("int"), F.lit(0)), F.lit(n_grid - 1)) * \
        F.when(ok.isNotNull(), 1)


def bin_centre(b, n_grid: int = 10):
    return (b + 0.5) / n_grid * 100


def gradient_bins(gradient: DataFrame, n_grid: int = 10, d="d_norm") -> DataFrame:
    """Add bin (0-based) and bin centre in percent."""
    return gradient.withColumn("bin", gradient_bin(F.col(d), n_grid)).withColumn(
        "x", bin_centre(F.col("bin"), n_grid))


def _grid(subjects: DataFrame, names: list, n_grid: int, name="key") -> DataFrame:
    cell = F.explode(F.flatten(F.transform(
        F.array(*[F.lit(k) for k in names]),
        lambda k: F.transform(F.sequence(F.lit(0), F.lit(n_grid - 1)),
                              lambda b: F.struct(k.alias(name), b.alias("bin"))))))
    return subjects.select("subject", cell.alias("g")).select("subject", f"g.{name}", "g.bin")


SEARCHED = ("face", "body", "mixed", "non", "other")


def bin_percent(labels: DataFrame, gradient: DataFrame, types=("face", "body", "mixed"),
                n_grid: int = 10, responsive: bool = True) -> DataFrame:
    """Per subject, type and bin: 100 * selected / searched voxels; missing where none.

    Searched = has one of the five labels (and is responsive); `labels` is long.
    """
    names = [*SEARCHED, "responsive"]
    wide = labels.filter(F.col("label").isin(*names)).groupBy("subject", "voxel_id").agg(
        *[F.max((F.col("label") == c).cast("int")).alias(c) for c in names])
    searched = sum((F.col(c) for c in SEARCHED[1:]), F.col(SEARCHED[0])) > 0
    if responsive:
        searched = searched & (F.col("responsive") == 1)
    binned = gradient_bins(gradient, n_grid).filter(F.col("bin").isNotNull()).join(
        wide.filter(searched), ["subject", "voxel_id"])
    counts = binned.groupBy("subject", "bin").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in types])
    long = counts.unpivot(["subject", "bin", "_n"], list(types), "key", "_k")
    grid = _grid(gradient.select("subject").distinct(), list(types), n_grid)
    return grid.join(long, ["subject", "key", "bin"], "left").select(
        F.col("subject").alias("entity"), "key", "bin", bin_centre(F.col("bin"), n_grid).alias("x"),
        F.try_divide(100.0 * F.col("_k"), F.col("_n")).alias("y"))


def bin_mean(values: DataFrame, gradient: DataFrame, nc: DataFrame | None, keys: list,
             n_grid: int = 10, clip: bool = False) -> DataFrame:
    """Per subject, measure and bin: sum(value) / count, or sum(value) / sum(nc) if nc is given.

    `values` is (subject, voxel_id, measure, value); its voxels are the fitted ones.
    """
    v = F.greatest(F.col("value"), F.lit(0.0)) if clip else F.col("value")
    rows = values.filter(F.col("measure").isin(*keys)).join(
        gradient_bins(gradient, n_grid).filter(F.col("bin").isNotNull())
        .select("subject", "voxel_id", "bin"), ["subject", "voxel_id"])
    if nc is None:
        rows = rows.withColumn("_w", F.lit(1.0))
    else:
        rows = rows.join(nc.select("subject", "voxel_id", F.col("nc").alias("_w")),
                         ["subject", "voxel_id"])
    sums = rows.groupBy("subject", "measure", "bin").agg(
        F.sum(v).alias("_v"), F.sum("_w").alias("_w"))
    grid = _grid(rows.select("subject").distinct(), keys, n_grid, "measure")
    return grid.join(sums, ["subject", "measure", "bin"], "left").select(
        F.col("subject").alias("entity"), F.col("measure").alias("key"), "bin",
        bin_centre(F.col("bin"), n_grid).alias("x"),
        F.when(F.col("_w") > 0, F.col("_v") / F.col("_w")).alias("y"))


RATIOS = {"U_face": ("u_f", "r2_fb"), "U_body": ("u_b", "r2_fb"),
          "I_shared": ("s_fb", "r2_fb"), "I_mixed": ("delta_m", "r2_fbm")}


def integration_ratios(curves: DataFrame, keys=("entity", "bin", "x")) -> DataFrame:
    """100 * part / whole of the variance portions; missing where the whole is not positive."""
    parts = sorted({p for pair in RATIOS.values() for p in pair})
    wide = curves.groupBy(*keys).agg(
        *[F.max(F.when(F.col("key") == p, F.col("y"))).alias(p) for p in parts])
    ratios = wide.select(*keys, *[
        F.when(F.col(den) > 0, 100.0 * F.col(num) / F.col(den)).alias(name)
        for name, (num, den) in RATIOS.items()])
    return ratios.unpivot(list(keys), list(RATIOS), "key", "y")


def integration_report(ratios: DataFrame, n_grid: int = 10) -> DataFrame:
    """Mean and SEM of each ratio in the first and the last bin."""
    ends = ratios.filter(F.col("bin").isin(0, n_grid - 1))
    return mean_sem(ends, ["key", "bin"])


def diet_curves(curves: DataFrame, baseline: str, show: str = "both") -> DataFrame:
    """Raw curves and their difference to the baseline diet, matched by architecture.

    `curves` is (diet, arch, key, bin, y); the result adds mode = raw | diff.
    """
    if show not in ("raw", "diff", "both"):
        raise ValueError(f"show must be 'raw', 'diff' or 'both', got {show!r}")
    raw = curves.select(F.lit("raw").alias("mode"), "diet", "arch", "key", "bin", "y")
    if show == "raw":
        return raw
    base = curves.filter(F.col("diet") == baseline).select(
        "arch", "key", "bin", F.col("y").alias("_b"))
    diff = curves.filter(F.col("diet") != baseline).join(base, ["arch", "key", "bin"]).select(
        F.lit("diff").alias("mode"), "diet", "arch", "key", "bin",
        (F.col("y") - F.col("_b")).alias("y"))
    return diff if show == "diff" else raw.unionByName(diff)


def diet_summary(curves: DataFrame) -> DataFrame:
    """Mean over the curve and value at its deepest bin, per architecture."""
    x = F.when(~F.isnan("y"), F.col("y"))
    return curves.groupBy("mode", "diet", "arch", "key").agg(
        F.avg(x).alias("mean"), F.max_by("y", "bin").alias("deepest"))


def match_diets(models: DataFrame, baseline: str | None = None) -> DataFrame:
    """Positions and layers on which the diets disagree; empty when they match.

    `models` is (diet, position, model, layer, layer_ord).
    """
    n_diets = models.select("diet").distinct().count()
    if baseline is not None and not models.filter(F.col("diet") == baseline).head(1):
        raise ValueError(f"baseline {baseline!r} is not among the diets")
    if n_diets < 2:
        raise ValueError("need a diet besides the baseline")
    cells = models.groupBy("position", "layer_ord").agg(
        F.countDistinct("diet").alias("n_diets"), F.countDistinct("layer").alias("n_names"))
    return cells.filter((F.col("n_diets") < n_diets) | (F.col("n_names") > 1))


def layer_means(cohort: DataFrame, dims: DataFrame, types=("face", "body", "mixed")) -> DataFrame:
    """Mean d' of the selected units per layer, with a row for layers that have none."""
    means = cohort.groupBy("model", "layer", "sel_type").agg(F.avg("dval").alias("y"))
    full = dims.select("model", "layer", "layer_ord",
                       F.explode(F.array(*[F.lit(s) for s in types])).alias("sel_type"))
    return full.join(means, ["model", "layer", "sel_type"], "left")
