"""Welch and paired tests, multiplicity correction, rank tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unimass.functions import special as sp
from unimass.operators.moments import EPS, UNIT
from unimass.operators.ordering import SLICE, average_rank, exact_percentile, global_order
from unimass.session import join_on, materialize


def welch_tests(profiles: DataFrame, pairs: list[tuple[str, str]], keys=UNIT) -> DataFrame:
    """t, Welch df and one-sided p of every (a > b) pair, one row per unit and pair.

    A test is valid only if both variances exceed 1e-10; otherwise t = 0 and p = 1.
    """
    find = lambda name: F.filter("cells", lambda c: c["category"] == F.col(name))[0]
    listed = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    df = (
        profiles.select(*keys, "cells", listed.alias("_p"))
        .select(*keys, "cells", "_p.a", "_p.b")
        .select(*keys, "a", "b", find("a").alias("x"), find("b").alias("y")))
    valid = (F.col("x.var") > EPS) & (F.col("y.var") > EPS)
    e1, e2 = F.col("x.var") / F.col("x.n"), F.col("y.var") / F.col("y.n")
    t = (F.col("x.mean") - F.col("y.mean")) / F.sqrt(e1 + e2)
    dof = (e1 + e2) ** 2 / (
        e1 * e1 / (F.col("x.n") - 1) + e2 * e2 / (F.col("y.n") - 1))
    df = df.select(*keys, "a", "b", F.when(valid, t).alias("_t"), F.when(valid, dof).alias("df"))
    return df.select(
        *keys, "a", "b", F.coalesce("_t", F.lit(0.0)).alias("t"), "df",
        F.coalesce(sp.t_sf(F.col("_t"), F.col("df")), F.lit(1.0)).alias("p"))


def welch_onesided(profiles: DataFrame, pairs, method: str = "by", alpha: float = 0.001,
                   keys=UNIT) -> DataFrame:
    """Welch tests, corrected over all units of a layer (invalid ones included).

    mask = adjusted p <= alpha and t > 0.
    """
    family = [k for k in keys if k != "unit_id"] + ["a", "b"]
    tests = fdr_adjust(welch_tests(profiles, pairs, keys), family, "p", method, tie="unit_id")
    return tests.withColumn("mask", (F.col("p_adj") <= alpha) & (F.col("t") > 0))


def _harmonic(m):
    """1 + 1/2 + ... + 1/m: the asymptotic series ten terms further on, less those ten terms."""
    x = m.cast("double") + 10
    series = (F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)
              - 1 / (252 * x**6) + 1 / (240 * x**8) - 1 / (132 * x**10))
    return series - sum((1 / (m + i) for i in range(1, 11)), F.lit(0.0))


def _factor(method: str, m):
    if method not in ("bh", "by"):
        raise ValueError(f"method must be 'bh' or 'by', got {method!r}")
    return m if method == "bh" else m * _harmonic(m)


def _valid(p):
    return F.when(~F.isnan(p), F.col(p))


def fdr_adjust(df: DataFrame, family, p: str = "p", method: str = "bh", out: str = "p_adj",
               tie: str | None = None) -> DataFrame:
    """Step-up adjusted p over families of any size; a missing p leaves its family.

    The rows are range-partitioned by (family, p): ranks and the running minimum from the
    largest p downwards are taken inside slices and joined across them.
    """
    family = list(family)
    df = df.withColumn("_p", _valid(p))
    order = [F.col("_p").asc_nulls_last()] + ([F.col(tie)] if tie else [])
    placed = global_order(df, family, order, "fdr")
    valid = placed.groupBy(*family).agg(F.count("_p").alias("_m"))
    ranked = join_on(placed, valid, family).withColumn(
        "_raw", F.col("_p") * _factor(method, F.col("_m")) / F.col("pos"))
    # running minima are taken from the top down: a frame that ends at the last row of the
    # partition costs Spark a pass per row
    after = Window.partitionBy(*family, SLICE).orderBy(F.desc("pos")).rowsBetween(
        Window.unboundedPreceding, 0)
    later = Window.partitionBy(*(family or [F.lit(0)])).orderBy(F.desc(SLICE)).rowsBetween(
        Window.unboundedPreceding, -1)
    minima = ranked.groupBy(*family, SLICE).agg(F.min("_raw").alias("_low")).select(
        *family, SLICE, F.min("_low").over(later).alias("_later"))
    return (
        join_on(ranked.withColumn("_here", F.min("_raw").over(after)), minima, [*family, SLICE])
        .withColumn(out, F.when(F.col("_p").isNotNull(),
                                F.least(F.lit(1.0), F.col("_here"), F.col("_later"))))
        .drop("_p", "_m", "_raw", "_here", "_later", "pos", "group_n", SLICE))


def fdr_adjust_few(df: DataFrame, family=(), p: str = "p", method: str = "bh",
                   out: str = "p_adj") -> DataFrame:
    """The same for families that are short by construction, such as a list of contrasts."""
    group = Window.partitionBy(*(list(family) or [F.lit(0)]))
    df = df.withColumn("_p", _valid(p))
    place = F.row_number().over(group.orderBy(F.col("_p").asc_nulls_last()))
    down = group.orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("_p") * _factor(method, F.count("_p").over(group)) / F.col("_place")
    return df.withColumn("_place", place).withColumn("_raw", raw).withColumn(
        out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))
    ).drop("_p", "_raw", "_place")


def one_sample_t(diffs: DataFrame, keys, value: str = "diff", level: float = 0.95) -> DataFrame:
    """t, df, two-sided p, Cohen's d and confidence limits of a mean difference.

    Missing differences are dropped; everything is missing below two, d where the sd is 0.
    """
    x = F.when(~F.isnan(value), F.col(value))
    s = diffs.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    enough = F.col("n") >= 2
    # a constant non-zero difference has an infinite t and p = 0
    t = F.when(F.col("sd") > 0, F.col("mean") / se).when(
        F.col("mean") > 0, F.lit(float("inf"))).when(F.col("mean") < 0, F.lit(float("-inf")))
    s = s.withColumn("t", F.when(enough, t)).withColumn(
        "df", F.when(enough, (F.col("n") - 1).cast("double")))
    crit = sp.t_ppf(F.lit(0.5 + level / 2), F.col("df"))
    s = s.withColumn("_crit", crit).withColumn("_tail", sp.t_sf(
        F.when(F.abs("t") < float("inf"), F.abs("t")), F.col("df")))
    return s.select(
        *keys, "n", "mean", "t", "df",
        F.when(F.abs("t") == float("inf"), 0.0).otherwise(2 * F.col("_tail")).alias("p"),
        F.when(enough & (F.col("sd") > 0), F.col("mean") / F.col("sd")).alias("d"),
        F.when(enough, F.col("mean") - F.col("_crit") * se).alias("ci_low"),
        F.when(enough, F.col("mean") + F.col("_crit") * se).alias("ci_high"))


def spearman_curve(curves: DataFrame, keys, x="x", y="y", min_points: int = 3,
                   with_p: bool = False) -> DataFrame:
    """Rank correlation of y with x inside each curve, whose points are few (bins or layers)."""
    ok = curves.filter(F.col(y).isNotNull() & ~F.isnan(y) & F.col(x).isNotNull())
    mean_rank = lambda c: (
        F.rank().over(Window.partitionBy(*keys).orderBy(c))
        + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2)
    ranked = ok.select(*keys, mean_rank(x).alias("rx"), mean_rank(y).alias("ry"))
    vary = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    out = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.when(vary & (F.count("*") >= min_points), F.try_divide(
            F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))).alias("rho"))
    # a curve that has no finite point keeps its row
    out = curves.select(*keys).distinct().join(out, list(keys), "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    # rounding may push a perfect correlation past 1
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round("rho", 14)))
    out = out.withColumn("rho", F.when(F.col("rho").isNotNull(), rho))
    if not with_p:
        return out
    dof = (F.col("n") - 2).cast("double")
    t = F.when((F.abs("rho") < 1) & (dof > 0),
               F.abs("rho") * F.sqrt(dof / (1 - F.col("rho") ** 2)))
    return out.withColumn("_t", t).withColumn(
        "p", F.when((F.abs("rho") == 1) & (dof > 0), 0.0).otherwise(
            2 * sp.t_sf(F.col("_t"), F.when(dof > 0, dof)))).drop("_t")


def wilcoxon_signed_rank(df: DataFrame, keys, value: str) -> DataFrame:
    """Signed-rank W = min(W+, W-) and two-sided p per group; zeros are dropped.

    Exact up to 50 values without ties or zeros, otherwise the tie-corrected normal limit.
    """
    keys = list(keys)
    base = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *keys, F.abs(value).alias("_a"), F.signum(value).alias("_s"))
    zeros = base.groupBy(*keys).agg(F.sum((F.col("_s") == 0).cast("int")).alias("n_zero"))
    ranked = average_rank(base.filter("_s <> 0"), keys, "_a")
    per_value = ranked.groupBy(*keys, "_a", "avg_rank").agg(
        F.count("*").alias("t"),
        F.sum(F.when(F.col("_s") > 0, F.col("avg_rank")).otherwise(0.0)).alias("plus"))
    sums = per_value.groupBy(*keys).agg(
        F.sum("t").alias("n"), F.sum("plus").alias("plus"),
        F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    total = n * (n + 1) / 2
    w = F.least("plus", total - F.col("plus"))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    out = sums.join(zeros, keys).withColumn("w", w).withColumn(
        "_z", F.when(var > 0, (total / 2 - w) / F.sqrt(var)))
    exact = (F.col("n") <= 50) & (F.col("ties") == 0) & (F.col("n_zero") == 0)
    return out.withColumn(
        "p", F.when(exact, sp.wilcoxon_exact(F.when(exact, F.col("w")), F.col("n"))).otherwise(
            F.least(F.lit(1.0), 2 * sp.normal_sf(F.col("_z"))))
    ).select(*keys, "w", "p")


def gradient_stats(curves: DataFrame, entity="entity", key="key", x="x", y="y",
                   correct: bool = True) -> DataFrame:
    """Change of binned curves along their axis, tested across entities, one row per key.

    Spearman r per entity, then its median and range, the signed-rank test (needs more than
    one entity and a non-zero r), the sign test, and BH over the keys with a finite p.
    """
    per = materialize(
        spearman_curve(curves, [entity, key], x, y).select(entity, key, "rho"), "rho")
    return rho_stats(per, key, correct)


def rho_stats(per: DataFrame, key="key", correct: bool = True) -> DataFrame:
    """The across-entity part of `gradient_stats`, from one rho per entity and key."""
    finite = per.filter(F.col("rho").isNotNull())
    base = per.groupBy(key).agg(
        F.count("rho").cast("long").alias("n"),
        F.count_if(F.col("rho") > 0).alias("n_pos"),
        F.min("rho").alias("r_min"), F.max("rho").alias("r_max"))
    mid = exact_percentile(finite, [key], "rho", {"median_r": 0.5})
    test = wilcoxon_signed_rank(finite, [key], "rho")
    out = base.join(mid, key, "left").join(test, key, "left")
    ok = F.col("n") > 1
    out = out.select(
        key, "n", "n_pos", "median_r", "r_min", "r_max",
        F.when(ok, F.col("w")).alias("w"), F.when(ok, F.col("p")).alias("p_raw"),
        sp.binom_two_sided(F.when(F.col("n") > 0, F.col("n_pos")), F.col("n")).alias("p_sign"))
    if not correct:
        return out.withColumn("p", F.col("p_raw"))
    return fdr_adjust_few(out, (), "p_raw", "bh", "p")


def type_pairs(types: list[str]):
    """All unordered pairs in the order of the list."""
    return [(a, b) for i, a in enumerate(types) for b in types[i + 1:]]


def permutation_p(nulls: DataFrame, keys=("subject", "voxel_id"), real="r2", null="null_r2"):
    """(1 + number of null values >= the real one) / (1 + number of permutations).

    A null value that misses the real one by rounding alone (a relative 1e-12) reaches it.
    """
    reached = F.col(null) >= F.col(real) - 1e-12 * F.abs(real)
    return nulls.groupBy(*keys).agg(((1 + F.count_if(reached)) / (1 + F.count("*"))).alias("p_perm"))


def fwe_threshold(null_max: DataFrame, keys=("subject",), value="null_max",
                  alpha: float = 0.05) -> DataFrame:
    """(1 - alpha) linear percentile of the maximum statistic over the permutations."""
    return null_max.groupBy(*keys).agg(
        F.percentile(value, F.lit(1.0 - alpha)).alias("threshold"))


def sig_mask(r2: DataFrame, thresholds: DataFrame, keys=("subject",), value="r2") -> DataFrame:
    """Voxels strictly above their subject's threshold."""
    return r2.join(thresholds, list(keys)).filter(F.col(value) > F.col("threshold")).drop("threshold")
