"""Bootstraps, exact in distribution, for groups of any size.

A resampled mean needs only how often each row is drawn, and those counts are multinomial.
So equal rows are counted once beforehand (0/1 flags shrink to a handful of patterns), a large
stratum is cut into chunks, the draws of an iteration are first split over the chunks and then
drawn inside each, and only sums travel on. Levels above the rows (splits; models and layers)
are drawn as multiplicities of their strata.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.operators.inference import fdr_adjust_few, type_pairs
from unimass.session import materialize, spread

CHUNK_ROWS = 20_000
BATCH = 250


def _rng(*parts) -> np.random.Generator:
    """Generator of a seed and a key, the same wherever the task runs."""
    return np.random.default_rng([zlib.crc32(repr(str(p)).encode()) for p in parts])


def _multiplicity(rows: pd.DataFrame, levels, size: int, rng) -> np.ndarray:
    """How often each stratum (one per row) is drawn in each of `size` iterations."""
    times = np.ones((len(rows), size), np.int64)
    for depth in range(1, len(levels) + 1):
        upper = levels[:depth - 1]
        parents = rows.groupby(upper, sort=True) if upper else [((), rows)]
        for _, block in parents:
            names = block[levels[depth - 1]].drop_duplicates().sort_values()
            parent = times[block.index[0]]  # equal for all rows of the parent
            drawn = rng.multinomial(parent * len(names), np.full(len(names), 1 / len(names)))
            for i, name in enumerate(names):
                times[block.index[block[levels[depth - 1]] == name]] = drawn[:, i]
    return times


def drawn_sums(rng, k: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of the columns of v over k[i] rows drawn with chances as w, for each i.

    Few rows that stand for many are drawn as multinomial counts, a step for each of them; many that
    stand for few are drawn one by one, which is the same in distribution and much less per draw.
    """
    sums = np.empty((len(k), v.shape[1]))
    if len(w) < 1000 or w.sum() > 3 * len(w):
        step = max(1, 4_000_000 // max(len(w), 1))
        for a in range(0, len(k), step):
            sums[a:a + step] = rng.multinomial(k[a:a + step], w / w.sum()) @ v
        return sums
    each = [np.repeat(col, w.astype(np.int64)) for col in v.T]
    n = len(each[0])
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    piece = 1 << 20  # places held at a time
    for i, left in enumerate(k.tolist()):
        total = np.zeros(len(each))
        while left > 0:
            at = rng.integers(0, n, min(left, piece), dtype=kind)
            total += [col.take(at).sum() for col in each]
            left -= len(at)
        sums[i] = total
    return sums


def bootstrap_means(df: DataFrame, group, values, n_iter: int = 1000, seed: int = 0,
                    levels=(), leaf=(), pooled: bool = True, weight: str | None = None) -> DataFrame:
    """Resampled means: (group, leaf, iter, one column per value).

    levels: columns resampled with replacement from the top down, before the rows.
    leaf: further columns that share the draws of the levels but are averaged apart.
    pooled: mean over all drawn rows; otherwise mean over the drawn strata's means.
    weight: column that says how many equal rows a row stands for.
    """
    group, values, levels, leaf = list(group), list(values), list(levels), list(leaf)
    keys = [*group, *levels, *leaf]
    types = dict(df.dtypes)
    ddl = lambda cols: ", ".join(f"`{c}` {types[c]}" for c in cols)
    strata = keys or ["_all"]
    if not keys:
        df, types = df.withColumn("_all", F.lit(0)), {**types, "_all": "int"}
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    rows = df.select(*strata, *[F.col(v).cast("double").alias(v) for v in values],
                     times.alias("_w")).groupBy(*strata, *values).agg(F.sum("_w").alias("_w"))
    rows = materialize(rows, "resample")
    sizes = rows.groupBy(*strata).agg(
        F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("_chunks"))
    rows = rows.join(sizes, strata).withColumn(
        "_chunk", F.pmod(F.xxhash64(*values), F.col("_chunks")).cast("int")).drop("_chunks")
    weights = rows.groupBy(*strata, "_chunk").agg(F.sum("_w").alias("_cw"))
    batches = -(-n_iter // BATCH)
    tasks = weights.withColumn(
        "_batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))

    def allocate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*strata, "_chunk"]).reset_index(drop=True)
        batch = int(pdf["_batch"].iloc[0])
        size = min(BATCH, n_iter - batch * BATCH)
        rng = _rng(seed, batch, *[pdf[g].iloc[0] for g in group])
        stratum = pdf.groupby(strata, sort=False)["_cw"].sum().reset_index()
        times = _multiplicity(stratum, levels, size, rng) if levels else np.ones(
            (len(stratum), size), np.int64)
        out = []
        spans = pdf.groupby(strata, sort=False).indices.values()
        for total, count, at in zip(stratum["_cw"], times, spans):
            cw = pdf["_cw"].to_numpy()[at]
            draws = count * int(total)
            parts = [draws] if len(at) == 1 else list(rng.multinomial(draws, cw / cw.sum()).T)
            out += [(i, d, 1.0 if pooled else 1.0 / float(total)) for i, d in zip(at, parts)]
        out.sort(key=lambda e: e[0])
        keep = pdf[[*strata, "_chunk", "_batch"]].copy()
        keep["_draws"] = [d for _, d, _ in out]
        keep["_scale"] = [s for _, _, s in out]
        return keep

    (tasks,) = spread([*group, "_batch"], tasks)
    alloc = tasks.groupBy(*group, "_batch").applyInPandas(
        allocate, f"{ddl(strata)}, _chunk int, _batch int, _draws array<bigint>, _scale double")
    held = [*group, *leaf] or ["_all"]

    def draw(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(values).reset_index(drop=True)
        v = left[values].to_numpy(float)
        w = left["_w"].to_numpy(float)
        parts = []
        for _, task in right.sort_values("_batch").iterrows():
            rng = _rng(seed, "rows", task["_batch"], *key)
            k = np.asarray(task["_draws"], np.int64)
            sums = drawn_sums(rng, k, v, w)
            scale = task["_scale"]
            part = pd.DataFrame({"iter": int(task["_batch"]) * BATCH + np.arange(len(k)),
                                 "_n": k * scale})
            for j, name in enumerate(values):
                part[name] = sums[:, j] * scale
            for name in held:
                part[name] = left[name].iloc[0] if len(left) else None
            parts.append(part)
        return pd.concat(parts) if parts else pd.DataFrame()

    at = [*strata, "_chunk"]
    rows, alloc = spread(at, rows, alloc)
    sums = rows.groupBy(*at).cogroup(alloc.groupBy(*at)).applyInPandas(
        draw, f"iter bigint, _n double, {', '.join(f'`{v}` double' for v in values)}, {ddl(held)}")
    means = sums.groupBy(*held, "iter").agg(
        *[F.try_divide(F.sum(v), F.sum("_n")).alias(v) for v in values])
    return means if keys and held != ["_all"] else means.drop("_all")


def _interval(value: str, prefix: str = ""):
    """Linear 2.5 and 97.5 percentiles over the iterations, whose number is bounded."""
    return [F.percentile(value, F.lit(0.025)).alias(f"{prefix}ci_low"),
            F.percentile(value, F.lit(0.975)).alias(f"{prefix}ci_high")]


def boot_p(value):
    """Twice the smaller tail mass around zero; may exceed 1."""
    n = F.count(value)
    return F.when(n > 0, 2 * F.least(F.count_if(value <= 0), F.count_if(value >= 0)) / n)


def boot_mean_ci(df: DataFrame, keys, value: str, n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """Observed mean with a percentile interval."""
    keys = list(keys)
    seen = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"),
                                 F.stddev_samp(value).alias("sd"))
    ci = bootstrap_means(df.filter(F.col(value).isNotNull()), keys, [value], n_iter, seed).groupBy(
        *keys).agg(*_interval(value))
    return seen.join(ci, keys)


def boot_mean_halfwidth(scores: DataFrame, keys, measures=("f", "b", "m", "ns"),
                        subject="subject", measure="measure", value="score",
                        n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """Mean per measure and half the width of its interval, subjects resampled jointly.

    Subjects lacking a measure are left out.
    """
    keys, measures = list(keys), list(measures)
    wide = scores.groupBy(*keys, subject).agg(*[
        F.max(F.when(F.col(measure) == m, F.col(value))).alias(m) for m in measures]).dropna()
    seen = wide.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in measures])
    half = bootstrap_means(wide, keys, measures, n_iter, seed).groupBy(*keys).agg(*[
        ((F.percentile(m, F.lit(0.975)) - F.percentile(m, F.lit(0.025))) / 2).alias(m)
        for m in measures])
    means = seen.unpivot([*keys, "n"], measures, "measure", "mean")
    return means.join(half.unpivot(keys, measures, "measure", "ci_half"), [*keys, "measure"])


def nc_band(nc_rows: DataFrame, n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """Noise ceiling per ROI: mean over subjects of their mean, with a half width."""
    means = nc_rows.groupBy("roi", "subject").agg(F.avg("nc").alias("nc"))
    ci = boot_mean_ci(means, ["roi"], "nc", n_iter, seed)
    return ci.select("roi", "n", "mean", ((F.col("ci_high") - F.col("ci_low")) / 2).alias("ci_half"))


BASE = "baseline"


def flag_patterns(flags: DataFrame, conditions, keys=("task", "repeat"),
                  image="image_id") -> DataFrame:
    """Joint 0/1 outcomes per image: baseline and each condition (missing if not run)."""
    return flags.groupBy(*keys, image).agg(*[
        F.max(F.when(F.col("condition") == c, F.col("correct"))).cast("double").alias(c)
        for c in (BASE, *conditions)])


def compress(patterns: DataFrame, conditions, keys) -> DataFrame:
    """Joint outcomes with the number of images (_n) that show each: at most 3^k per split."""
    cols = [BASE, *conditions]
    counted = patterns.groupBy(*keys, *cols).agg(F.count("*").alias("_n"))
    return materialize(counted, "patterns")


def _drop_rows(counted: DataFrame, conditions, keys) -> DataFrame:
    """Long rows (keys, condition, base, les) of images that have both outcomes."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("condition"), F.col(c).alias("les")) for c in conditions]))
    return counted.select(*keys, "_n", F.col(BASE).alias("base"), rows.alias("r")).select(
        *keys, "_n", "r.condition", "base", "r.les").dropna()


def _pair_rows(counted: DataFrame, conditions, keys) -> DataFrame:
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("les_a"),
                 F.col(b).alias("les_b")) for a, b in type_pairs(list(conditions))]))
    return counted.select(*keys, "_n", F.col(BASE).alias("base"), rows.alias("r")).select(
        *keys, "_n", "r.*", "base").dropna()


def _avg(name):
    """Mean over images."""
    return F.sum(F.col(name) * F.col("_n")) / F.sum("_n")


def boot_drop_ci(patterns: DataFrame, conditions, keys=("task", "repeat"), n_iter: int = 10000,
                 seed: int = 0) -> DataFrame:
    """Accuracy drop per condition: bootstrap mean (`drop`), observed (`drop_point`), interval."""
    rows = _drop_rows(compress(patterns, conditions, keys), conditions, keys)
    group = [*keys, "condition"]
    n, m = F.sum("_n"), _avg("base")
    seen = rows.groupBy(*group).agg(
        n.alias("n"), m.alias("baseline"), _avg("les").alias("lesioned"),
        # flags are 0 or 1
        F.sqrt(F.try_divide(n * m * (1 - m), n - 1)).alias("baseline_sd"),
        (m - _avg("les")).alias("drop_point"))
    boot = bootstrap_means(rows, group, ["base", "les"], n_iter, seed, weight="_n").withColumn(
        "_d", F.col("base") - F.col("les")).groupBy(*group).agg(
        F.avg("_d").alias("drop"), *_interval("_d"))
    return seen.join(boot, group).withColumn("ci_half", (F.col("ci_high") - F.col("ci_low")) / 2)


def boot_paired_diff(patterns: DataFrame, conditions, keys=("task", "repeat"),
                     n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """Difference of the drops of every pair of conditions, drawn on the same images."""
    rows = _pair_rows(compress(patterns, conditions, keys), conditions, keys)
    group = [*keys, "a", "b"]
    seen = rows.groupBy(*group).agg((_avg("les_b") - _avg("les_a")).alias("diff_point"))
    diff = (F.col("base") - F.col("les_a")) - (F.col("base") - F.col("les_b"))
    boot = bootstrap_means(rows, group, ["base", "les_a", "les_b"], n_iter, seed, weight="_n") \
        .withColumn("_d", diff).groupBy(*group).agg(
        F.avg("_d").alias("mean_diff"), *_interval("_d"), boot_p(F.col("_d")).alias("p"))
    return seen.join(boot, group)


def _scaled(rows: DataFrame, keys, columns, counted: DataFrame) -> DataFrame:
    """Rows as they are and divided by their split's baseline accuracy, told apart by `scale`."""
    acc = counted.groupBy(*keys).agg(_avg(BASE).alias("_acc"))
    both = F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), *[(F.try_divide(F.col(c), F.col("_acc")) if s == "rel"
                                             else F.col(c)).alias(c) for c in columns])
        for s in ("abs", "rel")]))
    keep = [c for c in rows.columns if c not in columns]
    return rows.join(acc, list(keys)).select(*keep, both.alias("s")).select(*keep, "s.*")


def boot_hier_drop(patterns: DataFrame, conditions, keys=("task",), split="repeat",
                   n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """Drops over splits: splits are resampled, then the images of each drawn split."""
    at = [*keys, split]
    counted = compress(patterns, conditions, at)
    rows = _scaled(_drop_rows(counted, conditions, at), at, ["base", "les"], counted)
    group = [*keys, "scale", "condition"]
    boot = bootstrap_means(rows, group, ["base", "les"], n_iter, seed, levels=[split],
                           pooled=False, weight="_n").withColumn("_d", F.col("base") - F.col("les"))
    out = boot.groupBy(*group).agg(
        F.avg("_d").alias("mean_drop"), *_interval("_d"), boot_p(F.col("_d")).alias("p"))
    return out.join(rows.groupBy(*group).agg(F.countDistinct(split).alias("n_splits")), group)


def boot_hier_paired(patterns: DataFrame, conditions, keys=("task",), split="repeat",
                     n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """Paired differences over splits, with Cohen's d of the splits' own differences."""
    at = [*keys, split]
    counted = compress(patterns, conditions, at)
    rows = _scaled(_pair_rows(counted, conditions, at), at, ["base", "les_a", "les_b"], counted)
    group = [*keys, "scale", "a", "b"]
    boot = bootstrap_means(rows, group, ["base", "les_a", "les_b"], n_iter, seed, levels=[split],
                           pooled=False, weight="_n").withColumn("_d", F.col("les_b") - F.col("les_a"))
    out = boot.groupBy(*group).agg(
        F.avg("_d").alias("mean_diff"), *_interval("_d"), boot_p(F.col("_d")).alias("p"))
    own = rows.groupBy(*group, split).agg((_avg("les_b") - _avg("les_a")).alias("_s"))
    effect = own.groupBy(*group).agg(
        F.count("*").alias("n_splits"),
        F.when(F.stddev_samp("_s") > 0, F.avg("_s") / F.stddev_samp("_s")).alias("cohens_d"))
    return out.join(effect, group)


def boot_hier_units(units: DataFrame, keys, value: str, n_iter: int = 10000, seed: int = 0,
                    levels=("model", "layer")) -> DataFrame:
    """Grand mean over all units; interval from models, then layers, then units resampled."""
    keys = list(keys)
    ok = units.filter(F.col(value).isNotNull() & ~F.isnan(value))
    seen = ok.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    ci = bootstrap_means(ok, keys, [value], n_iter, seed, levels=levels).groupBy(*keys).agg(
        *_interval(value))
    return seen.join(ci, keys)


def distribution_values(units: DataFrame, values: dict[str, str], keys=("sel_type",)) -> DataFrame:
    """Long (keys, model, layer, metric, value) of several value columns, missing ones dropped."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("value"))
        for k, c in values.items()]))
    return units.select(*keys, "model", "layer", rows.alias("r")).select(
        *keys, "model", "layer", "r.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def dprime_distribution(units: DataFrame) -> DataFrame:
    """Face and body d' of every unit by its type."""
    return distribution_values(units, {"face": "face_d", "body": "body_d"})


def response_distribution(z: DataFrame, groups: DataFrame,
                          categories=("face", "body", "object")) -> DataFrame:
    """Mean z response of every unit to each category, by its type."""
    rows = z.filter(F.col("category").isin(*categories)).join(
        groups.select("model", "layer", "unit_id", "sel_type"), ["model", "layer", "unit_id"])
    return rows.filter(F.col("z").isNotNull() & ~F.isnan("z")).select(
        "sel_type", "model", "layer", "unit_id", F.col("category").alias("metric"), F.col("z").alias("value"))


def distribution_report(rows: DataFrame, n_iter: int = 1000, seed: int = 0) -> DataFrame:
    """Hierarchical mean and interval by type and metric of a distribution table."""
    return boot_hier_units(rows, ["sel_type", "metric"], "value", n_iter, seed)


def dprime_report(units: DataFrame, n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """Group mean face and body d' per unit type."""
    return distribution_report(dprime_distribution(units), n_iter, seed)


# Contrasts of the mean d' of unit types, as SQL over <type>_face and <type>_body.
CONTRASTS = {
    "face units: face d' - body d'": "face_face - face_body",
    "body units: body d' - face d'": "body_body - body_face",
    "interaction": "(face_face - face_body) - (body_face - body_body)",
}
EXTRA_CONTRASTS = {
    "mixed units: face d' - body d'": "mixed_face - mixed_body",
    "non-selective: face d' - body d'": "nonselective_face - nonselective_body",
}
UNIT_TYPES = ("face", "body", "mixed", "nonselective")


def boot_dprime_contrasts(units: DataFrame, contrasts: dict[str, str] | None = None,
                          types=UNIT_TYPES, n_iter: int = 1000, seed: int = 0,
                          cell_tests: bool = True) -> DataFrame:
    """Contrasts and cells of mean (face d', body d') per type, one BH family over all.

    Models and layers are drawn once per iteration for all types, units within each.
    """
    contrasts = {**CONTRASTS, **EXTRA_CONTRASTS} if contrasts is None else contrasts
    ok = units.filter(F.col("sel_type").isin(*types)).select(
        "model", "layer", "sel_type", "face_d", "body_d").filter(
        F.col("face_d").isNotNull() & F.col("body_d").isNotNull()
        & ~F.isnan("face_d") & ~F.isnan("body_d"))
    names = {f"{s}_{k}": (s, f"{k}_d") for s in types for k in ("face", "body")}
    wide = lambda df, keys, agg: df.groupBy(*keys).agg(*[
        agg(F.when(F.col("sel_type") == s, F.col(c))).alias(n) for n, (s, c) in names.items()])
    items = {**contrasts, **({n: n for n in names} if cell_tests else {})}
    long = lambda df, keys: df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(k).alias("contrast"), F.expr(e).cast("double").alias("v"))
        for k, e in items.items()])).alias("r")).select(*keys, "r.*")
    observed = long(wide(ok, [], F.avg), []).withColumnRenamed("v", "value")
    boot = bootstrap_means(ok, [], ["face_d", "body_d"], n_iter, seed, ["model", "layer"],
                           ["sel_type"])
    tests = long(wide(boot, ["iter"], F.max), ["iter"]).groupBy("contrast").agg(
        *_interval("v"), boot_p(F.col("v")).alias("p_raw"))
    return fdr_adjust_few(observed.join(tests, "contrast"), (), "p_raw", "bh", "p")
