"""Linear readouts of unit activations: scores, accuracy, losses and ablation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.operators import resample as rs
from unimass.operators import training as tr
from unimass.operators.cohorts import stratified_split
from unimass.operators.inference import fdr_adjust_few
from unimass.operators.ordering import global_order


def topk_flags(scores: DataFrame, k: int, row="row_id", cls="class", label="label",
               score="score") -> DataFrame:
    """1 if the label is among a row's k best classes; equal scores go to the smaller class.

    The label's rank is the number of classes that beat it: no sort, two aggregates.
    """
    best = F.max(F.when(F.col(cls) == F.col(label), F.col(score)))
    own = scores.groupBy(row, label).agg(
        best.alias("_own"), F.collect_list(F.struct(score, cls)).alias("_all"))
    ahead = F.size(F.filter("_all", lambda e: (e[score] > F.col("_own")) | (
        (e[score] == F.col("_own")) & (e[cls] < F.col(label)))))
    return own.select(row, label, F.when(F.col("_own").isNotNull() & (ahead < k), 1).otherwise(0).alias("correct"))


def accuracy(flags: DataFrame, keys=()) -> DataFrame:
    """Mean and sd (ddof 1) of 0/1 flags."""
    return flags.groupBy(*keys).agg(
        F.avg("correct").alias("accuracy"), F.stddev_samp("correct").alias("sd"),
        F.count("*").alias("n"))


def mean_log_loss(scores: DataFrame, row="row_id", cls="class", label="label",
                  score="score") -> DataFrame:
    """Mean cross entropy of the softmax over a row's scores."""
    per = scores.groupBy(row, label).agg(
        F.max(score).alias("_m"), F.collect_list(score).alias("_all"),
        F.max(F.when(F.col(cls) == F.col(label), F.col(score))).alias("_own"))
    total = F.aggregate("_all", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("_m")))
    loss = F.log(total) + F.col("_m") - F.col("_own")
    return per.select(row, loss.alias("loss")).agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


def sparse_penalty(weights: DataFrame, l1_pos: float, l1_neg: float, w="w") -> DataFrame:
    """Separate L1 penalties of positive and negative weights."""
    return weights.agg((l1_pos * F.sum(F.greatest(w, F.lit(0.0)))).alias("l1_pos"),
                       (l1_neg * F.sum(F.greatest(-F.col(w), F.lit(0.0)))).alias("l1_neg"))


def features(acts: DataFrame, keys=("image_id", "label"), unit="unit_id", value="act") -> DataFrame:
    """One feature array per image, in unit order (as long as a readout layer is wide)."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(unit), F.col(value).cast("double").alias("v"))))
    return acts.groupBy(*keys).agg(F.transform(cells, lambda e: e["v"]).alias("x"))


def linear_readout(rows: DataFrame, reg: float = 1e-4, max_iter: int = 50) -> DataFrame:
    """Softmax classifier of (x, label) at its optimum: one row per class with weights w and intercept.

    `training.train_epochs` is the form that keeps the best of several epochs, for many models.
    """
    lr = LogisticRegression(regParam=reg, maxIter=max_iter, family="multinomial")
    model = lr.fit(rows.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label")))
    table = [(c, [float(v) for v in w], float(b)) for c, (w, b) in enumerate(
        zip(model.coefficientMatrix.toArray(), model.interceptVector.toArray()))]
    return rows.sparkSession.createDataFrame(table, "class int, w array<double>, b double")


def readout_quality(rows: DataFrame, readout: DataFrame, k: int = 1) -> DataFrame:
    """(loss, accuracy, sd, n) of a readout on test rows (image_id, label, x)."""
    scores = readout_scores(rows, readout)
    right = accuracy(topk_flags(scores, k, row="image_id"))
    return mean_log_loss(scores, row="image_id").drop("n").crossJoin(right)  # one row each


def _weights(readout: DataFrame):
    """Weights, intercepts and class ids of a readout (classes x units numbers)."""
    table = sorted(readout.collect(), key=lambda r: r["class"])
    return (np.array([r["w"] for r in table]), np.array([r["b"] for r in table]),
            np.array([r["class"] for r in table]))


def readout_scores(rows: DataFrame, readout: DataFrame, keys=("image_id", "label")) -> DataFrame:
    """Score of each image and class."""
    coef, bias, classes = _weights(readout)

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x) @ coef.T + bias)) if len(x) else pd.Series([], dtype=object)

    each = rows.select(*keys, F.posexplode(score("x")).alias("_p", "score"))
    ids = F.array(*[F.lit(int(c)) for c in classes])
    return each.select(*keys, F.element_at(ids, F.col("_p") + 1).alias("class"), "score")


def lesion_units(acts: DataFrame, cohort: DataFrame, sel_type: str) -> DataFrame:
    """Activations with the units of one type set to zero (rows kept, value 0)."""
    gone = cohort.filter(F.col("sel_type") == sel_type).select("layer", "unit_id", F.lit(True).alias("_gone"))
    return acts.join(gone, ["layer", "unit_id"], "left").withColumn(
        "act", F.when(F.col("_gone"), F.lit(0.0)).otherwise(F.col("act"))).drop("_gone")


def unit_factors(acts: DataFrame, cohort: DataFrame, types=rs.UNIT_TYPES) -> dict[str, np.ndarray]:
    """For every type with units among those of acts, and for none, a factor for each feature: 0 or 1.

    Features are in the order of unit ids; a factor array is as long as one class's weights.
    """
    placed = global_order(acts.select("unit_id").distinct(), [], [F.col("unit_id")], "units")
    own = cohort.groupBy("unit_id").agg(F.collect_set("sel_type").alias("_types"))
    factor = lambda name: F.when(F.array_contains("_types", name), F.lit(0.0)).otherwise(F.lit(1.0))
    ordered = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("pos", factor(name).alias("f")))), lambda e: e["f"])
    found = placed.join(own, "unit_id", "left").agg(*[ordered(name).alias(name) for name in types]).first()
    arrays = {name: np.array(found[name]) for name in types}
    return {rs.BASE: np.ones(len(arrays[types[0]]))} | {n: a for n, a in arrays.items() if (a == 0).any()}


def lesion_pairwise(patterns: DataFrame, conditions, **kw) -> DataFrame:
    """All pairs of conditions on the same images."""
    return rs.boot_paired_diff(patterns, conditions, **kw)


def baseline_summary(patterns: DataFrame, keys=("task",), split="repeat", n_iter: int = 10000,
                     seed: int = 0) -> DataFrame:
    """Baseline accuracy over splits: mean, sd and interval."""
    acc = patterns.groupBy(*keys, split).agg(F.avg(rs.BASE).alias("acc"))
    return rs.boot_mean_ci(acc, keys, "acc", n_iter, seed)


def lesion_summary(patterns: DataFrame, conditions, keys=("task",), split="repeat",
                   n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """One long table: baseline, drop per type and difference per pair, absolute and relative.

    sd is that of the baseline over splits.
    """
    null = lambda t: F.lit(None).cast(t)
    cols = lambda df, kind, a, b, mean, p, d, sd=null("double"): df.select(
        *keys, F.lit(kind).alias("kind"), "scale", a.alias("a"), b.alias("b"), F.col(mean).alias("mean"),
        "ci_low", "ci_high", p.alias("p"), d.alias("cohens_d"), "n_splits", sd.alias("sd"))
    base = baseline_summary(patterns, keys, split, n_iter, seed).withColumn("scale", F.lit("abs")) \
        .withColumnRenamed("n", "n_splits")
    drop = rs.boot_hier_drop(patterns, conditions, keys, split, n_iter, seed)
    pair = rs.boot_hier_paired(patterns, conditions, keys, split, n_iter, seed)
    return cols(base, "baseline", F.lit(rs.BASE), null("string"), "mean", null("double"), null("double"), F.col("sd")) \
        .unionByName(cols(drop, "drop", F.col("condition"), null("string"), "mean_drop", F.col("p"), null("double"))) \
        .unionByName(cols(pair, "pair", F.col("a"), F.col("b"), "mean_diff", F.col("p"), F.col("cohens_d")))


def lesion_report(summary: DataFrame, scale: str = "rel", n_iter: int = 10000, keys=("task",)) -> DataFrame:
    """Corrected p within a task, over types and over pairs apart, with the floor of 2 / n_iter."""
    rows = summary.filter((F.col("scale") == scale) & F.col("kind").isin("drop", "pair"))
    out = fdr_adjust_few(rows, [*keys, "kind"])
    floor = 2.0 / n_iter
    return out.withColumn("at_floor", F.col("p_adj") <= floor)


def lesion_bars(summary: DataFrame, scale: str = "rel") -> DataFrame:
    """Mean drop with the distances to its limits, in percent."""
    rows = summary.filter((F.col("scale") == scale) & (F.col("kind") == "drop"))
    return rows.select("task", F.col("a").alias("sel_type"), (100 * F.col("mean")).alias("mean"),
                       (100 * (F.col("mean") - F.col("ci_low"))).alias("below"),
                       (100 * (F.col("ci_high") - F.col("mean"))).alias("above"))


def repeat_runs(images: DataFrame, acts: DataFrame, cohort: DataFrame, task: str, n_repeats: int = 10,
                base_seed: int = 0, k: int = 1, **training) -> DataFrame:
    """(task, repeat, image_id, condition, correct): split, fit, lesion and score once per seed.

    `images` is (image_id, label). The splits of all seeds are made together, their readouts are
    trained in the same passes over the features, and the test rows of all are scored in one more.
    """
    seeds = F.explode(F.array(*[F.lit(base_seed + r) for r in range(n_repeats)])).alias("seed")
    split = stratified_split(images.select("image_id", "label", seeds), seed=F.col("seed"), category="label", keys=("seed",))
    models = tr.models_of(split, features(acts, ["image_id"]), ["seed"])
    readouts = tr.best_epoch(tr.train_epochs(models, seed=base_seed, **training))
    flags = tr.lesion_flags(models, readouts, unit_factors(acts, cohort), k)
    return tr.named(models, flags).select(F.lit(task).alias("task"), (F.col("seed") - base_seed).alias("repeat"),
                                          "image_id", "condition", "correct")
