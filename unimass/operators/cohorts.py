"""Ranked and count-matched groups of units, top images, winners and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unimass.operators.moments import UNIT
from unimass.operators.ordering import global_order

SELECTIVE = ("face", "body", "mixed")
REST = "nonselective"


def nonselective_units(selected: DataFrame, keys=UNIT, types=SELECTIVE) -> DataFrame:
    """All units of a layer that carry none of the selective types."""
    units = selected.select(*keys).distinct()
    taken = selected.filter(F.col("selected") & F.col("sel_type").isin(*types)).select(*keys)
    return units.join(taken, list(keys), "left_anti")


def unit_groups(selected: DataFrame, keys=UNIT, types=SELECTIVE, reference="mixed") -> DataFrame:
    """(unit, sel_type, dval): selective units by type and the non-selective remainder.

    One pass: each unit's rows are folded into a list that the number of types bounds.
    """
    entry = F.struct("sel_type", "dval", "selected")
    rows = selected.filter(F.col("sel_type").isin(*{*types, reference})).groupBy(*keys).agg(
        F.collect_list(entry).alias("r"))
    # a unit may not have a row for every type
    own = F.filter("r", lambda r: r["selected"] & r["sel_type"].isin(*types))
    ref = F.filter("r", lambda r: r["sel_type"] == reference)[0]["dval"]
    rest = F.array(F.struct(F.lit(REST).alias("sel_type"), ref.alias("dval"),
                            F.lit(True).alias("selected")))
    return rows.select(*keys, F.explode(F.when(F.size(own) > 0, own).otherwise(rest)).alias("g")
                       ).select(*keys, "g.sel_type", "g.dval")


def rank_units(groups: DataFrame, controlled: bool = False, n_top: int | None = None,
               keys=("model", "layer"), types=SELECTIVE) -> DataFrame:
    """Units of each type in order: selective ones by falling d', the rest by rising d'.

    controlled: every group is cut to n_top, or to the smallest non-empty selective type.
    n_top alone cuts the selective types only. Ties go to the smaller unit id.
    """
    key = F.when(F.col("sel_type") == REST, F.col("dval")).otherwise(-F.col("dval"))
    keyed = groups.withColumn("_key", key)
    if n_top is not None and controlled:  # each task then keeps n_top rows of a group
        place = F.row_number().over(Window.partitionBy(*keys, "sel_type").orderBy("_key", "unit_id"))
        return keyed.withColumn("rank", place.cast("long")).filter(F.col("rank") <= n_top).select(
            *keys, "sel_type", "unit_id", "dval", "rank")
    placed = global_order(keyed, [*keys, "sel_type"], [F.col("_key"), F.col("unit_id")], "cohort")
    ranked = placed.select(*keys, "sel_type", "unit_id", "dval", F.col("pos").alias("rank"))
    if controlled:
        sizes = ranked.filter(F.col("sel_type").isin(*types)).groupBy(*keys, "sel_type").count()
        least = sizes.groupBy(*keys).agg(F.min("count").alias("_cut"))
        # a layer without selective units has nothing to match
        return ranked.join(least, list(keys), "left").filter(
            F.col("_cut").isNull() | (F.col("rank") <= F.col("_cut"))).drop("_cut")
    if n_top is not None:
        return ranked.filter((F.col("sel_type") == REST) | (F.col("rank") <= n_top))
    return ranked


def lesion_cohorts(groups: DataFrame, keys=("model", "layer"), types=SELECTIVE) -> DataFrame:
    """Count-matched cohorts for ablation; without selective units the rest stays whole."""
    return rank_units(groups, controlled=True, keys=keys, types=types)


def mean_type_response(acts: DataFrame, cohort: DataFrame, value="act") -> DataFrame:
    """Per image: mean activation over the units of each type."""
    members = cohort.select("model", "layer", "unit_id", "sel_type")
    return acts.join(members, ["model", "layer", "unit_id"]).groupBy(
        "model", "image_id", "sel_type").agg(F.avg(value).alias("resp"))


def last_layers(dim_model: DataFrame) -> DataFrame:
    """The deepest layer of each model."""
    return dim_model.groupBy("model").agg(F.max_by("layer", "layer_ord").alias("layer"))


def top_images(responses: DataFrame, n: int) -> DataFrame:
    """Per model z-score (ddof 0) of image means, averaged over models, best n per type."""
    stats = responses.groupBy("model", "sel_type").agg(
        F.avg("resp").alias("_m"), F.stddev_pop("resp").alias("_s"))
    z = responses.join(stats, ["model", "sel_type"]).withColumn(
        "_z", F.try_divide(F.col("resp") - F.col("_m"), F.col("_s")))
    score = z.groupBy("sel_type", "image_id").agg(F.avg("_z").alias("score"))
    # rank <= n is pushed below the shuffle: each task keeps its own n best
    place = F.row_number().over(
        Window.partitionBy("sel_type").orderBy(F.desc("score"), "image_id"))
    return score.withColumn("rank", place).filter(F.col("rank") <= n)


def winner_take_all(values: DataFrame, blocks: list[str], keys=("subject", "voxel_id"),
                    block="block", value="value") -> DataFrame:
    """Best block of each voxel and its value; ties go to the earlier block of the list.

    Values that differ by rounding alone (a relative 1e-12) are tied: means of equal rows depend in
    their last bits on the order in which a shuffle brings them.
    """
    v = F.when(~F.isnan(value), F.col(value))
    each = [F.max(F.when(F.col(block) == b, v)).alias(f"_{i}") for i, b in enumerate(blocks)]
    held = [F.col(f"_{i}") for i in range(len(blocks))]
    best = F.greatest(*held) if len(held) > 1 else held[0]
    near = lambda c: (c == F.col("best")) | (c >= F.col("best") - 1e-12 * F.abs("best"))
    winner = F.coalesce(*[F.when(near(c), F.lit(b)) for b, c in zip(blocks, held)])
    return values.groupBy(*keys).agg(*each).withColumn("best", best).select(*keys, winner.alias("winner"), "best")


def dprime_summary(cohort: DataFrame, method: str = "layer-mean",
                   types=SELECTIVE) -> DataFrame:
    """Mean and sd (0 for a single value) of d' per type, over layer means or all units."""
    if method not in ("units", "layer-mean"):
        raise ValueError("method must be 'units' or 'layer-mean'")
    own = cohort.filter(F.col("sel_type").isin(*types))
    layers = own.groupBy("model", "layer", "sel_type").agg(
        F.avg("dval").alias("m"), F.count("*").alias("n"), F.var_samp("dval").alias("v"))
    spread = lambda sd, n: F.when(n > 1, sd).otherwise(0.0)
    sizes = [F.sum("n").alias("n_units"), F.count("*").alias("n_layers")]
    if method == "layer-mean":
        return layers.groupBy("model", "sel_type").agg(
            F.avg("m").alias("mean"), spread(F.stddev_samp("m"), F.count("*")).alias("sd"), *sizes)
    total = layers.groupBy("model", "sel_type").agg(*sizes)
    units = own.groupBy("model", "sel_type").agg(
        F.avg("dval").alias("mean"),
        spread(F.stddev_samp("dval"), F.count("*")).alias("sd"))
    return units.join(total, ["model", "sel_type"])


def hash_order(df: DataFrame, keys, id_col: str, seed, out: str = "pos") -> DataFrame:
    """Place of each row in a seeded shuffle of its group, with the group's size; the seed may be a column."""
    mixed = F.xxhash64(F.lit(seed), F.col(id_col))
    return global_order(df.withColumn("_mix", mixed), keys, [F.col("_mix"), F.col(id_col)],
                        "shuffle").withColumnRenamed("pos", out).drop("_mix", "_slice")


def stratified_split(images: DataFrame, train: float = 0.6, val: float = 0.2, test: float = 0.2,
                     seed=0, category="category", image="image_id", keys=()) -> DataFrame:
    """Seeded split within each class: round(n * train), round(n * val), the rest for testing.

    Halves round to even. With keys every value of them is split apart, by a seed of its own if the
    seed is a column.
    """
    if abs(train + val + test - 1.0) > 1e-8:
        raise ValueError("the fractions must add up to 1")
    placed = hash_order(images, [*keys, category], image, seed)
    n = F.col("group_n")
    n_train, n_val = F.bround(n * F.lit(train), 0), F.bround(n * F.lit(val), 0)
    part = F.when(F.col("pos") <= n_train, "train").when(
        F.col("pos") <= n_train + n_val, "val").otherwise("test")
    return placed.withColumn("split", part).drop("pos", "group_n")


def fold_of(place, n, k: int):
    """Fold of a 0-based place when the first n % k of k folds hold one more."""
    size, extra = F.floor(n / k), n % k
    head = extra * (size + 1)
    return F.when(place < head, F.floor(place / (size + 1))).otherwise(
        extra + F.floor((place - head) / F.greatest(size, F.lit(1)))).cast("int")


def fold_cells(images: DataFrame, keys=("subject",), image="image_id", k_outer: int = 10,
               k_inner: int = 5, seed: int = 0) -> DataFrame:
    """Outer and inner fold of every image: shuffled k-fold, then k-fold inside each outer fold.

    Images of an outer fold are consecutive in the shuffle, and the shuffle within a fold is as
    random as the whole: the inner folds follow from the place alone.
    """
    placed = hash_order(images.select(*keys, image), list(keys), image, seed)
    n, place = F.col("group_n"), F.col("pos") - 1
    size, extra = F.floor(n / k_outer), n % k_outer
    outer = fold_of(place, n, k_outer)
    start = outer * size + F.least(outer, extra)
    width = size + F.when(outer < extra, 1).otherwise(0)
    inner = fold_of(place - start, width, k_inner)
    return placed.select(
        *keys, image, place.alias("place"), n.alias("n_images"), outer.alias("outer_fold"),
        inner.alias("inner_fold"), (outer * k_inner + inner).alias("cell"))
