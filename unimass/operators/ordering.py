"""Exact positions, ranks and percentiles of groups of any size.

A window over a group sorts that group in one task. Here the rows are range-partitioned on
(group, value, tie-break) instead, so that a group of any size spreads over many tasks; each
slice is numbered as it is written in order and shifted by the sizes of the slices before it.

Percentiles do not sort: sketches bracket the wanted order statistics, a pass counts what lies
below and between, and only what lies between is put in order, after more rounds if it is much.

There is one way for all sizes; adaptive execution folds the slices of a small input together.
Null keys are a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unimass.session import join_on, materialize

SLICE, PLACE = "_slice", "_place"
ACCURACY, FEW = 10_000, 100_000  # of a sketch; distinct values of a bracket that one task may order


def _names(keys):
    return list(keys) if keys else []


def _sliced(df: DataFrame, keys: list, order: list[Column], label: str) -> DataFrame:
    """df range-partitioned, sorted and written once, with its slice and the row's number in all slices."""
    cut = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(
        *[F.col(k) for k in keys], *order)
    cut = cut.withColumn(PLACE, F.monotonically_increasing_id())  # counts up within each sorted slice
    return materialize(cut, label).withColumn(SLICE, F.shiftrightunsigned(PLACE, 33))


def global_order(df: DataFrame, keys, order: list[Column], label: str = "order") -> DataFrame:
    """Add `pos` (1-based place of the row in its group) and `group_n`, exactly.

    `order` should end in a unique column: a heavily tied value is then split as well.
    """
    keys = _names(keys)
    cut = _sliced(df, keys, order, label)
    by_slice = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
    before = F.sum("_size").over(by_slice.rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut.groupBy(*keys, SLICE).agg(F.count("*").alias("_size"), F.min(PLACE).alias("_first")).select(
        *keys, SLICE, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_size").over(
            by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("group_n"),
    )
    return join_on(cut, sizes, [*keys, SLICE]).withColumn(
        "pos", F.col(PLACE) + F.col("_shift")).drop(PLACE, "_shift")


def tie_counts(df: DataFrame, keys: list, value: str) -> DataFrame:
    """(keys, value, _ties, _upto, _total): rows at, and up to, each distinct value of a group.

    Ties are counted before anything is sorted, so that a value with most of the rows is one row.
    """
    distinct = df.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    cut = _sliced(distinct, keys, [F.col(value)], "ties")
    within = Window.partitionBy(*keys, SLICE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    by_slice = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
    before = F.sum("_sum").over(by_slice.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_sum").over(by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = cut.groupBy(*keys, SLICE).agg(F.sum("_ties").alias("_sum")).select(
        *keys, SLICE, F.coalesce(before, F.lit(0)).alias("_before"), total.alias("_total"))
    return join_on(cut.withColumn("_in", F.sum("_ties").over(within)), sums, [*keys, SLICE]).withColumn(
        "_upto", F.col("_before") + F.col("_in")).drop("_before", "_in", SLICE, PLACE)


def _brackets(values: DataFrame, keys: list, fractions: list[float]) -> DataFrame:
    """(keys, _i, _low, _high, _below, _inside, _n): bounds around each fraction's order statistics.

    `values` is (keys, _v). The bounds come from sketches; what is below and distinct inside is counted.
    A sketch that misses its promise leaves the whole group as the bracket.
    """
    around = [min(max(p + d, 0.0), 1.0) for p in fractions for d in (-2 / ACCURACY, 2 / ACCURACY)]
    sketch = F.percentile_approx("_v", around, ACCURACY)
    bounds = values.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                       sketch.alias("_q"))
    each = F.explode(F.array(*[F.struct(
        F.lit(i).alias("_i"), F.col("_q")[2 * i].alias("_low"), F.col("_q")[2 * i + 1].alias("_high"))
        for i in range(len(fractions))])).alias("_e")
    bounds = bounds.select(*keys, "_n", "_min", "_max", each).select(*keys, "_n", "_min", "_max", "_e.*")
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    counted = join_on(values, bounds, keys).groupBy(*keys, "_i").agg(
        *[F.first(c).alias(c) for c in ("_n", "_min", "_max", "_low", "_high")],
        F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(inside).alias("_inside"))
    h = F.element_at(F.array(*[F.lit(float(p)) for p in fractions]), F.col("_i") + 1) * (F.col("_n") - 1)
    held = (F.col("_below") <= F.floor(h)) & (F.ceil(h) < F.col("_below") + F.col("_inside"))
    whole = lambda c, other: F.when(held, F.col(c)).otherwise(other).alias(c)
    return counted.select(*keys, "_i", "_n", whole("_low", F.col("_min")), whole("_high", F.col("_max")),
                          whole("_below", F.lit(0)), whole("_inside", F.col("_n")))


def exact_percentile(df: DataFrame, keys, value: str, pcts: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles of the finite values of each group.

    `pcts` maps an output column to a fraction in [0, 1]. Equal values are counted, not kept.
    """
    keys = _names(keys)
    fractions = [float(p) for p in pcts.values()]
    counted = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    values = materialize(counted, "values")
    bounds = materialize(_brackets(values, keys, fractions), "bounds")
    near = join_on(values, bounds, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    ties = near.groupBy(*keys, "_i", "_v").agg(
        F.count("*").alias("_ties"), F.first("_below").alias("_below"), F.first("_n").alias("_n"))
    if bounds.where(F.col("_inside") > FEW).isEmpty():
        order = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = ties.withColumn("_upto", F.col("_below") + F.sum("_ties").over(order))
    else:  # a wide bracket is ordered like any large group
        ranked = tie_counts(near.select(*keys, "_i", "_v"), [*keys, "_i"], "_v")
        ranked = join_on(ranked, bounds.select(*keys, "_i", "_below", "_n"), [*keys, "_i"]).withColumn(
            "_upto", F.col("_upto") + F.col("_below"))
    h = F.element_at(F.array(*[F.lit(p) for p in fractions]), F.col("_i") + 1) * (F.col("_n") - 1)
    holds = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_ties") <= at)
    aggs = []
    for i, name in enumerate(pcts):
        own = F.col("_i") == i
        v_low, v_high = (F.max(F.when(own & holds(at), F.col("_v"))) for at in (F.floor(h), F.ceil(h)))
        aggs.append((v_low + (v_high - v_low) * F.max(F.when(own, h - F.floor(h)))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def average_rank(df: DataFrame, keys, value: str, out: str = "avg_rank") -> DataFrame:
    """Average ranks with ties, for groups of any size; missing values come first."""
    keys = _names(keys)
    ranks = tie_counts(df, keys, value).select(
        *keys, value, (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(out))
    return join_on(df, ranks, [*keys, value])
