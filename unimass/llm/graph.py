"""Connected components of very large link tables by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.session import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (u, v): root is the smallest node of its component.

    Each round links the larger neighbours of a node to its smallest one, then the smaller ones.
    Every step aggregates partially and joins, no neighbourhood is held as a list. The state of a
    round is a written table. Nodes compare as signed numbers.
    """
    state = materialize(links.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        larger = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = materialize(larger.where("u != v").distinct(), "larger")
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = materialize(smaller.where("u != v").union(low).distinct(), "stars")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise ValueError(f"links did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
