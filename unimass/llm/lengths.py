"""Token counts of documents as an exact histogram of encoded lengths.

One row per distinct length, so that its size follows the longest document and not the corpus.
Suffix sums over it answer, for every context limit, how many documents are longer, how many
tokens a corpus cut to that limit keeps, and every quantile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unimass.llm.arrow import map_slices, texts_of
from unimass.llm.tokens import encoder, vocabulary_path
from unimass.session import materialize

BLOCK = 256  # lengths summed together on the way to suffix sums


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents per encoded length. A null text counts as an empty one.

    Counted within each task first; only (length, count) pairs are shuffled. Repeated rows count
    each time; an empty table gives an empty histogram.
    """
    path = vocabulary or vocabulary_path()

    def make():
        ids = encoder(path)

        def count(batch):
            lengths, n = np.unique([len(ids(t)) for t in batch.column("text").to_pylist()],
                                   return_counts=True)
            return {"n_tokens": pa.array(lengths, pa.int64()), "n": pa.array(n, pa.int64())}

        return count

    counts = map_slices(texts_of(docs), make, "n_tokens long, n long")
    return counts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with totals of the documents of at least, and at most, each length.

    Columns beside n_tokens and n_docs: docs_from and tokens_from (documents at least as long),
    docs_to and tokens_to (at most as long), and kept_tokens, the tokens that are left if every
    document is cut to n_tokens. Two levels: within blocks of lengths, and over the blocks, whose
    number is the longest length divided by the block. The histogram is read by both and therefore
    written first.
    """
    histogram = materialize(histogram, "lengths")
    rows = histogram.withColumn("block", F.expr(f"n_tokens div {int(block)}")).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    over = Window.partitionBy(F.lit(0)).orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    after = over.rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("block"),
        *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{v}_{n}")
          for v in "dt" for w, n in ((before, "before"), (after, "after"))])
    within = Window.partitionBy("block").orderBy("n_tokens")
    to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_ = within.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    summed = rows.join(blocks, "block").select(
        "n_tokens", "n_docs",
        (F.sum("n_docs").over(from_) + F.col("d_after")).alias("docs_from"),
        (F.sum("tokens").over(from_) + F.col("t_after")).alias("tokens_from"),
        (F.sum("n_docs").over(to) + F.col("d_before")).alias("docs_to"),
        (F.sum("tokens").over(to) + F.col("t_before")).alias("tokens_to"))
    longer = F.col("docs_from") - F.col("n_docs")
    return summed.withColumn("kept_tokens", F.col("tokens_to") + longer * F.col("n_tokens"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_fit, docs_cut, kept_tokens, lost_tokens) for any limits, also between lengths."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    total = sums.agg(F.max("tokens_to").alias("all_tokens"), F.max("docs_to").alias("all_docs"))
    best = asked.join(sums, sums.n_tokens <= asked.context, "left").groupBy("context").agg(
        F.coalesce(F.max("docs_to"), F.lit(0)).alias("docs_fit"),
        F.coalesce(F.max("tokens_to"), F.lit(0)).alias("fit_tokens"))
    cut = F.coalesce(F.col("all_docs"), F.lit(0)) - F.col("docs_fit")
    kept = F.col("fit_tokens") + cut * F.col("context")
    return best.join(total).select(
        "context", "docs_fit", cut.alias("docs_cut"), kept.alias("kept_tokens"),
        (F.coalesce(F.col("all_tokens"), F.lit(0)) - kept).alias("lost_tokens"))


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """(probability, n_tokens): the smallest length that at least that share of documents keeps to."""
    asked = sums.sparkSession.createDataFrame([(float(p),) for p in probabilities], "probability double")
    total = sums.agg(F.max("docs_to").alias("all_docs"))
    need = F.greatest(F.lit(1), F.ceil(F.col("probability") * F.col("all_docs")))
    return asked.join(total).join(sums, F.col("docs_to") >= need, "left").groupBy(
        "probability").agg(F.min("n_tokens").alias("n_tokens"))
