"""From raw documents to packed training windows.

Each stage takes the rows that the one before kept and returns the columns of documents, but for
the last, which returns the pieces of the windows. `run` writes every stage as Parquet in the
shared folder and reads it again, so that a lost executor never goes back beyond a stage; what a
stage wrote on its way, and the stage before it, are deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unimass.llm import langid, latent, packing, pii, simhash
from unimass.session import delete_path, scratch, stage_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter have no language and go."""
    return langid.in_a_language(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of exact and near copies the document of the smallest id stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return latent.without_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind; n_chars follows the new text; no document goes."""
    return pii.masked(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language), ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination), ("PII", personal_data), ("packing", packed),
]

ORACLE_SQL = None  # classifiers, fingerprints and token ids are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        path = stage_path(spark, "stage-" + name.lower().replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete_path(spark, last)
        last = path
    return docs
