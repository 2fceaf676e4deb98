"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from unimass.session import stage_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame`; doubles are rounded to 6 places for comparison."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """Parquet tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def folder(t: Tables, name: str) -> str:
    """A new folder for what a query writes and reads back."""
    return f"{stage_root(t.spark)}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    is_real = lambda t: isinstance(t, (DoubleType, FloatType))
    return df.select(*[
        F.round(F.col(f"`{f.name}`").cast("double"), places).alias(f.name)
        if is_real(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def r6(expr: str) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"(round(({expr})::DOUBLE, 6) + 0.0)"
