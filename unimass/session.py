"""Session helpers: a tuned local session and tables written to the shared stage folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROW_GROUP = 16 << 20  # bytes of a row group of `large_rows`
_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}
_scratch: list[str] = []


def local_session(cores: str = "*", app: str = "unimass", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """The application's folder for intermediate tables, within the one the cluster names."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    app = spark.sparkContext.applicationId
    if root:
        return f"{root.rstrip('/')}/{app}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    if app not in _local_dirs:
        # removed when the process ends
        _local_dirs[app] = tempfile.TemporaryDirectory(
            prefix="unimass-stage-", ignore_cleanup_errors=True)
    return _local_dirs[app].name


def stage_path(spark: SparkSession, label: str) -> str:
    """A new folder for an intermediate table."""
    root = _scratch[-1] if _scratch else stage_root(spark)
    return f"{root}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables written inside are deleted at its end, also after a failure.

    What is to stay is written within it to a path named before.
    """
    path = stage_path(spark, "scratch")
    _scratch.append(path)
    try:
        yield
    finally:
        _scratch.remove(path)
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table's folder; nothing that reads it may be used afterwards."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; nothing that reads them may be used afterwards."""
    delete_path(spark, stage_root(spark))


def large_rows(rows: int = 1) -> dict[str, str]:
    """Options of a written table whose rows may hold megabytes: row groups of about ROW_GROUP bytes.

    Left alone, Parquet looks at what it holds every 100 rows at most, and a whole file of such rows
    is one page, which writer and reader hold several times over. Here it looks every `rows` rows.
    """
    return {"parquet.block.size": str(ROW_GROUP), "parquet.page.size.row.check.min": str(rows),
            "parquet.page.size.row.check.max": str(rows)}


def materialize(df: DataFrame, label: str = "stage", options: dict[str, str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back.

    The result has no lineage to recompute, is the same for every branch that reads it, and
    has a known size, so that joins with it are broadcast only when it is really small.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on keys that may be null: nulls meet nulls. Without keys, right must be a single row."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(right)
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") if k in keys else F.col(k)
                             for k in right.columns])
    same = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def spread(keys, *inputs: DataFrame):
    """Inputs of grouped Python work, hashed by key over all cores.

    Adaptive execution folds small partitions into one task by their bytes, but fits and draws
    are much work per byte: the number of partitions is therefore named, that of the session's
    shuffles and at least one per core.
    """
    spark = inputs[0].sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tuple(d.repartition(n, *keys) for d in inputs)
