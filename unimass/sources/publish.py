"""Partitioned tables that change in one step: staged versions and a manifest that names the live ones.

<path>/data/version=<id>/<column>=<value>/... holds what one write brought, and <path>/manifests/<number>
lists the version of every live partition. A write stages its rows, then adds the next manifest by a
rename that fails if another writer was first. Readers follow the last manifest: until the rename
they read the old table whole, after it the new one whole.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from unimass.session import delete_path

VERSION = "version"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> tuple[int, StructType | None, dict[tuple, str]]:
    """Number, schema and partitions (values as text to version) of the last manifest."""
    where, fs = _folder(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    numbers = sorted(int(n) for n in names if n.isdigit())
    if not numbers:
        return 0, None, {}
    rows = spark.read.text(f"{path}/manifests/{numbers[-1]:010d}").collect()  # a row for each partition
    found = [json.loads(r["value"]) for r in rows if r["value"]]
    schema = next(f for f in found if isinstance(f, dict))
    return numbers[-1], StructType.fromJson(schema), {tuple(f[0]): f[1] for f in found if isinstance(f, list)}


def switch(spark: SparkSession, path: str, number: int, schema: StructType, live: dict[tuple, str]) -> None:
    """Add manifest `number`; raises if there is one already, and then changes nothing."""
    jvm = spark._jvm
    staged, fs = _folder(spark, f"{path}/manifests/_staged-{uuid.uuid4().hex}")
    out = fs.create(staged)
    lines = [json.dumps(schema.jsonValue()), *[json.dumps([list(k), v]) for k, v in sorted(live.items(), key=str)]]
    out.write("\n".join(lines).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{number:010d}"), options)


def _as_text(schema: StructType, columns) -> StructType:
    """The schema with partition columns as text, as their folders hold them."""
    rest = [f for f in schema.fields if f.name not in columns]
    return StructType([*rest, *[StructField(c, StringType()) for c in columns]])


def replace(rows: DataFrame, path: str, columns, gone=()) -> None:
    """Replace the partitions that rows hold, and drop those in `gone`, in one step.

    `columns` name a partition; all others stay as they are. A failure anywhere before the last
    step leaves the old table; what it staged is deleted by `vacuum`.
    """
    spark, columns = rows.sparkSession, list(columns)
    version = "v" + uuid.uuid4().hex
    number, _, live = manifest(spark, path)
    staged = f"{path}/data/{VERSION}={version}"
    rows.hint("rebalance", *columns).write.partitionBy(*columns).parquet(staged)
    written = spark.read.schema(_as_text(rows.schema, columns)).parquet(staged)
    held = {tuple(r) for r in written.select(*columns).distinct().collect()}  # as many as there are folders
    dropped = {tuple(None if v is None else str(v) for v in g) for g in gone}
    switch(spark, path, number + 1, rows.schema,
           {k: v for k, v in live.items() if k not in dropped} | dict.fromkeys(held, version))


def published(spark: SparkSession, path: str, columns) -> DataFrame:
    """The live rows of a table, in the columns of its last write; raises if there is none."""
    columns = list(columns)
    _, schema, live = manifest(spark, path)
    if schema is None:
        raise ValueError(f"nothing is published at {path}")
    text = _as_text(schema, columns).add(VERSION, StringType())
    named = [f"_{c}" for c in columns]
    listed = spark.createDataFrame([(*k, v) for k, v in live.items()],
                                   ", ".join(f"{n} string" for n in [*named, "_version"]))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*columns, VERSION], [*named, "_version"])])
    rows = spark.read.schema(text).parquet(f"{path}/data").join(listed, same, "left_semi")
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete versions that the last manifest does not name; no reader of an older one may be left."""
    _, _, live = manifest(spark, path)
    where, fs = _folder(spark, f"{path}/data")
    for status in fs.listStatus(where) if fs.exists(where) else []:
        if status.getPath().getName().removeprefix(f"{VERSION}=") not in live.values():
            delete_path(spark, status.getPath().toString())
