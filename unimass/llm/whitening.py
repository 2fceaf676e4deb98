"""Whitening of embeddings over distributed block matrices.

Rows are numbered, centred and indexed into the blocks of a BlockMatrix. The transposed matrix times
itself is the scatter; its eigenvectors are found in the driver, as they are width x width numbers;
the block matrix times the whitening matrix projects all rows. The driver holds the keys of the
blocks of one panel at a time, so that they are bounded as well: more rows are more panels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unimass.session import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
WIDEST = 2.0 ** 61  # entries are cut to this size, so that they and their differences are longs
BLOCK_NUMBERS, BLOCK_WIDTH = 1 << 20, 1024  # numbers in a block (8 MB); columns of a block
TASK_BLOCKS, PANEL_BLOCKS = 8, 1 << 14  # blocks that one task multiplies; blocks of a panel
IN_PART = (1 << 33) - 1  # the bits of a generated id that count within a part

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): x = floor(64 c) + 1000000 of every entry c as a double.

    Vectors that are null or empty, or hold null or non-finite entries, are left out.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.select("vec_id", "embedding").where(
        F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    cut = lambda c: F.greatest(F.least(SCALE * c.cast("double"), F.lit(WIDEST)), F.lit(-WIDEST))
    return whole.select("vec_id", F.transform("embedding", lambda c: F.floor(cut(c)) + F.lit(SHIFT)).alias("x"))


def indexed(rows: DataFrame) -> DataFrame:
    """rows, written once, with index: 0, 1, 2 and so on without gaps, in no particular order."""
    kept = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    part = F.shiftrightunsigned("place", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row for each task
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    starts = sizes.select("part", before.alias("start"))
    return kept.withColumn("part", part).join(starts, "part").withColumn(
        "index", F.col("start") + F.col("place").bitwiseAND(F.lit(IN_PART))).drop("part", "start", "place")


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(rows: DataFrame, width: int) -> list[int]:
    """The sum of each entry of x over all rows, exact at any size."""

    def run(batches):
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = matrix_of(batch.column("x"), width)
            high += (x >> 31).sum(0)
            low += (x & ((1 << 31) - 1)).sum(0)
        yield pa.RecordBatch.from_pydict({"d": pa.array(np.arange(width), pa.int32()), "high": high, "low": low})

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = rows.select("x").mapInArrow(run, "d int, high long, low long").groupBy("d").agg(total("high"), total("low"))
    out = [0] * width
    for r in found.collect():  # width rows
        out[r["d"]] = (int(r["high"]) << 31) + int(r["low"])
    return out


def deviations(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(index, vec_id, deviation): the sum of (n x - S)^2 over entries; null beyond 64 bits."""

    def run(batches):
        for batch in batches:
            x = matrix_of(batch.column("x"), len(sums))
            near = n * x.astype(float) - np.array(sums, float)
            fits = max(np.square(near).sum(1).max(initial=0), np.abs(n * x.astype(float)).max(initial=0)) < 2.0 ** 61
            if fits and max(map(abs, sums)) < 1 << 61:
                out = np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
            else:  # whole numbers of any size
                out = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
                out = [v if v < 1 << 63 else None for v in out]
            yield pa.RecordBatch.from_pydict({"index": batch.column("index"), "vec_id": batch.column("vec_id"),
                                              "deviation": pa.array(out, pa.int64())})

    return rows.select("index", "vec_id", "x").mapInArrow(run, "index long, vec_id long, deviation long")


def centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(index, vector): x - S / n. Whole parts are subtracted as longs, so that no digit is lost."""
    whole = F.array(*[F.lit(s // n).cast("long") for s in sums])
    rest = F.array(*[F.lit((s % n) / n) for s in sums])
    less = F.zip_with("x", whole, lambda x, q: (x - q).cast("double"))
    return rows.select("index", array_to_vector(F.zip_with(less, rest, lambda x, r: x - r)).alias("vector"))


def block_matrix(rows: DataFrame, n: int, width: int, block_numbers: int = BLOCK_NUMBERS) -> BlockMatrix:
    """(index, vector) as distributed blocks of at most `block_numbers` numbers."""
    columns = min(width, BLOCK_WIDTH)
    size = max(1, block_numbers // columns)
    tasks = -(-n // (size * TASK_BLOCKS))
    if tasks > rows.rdd.getNumPartitions():
        rows = rows.repartition(tasks)
    vectors = MLUtils.convertVectorColumnsFromML(rows, "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(size, columns)


def inner_product(left: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix: every task adds up a few blocks of rows."""
    model = left._java_matrix_wrapper._java_model
    tasks = -(-left.numRowBlocks // TASK_BLOCKS)
    product = left.transpose()._java_matrix_wrapper.call("multiply", model, max(1, tasks))
    return BlockMatrix(product, left.colsPerBlock, left.colsPerBlock).toLocalMatrix().toArray()


def as_blocks(spark, values: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A small matrix as blocks of whole rows."""
    blocks = [((i // rows_per_block, 0), Matrices.dense(len(part), values.shape[1], part.T.ravel().tolist()))
              for i in range(0, len(values), rows_per_block)
              for part in [values[i:i + rows_per_block]]]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), rows_per_block, values.shape[1],
                       len(values), values.shape[1])


def whitening_matrix(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, share of the variance, live) of the largest eigenvalues, in falling order.

    A direction without variance, to double precision, has a column of zeros and is not live.
    """
    cov = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(cov)
    k = min(components, len(values))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    live = values > len(cov) * np.finfo(float).eps * max(values[0], 0)
    scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1)), 0)
    trace = np.trace(cov)
    return vectors * scale, np.maximum(values, 0) / trace if trace > 0 else np.full(k, np.nan), live


def whiten(vectors: DataFrame, components: int = COMPONENTS, block_numbers: int = BLOCK_NUMBERS,
           panel_blocks: int = PANEL_BLOCKS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every whole vector.

    One row for each remaining row and component, counted from 1 by falling eigenvalue, at most
    `components` and the width. Vectors that are null or empty or hold null or non-finite entries
    are left out, as are those not of the commonest width (of equally common ones the greater).
    Null ids and repeated rows count like any other row; entries beyond 2^61 are cut to it. Equal
    eigenvalues have some orthogonal eigenvectors, the same for all rows. A direction without
    variance has whitened null, and without any variance explained and identity_error are null
    too; deviation is null beyond 64 bits. Other columns are ignored; no vectors give no rows.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors)
    width = whole.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if width is None:
        return spark.createDataFrame([], RESULT)
    width, n = width["width"], width["count"]
    rows = indexed(whole.where(F.size("x") == width))
    sums = exact_sums(rows, width)
    size = max(1, block_numbers // min(width, BLOCK_WIDTH)) * panel_blocks  # rows of a panel
    panels = []
    for start in range(0, n, size):
        own = rows.where((F.col("index") >= start) & (F.col("index") < start + size)).withColumn(
            "index", F.col("index") - start) if n > size else rows
        panels.append(block_matrix(centred(own, n, sums), min(size, n - start), width, block_numbers))
    matrix, explained, live = whitening_matrix(sum(map(inner_product, panels)), n, components)
    k = matrix.shape[1]
    whitener = as_blocks(spark, matrix, panels[0].colsPerBlock)
    projected = [p.multiply(whitener) for p in panels]
    cov = sum(map(inner_product, projected)) / n
    error = float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max()) if live.any() else None
    found = None
    for i, part in enumerate(projected):
        wide = callMLlibFunc("getIndexedRows", part.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        own = wide.select((F.col("index") + i * size).alias("index"), vector_to_array("vector").alias("values"))
        found = own if found is None else found.union(own)
    share = F.array(*[F.lit(float(v)) if v == v else F.lit(None).cast("double") for v in explained])
    alive = F.array(*[F.lit(bool(v)) for v in live])
    at = F.col("place")
    long = deviations(rows, n, sums).join(found, "index").select(
        "vec_id", "deviation", F.posexplode("values").alias("place", "value"))
    return long.select(
        "vec_id", (at + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(alive[at], F.col("value")).alias("whitened"), share[at].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
