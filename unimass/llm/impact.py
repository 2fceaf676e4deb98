"""Exact top-k by inner product over impact-ordered postings, processed score at a time.

Vectors are dealt to shards; in a shard each component position has a posting list, cut into
segments by quantised impact (the power of two of the component's size). Segments are processed
from the highest impact down, for a block of queries at once. What is left can change a score by
less than the segment bound times the query's weights at unseen positions, so that a vector whose
upper bound is below the k-th lower bound is out by proof; all others are scored exactly.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
SHARD_ROWS, GROUP_QUERIES, BLOCK_QUERIES = 4096, 8192, 128
LARGEST_SUM = 1 << 52  # doubles add up products exactly below this
ROUNDING = 2.0 ** -45  # more than the relative error of a sum of products in doubles
LARGEST_SCORE = (1 << 63) - 1
TRUSTED = 0.45  # bounds are worth computing once at most this share of the components is unseen


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without null ids, null vectors and vectors with a null or non-finite part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(scale * x) as whole numbers; shorter vectors end in zeros.

    64-bit numbers where sums of their products are exact in doubles, numbers of any size otherwise.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.list_value_length(column), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if np.abs(flat).max(initial=0) < 1 << 24:
        out = np.zeros((len(column), width))
        out[row, place] = np.floor(SCALE * flat)
        if np.square(out).sum(1).max(initial=0) < LARGEST_SUM:
            return out.astype(np.int64)
    out = np.zeros((len(column), width), object)
    # beyond 2^53 a double is a whole number
    out[row, place] = [SCALE * int(x) if abs(x) > 1 << 53 else math.floor(SCALE * x) for x in flat.tolist()]
    return out


def as_floats(rows: np.ndarray) -> np.ndarray:
    """The numbers as doubles, very large ones all divided by the same power of two."""
    if rows.dtype != object:
        return rows.astype(float)
    shift = max(0, max((abs(v).bit_length() for v in rows.ravel()), default=0) - 300)
    return np.array([float(v >> shift) for v in rows.ravel()]).reshape(rows.shape)


def segments(rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bound, values, unseen) by descending impact.

    A segment holds the components of one quantised impact, as a matrix with zeros elsewhere, so
    that a block of queries takes a whole segment in one product. Components that are in neither
    this nor an earlier segment are smaller than the bound in size; `unseen` marks them.
    """
    level = np.frexp(np.abs(rows))[1]  # 0 for 0, else 2^(level-1) <= size < 2^level
    return [(1 << (impact - 1), np.where(level == impact, rows, 0).astype(float),
             (level < impact).astype(float))
            for impact in range(int(level.max(initial=0)), 0, -1)]


def search(rows: np.ndarray, ids: np.ndarray, index, queries: np.ndarray, query_ids: np.ndarray,
           k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, scores) of each query's k best rows other than its own id, ties to smaller ids.

    Sums of 64-bit numbers stay below 2^53 in size (see LARGEST_SUM), so that doubles hold them
    exactly. With larger numbers every bound is wider by what rounding may add up to, and the
    scores of all possible members are whole numbers of any size.
    """
    near, asked = as_floats(rows), as_floats(queries)
    exact = rows.dtype != object and queries.dtype != object
    largest = np.abs(near).max(0, initial=0)
    found: list = [None] * len(queries)
    n = len(rows)
    for start in range(0, len(queries), BLOCK_QUERIES):
        live = np.arange(start, min(start + BLOCK_QUERIES, len(queries)))
        own = query_ids[live][:, None] == ids[None, :]
        partial = np.where(own, -np.inf, 0.0)
        floor = np.full(len(live), -np.inf)  # at most the k-th best score
        for step, (bound, values, unseen) in enumerate([*index, (1, None, None)]):
            last = step == len(index)
            weights = asked[live]
            unsure = 0.0 if exact else ROUNDING * (np.abs(weights) @ largest)
            if not last:
                partial += weights @ values.T
                if unseen.mean() > TRUSTED:
                    continue
                slack = np.abs(weights) @ unseen.T * float(bound - exact)
            else:
                slack = 0.0
            fresh = np.flatnonzero(floor == -np.inf)
            if len(fresh) and n > k:
                lead = np.argpartition(partial[fresh], n - k - 1, axis=1)[:, -k - 1:]
                best = np.einsum("qcd,qd->qc", near[lead], weights[fresh])
                best[own[fresh[:, None], lead]] = -np.inf
                floor[fresh] = -np.sort(-best, axis=1)[:, k - 1]
            possible = (partial + slack >= (floor - 2 * unsure)[:, None]) & ~own
            proven = last | (possible.sum(1) <= max(4 * k, n // 64))
            for j in np.flatnonzero(proven):
                at = np.flatnonzero(possible[j])
                if exact:
                    scores = rows[at] @ queries[live[j]]
                    best = np.lexsort((ids[at], -scores))[:k]
                    found[live[j]] = (at[best], scores[best])
                    continue
                scores = [sum(map(operator.mul, rows[i].tolist(), queries[live[j]].tolist())) for i in at]
                best = sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]]))[:k]
                cut = [max(-LARGEST_SCORE - 1, min(LARGEST_SCORE, scores[i])) for i in best]
                found[live[j]] = (at[best], np.array(cut, np.int64))
            if proven.all():
                break
            live, partial, own, floor = live[~proven], partial[~proven], own[~proven], floor[~proven]
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS,
          group_queries: int = GROUP_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of highest inner product for each query.

    Components are scaled to whole numbers first. Rows under the query's own id are no candidates;
    ties go to the smaller vec_id; a repeated query row is answered once, and vectors that are null
    or hold null or non-finite parts take no part on either side. Components may be of any size; a
    score beyond 64 bits is ranked by its value in a shard and cut to the largest or smallest
    number. Every pair of a shard of vectors
    and a group of queries is one task's work of bounded size.
    """
    spark = vectors.sparkSession
    rows, asked = whole_vectors(vectors), whole_vectors(queries).distinct()
    n_rows, n_asked = rows.count(), asked.count()
    shards, groups = max(1, -(-n_rows // shard_rows)), max(1, -(-n_asked // group_queries))
    rows = rows.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "vec_id", "embedding")
    asked = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"),
        F.pmod(F.hash("vec_id"), F.lit(groups)).alias("part"),
        F.xxhash64("vec_id", "embedding").alias("query"),
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max(pc.max(pc.list_value_length(side)).as_py() or 0
                    for side in (left["embedding"], right["asked"]))
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            own, ids = scaled(left["embedding"], width), left["vec_id"].to_numpy()
            names, keys = right["query_id"].to_numpy(), right["query"].to_numpy()
            for i, (at, scores) in enumerate(search(
                    own, ids, segments(as_floats(own)), scaled(right["asked"], width), names, k)):
                out["query"].append(np.full(len(at), keys[i]))
                out["query_id"].append(np.full(len(at), names[i]))
                out["vec_id"].append(ids[at])
                out["score"].append(scores)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
                         for c, v in out.items()})

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = [d.repartition(tasks, "shard", "part").groupBy("shard", "part") for d in (rows, asked)]
    found = parts[0].cogroup(parts[1]).applyInArrow(run, "query long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
