"""Non-negative factorisation of unit activations, of many groups of units in the same passes.

A group is a subject, layer and unit type; its activations are cut into blocks of images that are
written once. A pass joins the basis of its group to each block, finds the block's weights by
non-negative least squares and adds up what the next basis needs: W'W and W'A, whose size does not
depend on the images. The basis then moves by hierarchical alternating updates, a column at a time.
A round's bases are a written table, so that a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unimass.session import join_on, materialize, spread

BLOCK, IMAGES = 1 << 20, 1024  # most numbers and images, about, in a block: the work of one image grows with k * k
SWEEPS, TOL = 5, 1e-4  # updates of a basis per round; least gain of a round, of the mean square


def numbered(acts: DataFrame, keys, value: str) -> DataFrame:
    """(gid, keys, n, p, power): the groups, their images and units, and mean square. Groups are few."""
    found = acts.groupBy(*keys).agg(
        F.countDistinct("image_id").alias("n"), F.countDistinct("unit_id").alias("p"),
        F.sum(F.col(value).cast("double") ** 2).alias("power")).where("n > 0 AND p > 0").collect()
    kinds = dict(acts.dtypes)
    schema = ", ".join(["gid int", *[f"{k} {kinds[k]}" for k in keys], "n long", "p long", "power double"])
    rows = sorted(found, key=lambda r: tuple((r[k] is None, r[k]) for k in keys))
    return acts.sparkSession.createDataFrame([(g, *tuple(r)) for g, r in enumerate(rows)], schema)


def image_blocks(acts: DataFrame, units: DataFrame, groups: DataFrame, keys, value: str) -> DataFrame:
    """(gid, images, a): whole images of a group as the rows of a matrix over its units, written once.

    `units` is (gid, unit_id, pos); what an image does not name is 0, and repeated cells add up.
    """
    kind = dict(acts.dtypes)["image_id"]
    images = F.greatest(F.least(F.floor(F.lit(BLOCK) / F.col("p")), F.lit(IMAGES)), F.lit(1))
    parts = F.greatest(F.ceil(F.col("n") / images), F.lit(1))
    sized = groups.select("gid", *keys, "p", parts.alias("parts"))
    named = join_on(acts.select(*keys, "image_id", "unit_id", F.col(value).cast("double").alias("v")), sized, keys)
    cells = named.join(units, ["gid", "unit_id"]).groupBy("gid", "image_id").agg(
        F.first("p").alias("p"), F.first("parts").alias("parts"), F.collect_list(F.struct("pos", "v")).alias("cells"))
    dealt, = spread(["gid", "part"], cells.withColumn("part", F.pmod(F.xxhash64("image_id"), F.col("parts"))))
    packed = dealt.groupBy("gid", "part").agg(
        F.first("p").alias("p"), F.collect_list("image_id").alias("images"), F.collect_list("cells").alias("cells"))

    def dense(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                cells = row.column("cells").flatten()
                a = np.zeros((len(cells), row.column("p")[0].as_py()), np.float64)
                at = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
                flat = cells.flatten()
                np.add.at(a, (at, flat.field("pos").to_numpy()), flat.field("v").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([row.column("gid"), row.column("images"), pa.array(
                    [a.astype(np.float32).tobytes()])], names=["gid", "images", "a"])

    return materialize(packed.mapInArrow(dense, f"gid int, images array<{kind}>, a binary"), "blocks")


def each_block(batches):
    """(gid, image column, matrix, basis) of the joined blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            k = row.column("k")[0].as_py()
            h = np.frombuffer(row.column("h")[0].as_buffer()).reshape(-1, k)
            a = np.frombuffer(row.column("a")[0].as_buffer(), np.float32).reshape(-1, len(h)).astype(float)
            yield row.column("gid")[0].as_py(), row.column("images").flatten(), a, h


def weights_on(a: np.ndarray, h: np.ndarray, sweeps: int, tol: float) -> np.ndarray:
    """Non-negative weights of the rows of a on the columns of h, by cyclic coordinate descent.

    As ridge.nn_ridge() without a penalty, but a slope is computed when its weight is due: one
    product of a row in place of an update of all slopes. Stops when no weight moves by more than
    tol * max(1, |w|).
    """
    gram, cross = h.T @ h, np.ascontiguousarray((a @ h).T)
    w = np.zeros_like(cross)
    for _ in range(sweeps if cross.size else 0):
        moved = 0.0
        for j in np.flatnonzero(np.diag(gram) > 0):
            step = np.maximum((cross[j] - gram[j] @ w) / gram[j, j], -w[j])
            w[j] += step
            moved = max(moved, float(np.abs(step).max()))
        if moved <= tol * max(1.0, float(w.max())):
            break
    return w.T


def round_sums(blocks: DataFrame, bases: DataFrame) -> DataFrame:
    """(gid, pos, v): W'A by unit, W'W in places below 0, and the squared error in the place below those."""

    def run(batches):
        held: dict = {}
        for gid, _, a, h in each_block(batches):
            w = weights_on(a, h, 50, 1e-4)
            k = h.shape[1]
            error = np.zeros(k)
            error[0] = np.square(a - w @ h.T).sum()
            own = np.concatenate([a.T @ w, w.T @ w, error[None]])
            held[gid] = held[gid] + own if gid in held else own
        for gid, total in held.items():
            k = total.shape[1]
            pos = np.concatenate([np.arange(len(total) - k - 1), -1 - np.arange(k + 1)])
            yield pa.RecordBatch.from_pydict({
                "gid": pa.array([gid] * len(total), pa.int32()), "pos": pa.array(pos, pa.int32()),
                "v": pa.array(list(total), pa.list_(pa.float64()))})

    return blocks.join(bases, "gid").mapInArrow(run, "gid int, pos int, v array<double>").groupBy("gid", "pos").agg(
        vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def moved(sums: DataFrame, bases: DataFrame) -> DataFrame:
    """The next bases, each column in turn, and the squared error of the last ones."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame(columns=["gid", "k", "h", "error"])
        k = int(right["k"].iloc[0])
        h = np.frombuffer(right["h"].iloc[0]).reshape(-1, k).copy()
        values = np.stack(left.sort_values("pos")["v"])
        error, gram, b = values[0, 0], values[1:k + 1][::-1], values[k + 1:]
        for _ in range(SWEEPS):
            for j in range(k):
                if gram[j, j] > 0:
                    h[:, j] = np.maximum(0, h[:, j] + (b[:, j] - h @ gram[:, j]) / gram[j, j])
        size = np.linalg.norm(h, axis=0)
        h /= np.where(size > 0, size, 1)
        return pd.DataFrame({"gid": right["gid"].iloc[:1], "k": k, "h": [h.tobytes()], "error": error})

    return sums.groupBy("gid").cogroup(bases.groupBy("gid")).applyInPandas(
        run, "gid int, k int, h binary, error double")


def nmf_fit(acts: DataFrame, k: int = 100, max_iter: int = 50, seed: int = 0, value="act", keys=(),
            tol: float = TOL) -> DataFrame:
    """(keys, unit_id, h): a basis for each value of the keys, all fitted in the same rounds.

    k is cut to the number of images and units of a group. Rounds end when no group gains more than
    tol of its sum of squares, at max_iter at the latest. No units give no rows; negative
    activations are fitted as well as non-negative weights can.
    """
    keys = list(keys)
    groups = materialize(numbered(acts, keys, value), "groups")
    known = join_on(acts.select(*keys, "unit_id").distinct(), groups.select("gid", *keys), keys)
    # as many rows as a basis has
    place = (F.row_number().over(Window.partitionBy("gid").orderBy("unit_id")) - 1).alias("pos")
    units = materialize(known.select("gid", "unit_id", place), "units")
    blocks = image_blocks(acts, units, groups, keys, value)

    def start(batches):
        for pdf in batches:
            drawn = [np.abs(np.random.default_rng([seed, g]).standard_normal((p, min(k, n, p)))).tobytes()
                     for g, n, p in zip(pdf["gid"], pdf["n"], pdf["p"])]
            yield pd.DataFrame({"gid": pdf["gid"], "k": np.minimum(k, np.minimum(pdf["n"], pdf["p"])), "h": drawn})

    bases = materialize(groups.select("gid", "n", "p").mapInPandas(start, "gid int, k int, h binary"), "bases")
    power = {r["gid"]: r["power"] or 0.0 for r in groups.select("gid", "power").collect()}
    last = {g: np.inf for g in power}
    for _ in range(max_iter if power else 0):
        state = materialize(moved(round_sums(blocks, bases), bases), "bases")
        error = {r["gid"]: r["error"] for r in state.select("gid", "error").collect()}
        bases = state.select("gid", "k", "h")
        if all(last[g] - e <= tol * power[g] for g, e in error.items()):
            break
        last = error

    def rows_of(batches):
        for pdf in batches:
            for g, width, h in zip(pdf["gid"], pdf["k"], pdf["h"]):
                rows = np.frombuffer(h).reshape(-1, width)
                yield pd.DataFrame({"gid": g, "pos": np.arange(len(rows)), "h": list(rows)})

    long = bases.mapInPandas(rows_of, "gid int, pos int, h array<double>")
    return long.join(units, ["gid", "pos"]).join(groups.select("gid", *keys), "gid").select(*keys, "unit_id", "h")


def nmf_transform(acts: DataFrame, basis: DataFrame, value="act", keys=()) -> DataFrame:
    """(keys, image_id, x): non-negative weights of every image on the basis of its group.

    Units that the basis does not have are left out; without any basis the weights are empty.
    """
    keys = list(keys)
    kind = dict(acts.dtypes)["image_id"]
    if basis.isEmpty():
        return acts.select(*keys, "image_id").distinct().withColumn("x", F.array().cast("array<double>"))
    their = join_on(acts, basis.select(*keys, "unit_id"), [*keys, "unit_id"])
    groups = materialize(numbered(their, keys, value).drop("p"), "groups")
    known = join_on(basis, groups.select("gid", *keys), keys)
    place = (F.row_number().over(Window.partitionBy("gid").orderBy("unit_id")) - 1).alias("pos")
    units = materialize(known.select("gid", "unit_id", place, "h"), "units")

    def blob(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.stack(pdf.sort_values("pos")["h"]).astype(float)
        return pd.DataFrame({"gid": pdf["gid"].iloc[:1], "k": h.shape[1], "p": len(h), "h": [h.tobytes()]})

    bases = materialize(units.groupBy("gid").applyInPandas(blob, "gid int, k int, p long, h binary"), "bases")
    sized = groups.join(bases.select("gid", "p"), "gid")
    blocks = image_blocks(their, units.select("gid", "unit_id", "pos"), sized, keys, value)

    def solve(batches):
        for gid, images, a, h in each_block(batches):
            w = weights_on(a, h, 500, 1e-7)
            yield pa.RecordBatch.from_pydict({
                "gid": pa.array([gid] * len(w), pa.int32()), "image_id": images,
                "x": pa.array(list(w), pa.list_(pa.float64()))})

    found = blocks.join(bases, "gid").mapInArrow(solve, f"gid int, image_id {kind}, x array<double>")
    return found.join(groups.select("gid", *keys), "gid").select(*keys, "image_id", "x")


def reconstruction_error(acts: DataFrame, weights: DataFrame, basis: DataFrame, value="act", keys=()) -> DataFrame:
    """(keys, mse, power): mean squared error of the product of weights and basis, and mean square."""
    keys = list(keys)
    fit = F.aggregate(F.zip_with("x", "h", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    both = join_on(join_on(acts, weights, [*keys, "image_id"]), basis, [*keys, "unit_id"])
    return both.groupBy(*keys).agg(F.avg((F.col(value) - fit) ** 2).alias("mse"), F.avg(F.col(value) ** 2).alias("power"))


# Block letter of each unit type.
TYPE_BLOCK = {"face": "f", "body": "b", "mixed": "m", "nonselective": "ns"}


def typed_acts(acts: DataFrame, cohort: DataFrame, keys=()) -> DataFrame:
    """acts of the cohort's units with their block; a unit of two types is in both, negatives are 0."""
    shared = [k for k in [*keys, "unit_id"] if k in cohort.columns]
    letter = F.create_map(*[F.lit(v) for pair in TYPE_BLOCK.items() for v in pair])
    own = cohort.where(F.col("sel_type").isin(list(TYPE_BLOCK))).select(
        *shared, letter[F.col("sel_type")].alias("block")).distinct()
    return join_on(acts, own, shared).withColumn("act", F.greatest(F.col("act").cast("double"), F.lit(0.0)))


def predictor_blocks(acts: DataFrame, cohort: DataFrame, k: int = 100, seed: int = 0,
                     max_iter: int = 50, keys=()) -> DataFrame:
    """(keys, image_id, block, x): each type's units reduced to k weights, for all keys and types at once.

    `keys` are those of acts, such as subject and layer; the cohort has those that it differs by.
    """
    typed = materialize(typed_acts(acts, cohort, keys), "typed")
    by = [*keys, "block"]
    basis = materialize(nmf_fit(typed, k, max_iter, seed, keys=by), "basis")
    return nmf_transform(typed, basis, keys=by).select(*keys, "image_id", "block", "x")
