"""Voxel neighbourhood graphs: edges, the component of the seeds, geodesic distances."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.operators.ordering import exact_percentile
from unimass.session import delete_path, join_on, materialize, stage_path

# Half of the 26 neighbour steps; the other half are their mirror images.
STEPS = [s for s in product((-1, 0, 1), repeat=3) if s > (0, 0, 0)]
TILE = 32


def neighbour_edges(voxels: DataFrame, keys=("subject", "hemi")) -> DataFrame:
    """Directed edges (keys, src, dst, w) between 26-neighbours, w = distance in mm.

    One equi-join on the grid position: each voxel names 13 positions ahead of it, and the
    pairs are mirrored.
    """
    keys = list(keys)
    ahead = F.explode(F.array(*[
        F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), (F.col("k") + c).alias("k"))
        for a, b, c in STEPS]))
    here = voxels.select(*keys, F.col("voxel_id").alias("src"), F.col("x").alias("x0"),
                         F.col("y").alias("y0"), F.col("z").alias("z0"), ahead.alias("n")).select(
        *keys, "src", "x0", "y0", "z0", "n.*")
    there = voxels.select(*keys, "i", "j", "k", F.col("voxel_id").alias("dst"), "x", "y", "z")
    w = F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2
               + (F.col("z") - F.col("z0")) ** 2)
    half = here.join(there, [*keys, "i", "j", "k"]).select(*keys, "src", "dst", w.alias("w"))
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(
        F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return half.select(*keys, "w", both.alias("e")).select(*keys, "e.src", "e.dst", "w")


def _tile():
    """Cube of TILE voxels a side: the unit of local work, at most TILE^3 voxels."""
    return F.concat_ws("_", *[F.floor(F.col(c) / TILE) for c in "ijk"])


BUCKETS = 32  # folders of the links; a round reads those of its active cubes


def _bucket(keys):
    return F.pmod(F.xxhash64(*keys, "tile"), F.lit(BUCKETS)).cast("int")


def tile_links(nodes: DataFrame, edges: DataFrame, keys) -> DataFrame:
    """Edges with the cubes of both ends, written once, in buckets of the first cube."""
    keys = list(keys)
    src = nodes.select(*keys, F.col("voxel_id").alias("src"), _tile().alias("tile"))
    dst = nodes.select(*keys, F.col("voxel_id").alias("dst"), _tile().alias("to_tile"))
    rows = edges.join(src, [*keys, "src"]).join(dst, [*keys, "dst"]).select(
        *keys, "tile", "to_tile", "src", "dst", "w", _bucket(keys).alias("bucket"))
    path = stage_path(nodes.sparkSession, "links")
    rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
    return nodes.sparkSession.read.schema(rows.schema).parquet(path)


def relax(state: DataFrame, links: DataFrame, keys, max_rounds: int = 10_000) -> DataFrame:
    """Least value + path weight over all paths into each node.

    `state` is (keys, tile, voxel_id, d), d missing where unknown. A round settles the cubes that
    got an offer over their border, one task per cube, and sends offers from the voxels that got
    better; rounds grow with the cubes a path crosses, not with its voxels. A round reads, shuffles
    and writes the active cubes alone: settled cubes stay in the table of the round that wrote them
    last, an index of one row for each cube says which. Each round is written down, so that a lost
    executor costs one round; tables that hold no cube's last values are deleted.
    """
    keys = list(keys)
    spark = state.sparkSession
    types = dict(state.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    cols = [*keys, "tile", "voxel_id", "d"]
    at = [*keys, "tile"]
    folder = stage_path(spark, "rounds")
    schema = f"{head}, tile string, voxel_id bigint, d double, round int, foreign boolean"

    def settle(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = left[~left["offered"].to_numpy(bool)]
        offers = left[left["offered"].to_numpy(bool)]
        if not len(held):
            return pd.DataFrame(columns=out_cols)
        ids = held["voxel_id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        before = held["d"].to_numpy(float, na_value=np.inf)[order]
        d = before.copy()
        if not len(offers):  # the first round: whatever is known is new
            before = np.full(len(ids), np.inf)
        np.minimum.at(d, np.searchsorted(ids, offers["voxel_id"]), offers["d"].to_numpy(float))
        inner = (right["tile"] == right["to_tile"]).to_numpy(bool)
        src = np.searchsorted(ids, right["src"])
        w = right["w"].to_numpy(float)
        a, b, wi = src[inner], np.searchsorted(ids, right["dst"][inner]), w[inner]
        while (d < before - 1e-9).any():
            last = d.copy()
            np.minimum.at(d, b, d[a] + wi)
            if not (d < last - 1e-9).any():
                break
        better = d < before - 1e-9
        if not better.any():
            return pd.DataFrame(columns=out_cols)
        own = pd.DataFrame({"voxel_id": ids, "d": np.where(np.isinf(d), np.nan, d), "tile": held["tile"].iloc[0],
                            "foreign": False})
        out = ~inner & better[src]
        offer = pd.DataFrame({"voxel_id": right["dst"][out], "d": (d[src] + w)[out],
                              "tile": right["to_tile"][out], "foreign": True}).groupby(
            ["tile", "voxel_id", "foreign"], as_index=False).min()
        found = pd.concat([own, offer]) if len(offer) else own
        for k in keys:
            found[k] = held[k].iloc[0]
        found["round"] = int(held["now"].iloc[0])
        return found[out_cols]

    out_cols = [*cols, "round", "foreign"]
    state.select(*cols, F.lit(0).alias("round"), F.lit(False).alias("foreign")).write.parquet(f"{folder}/0")
    table = lambda rounds: spark.read.schema(schema).parquet(*[f"{folder}/{r}" for r in rounds])
    alive = {0}
    index = materialize(table([0]).select(*at, "round").distinct(), "index")
    active = materialize(table([0]).where("d is not null").select(*at).distinct(), "active")
    offers = None
    for now in range(1, max_rounds + 1):
        wanted = join_on(index, active, at).select("round", _bucket(keys).alias("bucket")).distinct().collect()
        if not wanted:
            return _latest(table(sorted(alive)), index, at).select(*cols)
        rounds, buckets = sorted({r["round"] for r in wanted}), sorted({r["bucket"] for r in wanted})
        held = _latest(table(rounds), join_on(index, active, at), at).select(*cols, F.lit(False).alias("offered"))
        left = held if offers is None else held.unionByName(offers.select(*cols, F.lit(True).alias("offered")))
        work = join_on(links.where(F.col("bucket").isin(buckets)).drop("bucket"), active, at)
        moved = left.withColumn("now", F.lit(now)).groupBy(*at).cogroup(work.groupBy(*at)).applyInPandas(settle, schema)
        moved.write.parquet(f"{folder}/{now}")
        done = table([now])
        fresh = materialize(done.where("not foreign").select(*at, "round").distinct(), "fresh")
        index = materialize(join_on(index, fresh.select(*at), at, "left_anti").unionByName(fresh), "index")
        offers = done.where("foreign").groupBy(*at, "voxel_id").agg(F.min("d").alias("d"))
        active = materialize(offers.select(*at).distinct(), "active")
        alive.add(now)
        gone = alive - {r["round"] for r in index.select("round").distinct().collect()} - {now}
        for r in gone:
            delete_path(spark, f"{folder}/{r}")
        alive -= gone
    raise RuntimeError(f"values did not settle in {max_rounds} rounds")


def _latest(rows: DataFrame, index: DataFrame, at) -> DataFrame:
    """Rows of cubes as their last round wrote them."""
    return join_on(rows.where("not foreign"), index, [*at, "round"])


def _cube_parts(nodes: DataFrame, links: DataFrame, keys) -> DataFrame:
    """(keys, voxel_id, own): the smallest id that a node reaches within its cube, one task per cube."""
    at = [*keys, "tile"]
    cols = [*keys, "voxel_id", "own"]
    types = dict(nodes.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def label(held: pd.DataFrame, inner: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame(columns=cols)
        held = held.sort_values("voxel_id")
        ids = held["voxel_id"].to_numpy()
        a, b = np.searchsorted(ids, inner["src"]), np.searchsorted(ids, inner["dst"])
        own = np.arange(len(ids))
        while True:
            last = own.copy()
            low = np.minimum(own[a], own[b])
            for end in (a, b, last[a], last[b]):
                np.minimum.at(own, end, low)
            own = own[own]
            if (own == last).all():
                break
        return held.assign(own=ids[own])[cols]

    tiled = nodes.select(*keys, _tile().alias("tile"), "voxel_id")
    inner = links.where("tile = to_tile").drop("bucket")
    return tiled.groupBy(*at).cogroup(inner.groupBy(*at)).applyInPandas(
        label, f"{head}, voxel_id {types['voxel_id']}, own {types['voxel_id']}")


def _stars(links: DataFrame, keys, max_rounds: int = 100) -> DataFrame:
    """(keys, own, comp): smallest id of the component of every end of links (keys, u, v).

    A round links the larger neighbours of a node to its smallest one, then the smaller ones, so
    that rounds grow with the logarithm of the longest path.
    """
    links = links.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state, before = materialize(links.distinct(), "stars"), None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least("u", F.min("v")).alias("m"))
        larger = join_on(both.where("v > u"), low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        larger = materialize(larger.where("u <> v").distinct(), "larger")
        low = larger.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        smaller = join_on(larger, low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        state = materialize(smaller.where("u <> v").unionByName(low.withColumnRenamed("m", "v")).distinct(), "stars")
        now = state.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(*keys, F.col("u").alias("own"), F.col("v").alias("comp"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame, keys=("subject", "hemi")) -> DataFrame:
    """Smallest voxel id of each node's component.

    Cubes are reduced to their parts, one task per cube; only links between parts over the borders
    go on, in rounds that grow with the logarithm of the cubes a component crosses.
    """
    keys = list(keys)
    links = tile_links(nodes, edges.withColumn("w", F.lit(0.0)), keys)
    parts = materialize(_cube_parts(nodes, links, keys), "parts")
    end = lambda id_, part: parts.select(*keys, F.col("voxel_id").alias(id_), F.col("own").alias(part))
    border = join_on(join_on(links.where("tile <> to_tile"), end("src", "u"), [*keys, "src"]), end("dst", "v"), [*keys, "dst"])
    roots = _stars(border.select(*keys, "u", "v"), keys)
    return join_on(parts, roots, [*keys, "own"], "left").select(
        *keys, "voxel_id", F.coalesce("comp", "own").cast("bigint").alias("comp"))


def seed_component(nodes: DataFrame, edges: DataFrame, keys=("subject", "hemi")) -> DataFrame:
    """Nodes of the component that holds most seeds (the smaller id wins a tie).

    `nodes` is (keys, voxel_id, i, j, k, seed).
    """
    keys = list(keys)
    comp = components(nodes, edges, keys).join(
        nodes.select(*keys, "voxel_id", "i", "j", "k", "seed"), [*keys, "voxel_id"])
    counts = comp.groupBy(*keys, "comp").agg(F.count_if("seed").alias("_n"))
    best = counts.filter("_n > 0").groupBy(*keys).agg(
        F.max(F.struct(F.col("_n"), (-F.col("comp")).alias("_c"))).alias("_b")).select(
        *keys, (-F.col("_b._c")).alias("comp"))
    return comp.join(best, [*keys, "comp"]).select(*keys, "voxel_id", "i", "j", "k", "seed")


def geodesic_distance(nodes: DataFrame, edges: DataFrame, keys=("subject", "hemi")) -> DataFrame:
    """Shortest weighted distance d_mm from any seed; nodes out of reach are left out."""
    keys = list(keys)
    start = nodes.select(*keys, _tile().alias("tile"), "voxel_id", F.when(F.col("seed"), F.lit(0.0)).alias("d"))
    done = relax(start, tile_links(nodes, edges, keys), keys)
    return done.filter(F.col("d").isNotNull()).select(*keys, "voxel_id", F.col("d").alias("d_mm"))


def build_gradient(nodes: DataFrame, edges: DataFrame, keys=("subject", "hemi"),
                   pct: float = 99.0) -> DataFrame:
    """d_mm along the mask and d_norm = clip(d / its 99th percentile), per hemisphere.

    Voxels off the seeds' component have no distance and are left out.
    """
    keys = list(keys)
    edges = materialize(edges, "edges")
    main = materialize(seed_component(nodes, edges, keys), "main")
    # edges never leave a component, so that joining both ends to it drops the others
    d = geodesic_distance(main, edges, keys).withColumn("d_mm", F.col("d_mm").cast("float").cast("double"))
    scale = exact_percentile(d, keys, "d_mm", {"scale_mm": pct / 100})
    norm = F.least(F.greatest(F.try_divide("d_mm", "scale_mm"), F.lit(0.0)), F.lit(1.0))
    return d.join(scale, keys).withColumn("d_norm", norm)
