"""Non-negative ridge for every voxel, from sufficient statistics per cross-validation cell.

One pass over the responses sums X'X, X'Y, sums and squares per cell of the (outer, inner)
folds. Any training set is a sum of cells, and so is the error on a held-out set, so that the
fits never see rows again: a task holds one block of voxels, whatever the number of images.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.session import materialize, spread

EPS = 1e-10
BLOCKS = ("f", "b", "m", "ns")
# Fits and, per fit, the sub-models scored at its penalty: name -> blocks.
FITS = {
    "f": {"f": ("f",)},
    "b": {"b": ("b",)},
    "m": {"m": ("m",)},
    "ns": {"ns": ("ns",)},
    "fb": {"r2_fb": ("f", "b"), "r2_f": ("f",), "r2_b": ("b",)},
    "fbm": {"r2_fbm": ("f", "b", "m"), "r2_fb_in": ("f", "b")},
}


@dataclass(frozen=True)
class RidgeConfig:
    """Folds, penalties and limits of the solver."""

    k_outer: int = 10
    k_inner: int = 5
    alphas: tuple = tuple(float(10.0 ** e) for e in range(-2, 8))
    max_sweeps: int = 200
    tol: float = 1e-7
    tol_tune: float = 1e-5

    @property
    def penalties(self) -> np.ndarray:
        """Largest first: a tie then goes to the larger penalty."""
        return np.sort(np.asarray(self.alphas, float))[::-1]


def nn_ridge(gram, cross, alpha, start=None, max_sweeps=200, tol=1e-7) -> np.ndarray:
    """Minimise w'(gram + alpha I)w - 2 cross'w over w >= 0, one problem per column.

    Cyclic coordinate descent; stops when no weight moves by more than tol * max(1, |w|).
    """
    p, m = cross.shape
    w = np.zeros((p, m)) if start is None else start.copy()
    if p == 0:
        return w
    alpha = np.broadcast_to(np.asarray(alpha, float), (m,))
    slope = cross - gram @ w - alpha * w  # half the negative gradient
    curve = np.diag(gram)[:, None] + alpha
    curve = np.where(curve > 0, curve, np.inf)  # a constant column at alpha 0 keeps weight 0
    for _ in range(max_sweeps):
        moved = 0.0
        for j in range(p):
            step = np.maximum(slope[j] / curve[j], -w[j])
            if not step.any():
                continue
            w[j] += step
            slope -= gram[:, j, None] * step
            slope[j] -= alpha * step
            moved = max(moved, float(np.abs(step).max()))
        if moved <= tol * max(1.0, float(w.max())):
            break
    return w


class Cells:
    """Sufficient statistics of all cells for one block of voxels."""

    def __init__(self, g, c, sx, sy, syy, n):
        self.g, self.c, self.sx, self.sy, self.syy, self.n = g, c, sx, sy, syy, n

    def pick(self, cells, cols) -> "Cells":
        """Sum over cells, restricted to predictor columns."""
        add = lambda a: a[cells].sum(0)
        return Cells(add(self.g)[np.ix_(cols, cols)], add(self.c)[cols], add(self.sx)[cols],
                     add(self.sy), add(self.syy), float(self.n[cells].sum()))

    def about(self, xm, ym):
        """Products and squares about given means."""
        g = self.g - np.outer(xm, self.sx) - np.outer(self.sx, xm) + self.n * np.outer(xm, xm)
        c = (self.c - np.outer(xm, self.sy) - np.outer(self.sx, ym) + self.n * np.outer(xm, ym))
        yy = self.syy - 2 * ym * self.sy + self.n * ym * ym
        return g, c, yy


def standardised(train: Cells):
    """Centred products over the training sd (population), with what prediction needs."""
    n = max(train.n, 1.0)
    xm, ym = train.sx / n, train.sy / n
    g, c, _ = train.about(xm, ym)
    s = np.sqrt(np.maximum(np.diag(g), 0.0) / n)
    s = np.where(s < EPS, 1.0, s)
    return g / np.outer(s, s), c / s[:, None], s, xm, ym


def held_out_error(test: Cells, w, s, xm, ym) -> np.ndarray:
    """Residual sum of squares on held-out cells, from their sums alone.

    w may hold several columns per voxel (one block of columns per penalty).
    """
    g, c, yy = test.about(xm, ym)
    times = w.shape[1] // len(yy)
    c, yy = np.tile(c / s[:, None], times), np.tile(yy, times)
    return np.maximum(yy - 2 * (w * c).sum(0) + (w * ((g / np.outer(s, s)) @ w)).sum(0), 0.0)


def _columns(blocks, widths):
    ends = np.cumsum(widths)
    spans = {b: range(e - w, e) for b, w, e in zip(BLOCKS, widths, ends)}
    return np.array([i for b in blocks for i in spans[b]], int)


def _total(cells: Cells) -> np.ndarray:
    """Sum of squares about the mean over all rows."""
    n = max(float(cells.n.sum()), 1.0)
    return np.maximum(cells.syy.sum(0) - cells.sy.sum(0) ** 2 / n, EPS)


def nested_fit(cells: Cells, cfg: RidgeConfig, models: dict, widths):
    """Out-of-fold R2 of each sub-model at penalties tuned by the inner folds; median penalty."""
    names = list(models)
    full = _columns(models[names[0]], widths)
    ids = np.arange(cfg.k_outer * cfg.k_inner).reshape(cfg.k_outer, cfg.k_inner)
    n_vox, grid = cells.syy.shape[1], cfg.penalties
    column_alpha = np.repeat(grid, n_vox)
    errors = {k: np.zeros(n_vox) for k in names}
    chosen = np.zeros((cfg.k_outer, n_vox))
    warm = None
    for o in range(cfg.k_outer):
        others = np.delete(ids, o, axis=0)
        pooled = np.zeros((len(grid), n_vox))
        for i in range(cfg.k_inner):
            g, c, s, xm, ym = standardised(cells.pick(np.delete(others, i, axis=1).ravel(), full))
            warm = nn_ridge(g, np.tile(c, len(grid)), column_alpha, warm, cfg.max_sweeps, cfg.tol_tune)
            pooled += held_out_error(cells.pick(others[:, i], full), warm, s, xm, ym).reshape(
                len(grid), n_vox)
        chosen[o] = grid[pooled.argmin(0)]
        score_fold(cells, cfg, models, widths, others.ravel(), ids[o], chosen[o], errors)
    r2 = {k: 1.0 - e / _total(cells) for k, e in errors.items()}
    return r2, np.exp(np.median(np.log(chosen), axis=0))


def score_fold(cells, cfg, models, widths, train, test, alpha, errors) -> None:
    """Refit every sub-model on the training cells and add its held-out error."""
    for name, blocks in models.items():
        cols = _columns(blocks, widths)
        g, c, s, xm, ym = standardised(cells.pick(train, cols))
        w = nn_ridge(g, c, alpha, None, cfg.max_sweeps, cfg.tol)
        errors[name] += held_out_error(cells.pick(test, cols), w, s, xm, ym)


def fixed_fit(cells: Cells, cfg: RidgeConfig, models: dict, widths, alpha):
    """Out-of-fold R2 at given penalties."""
    ids = np.arange(cfg.k_outer * cfg.k_inner).reshape(cfg.k_outer, cfg.k_inner)
    errors = {k: np.zeros(cells.syy.shape[1]) for k in models}
    for o in range(cfg.k_outer):
        score_fold(cells, cfg, models, widths, np.delete(ids, o, axis=0).ravel(), ids[o], alpha, errors)
    return {k: 1.0 - e / _total(cells) for k, e in errors.items()}


def assemble_predictors(blocks: DataFrame, keys=("subject", "layer")) -> DataFrame:
    """Blocks f, b, m, ns -> one array per image with the width of each block."""
    at = lambda b: F.coalesce(F.first(F.when(F.col("block") == b, F.col("x")), ignorenulls=True),
                              F.array().cast("array<double>"))
    wide = blocks.groupBy(*keys, "image_id").agg(*[at(b).alias(b) for b in BLOCKS])
    return wide.select(*keys, "image_id", F.concat(*BLOCKS).alias("x"),
                       F.array(*[F.size(b) for b in BLOCKS]).alias("widths"))


def block_widths(blocks: DataFrame, keys=("subject", "layer")) -> DataFrame:
    """Width of each predictor block, and whether the non-empty fits differ in capacity."""
    wide = blocks.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("block") == b, F.size("x"))), F.lit(0)).alias(b)
        for b in BLOCKS])
    return wide.withColumn("unequal", ~(
        (F.col("f") == F.col("b")) & (F.col("b") == F.col("m")) & (F.col("m") == F.col("ns"))))


STATS = ("n double, sx array<double>, sy array<double>, syy array<double>, "
         "g array<double>, c array<double>, widths array<int>")
STAT_NAMES = [f.split()[0] for f in STATS.split(", ")]
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(),
         "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


SALT_ROWS = 8192
FAN_IN = 64


def cell_stats(rows: DataFrame, keys) -> DataFrame:
    """Sums per cell from rows (keys, voxel_block, cell, place, x, widths, resp).

    Images are taken in runs of at most SALT_ROWS places; a task sums the few cells of its run,
    and the sums are added up in groups of FAN_IN runs, so that no task holds more than that.
    """
    keys = [*keys, "voxel_block"]
    types = dict(rows.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys) + ", cell int"
    kinds = {**types, "cell": "int", "_piece": "bigint", **dict(f.split() for f in STATS.split(", "))}
    to_arrow = lambda names: pa.schema([(n, ARROW[kinds[n]]) for n in names])

    def add_up(table: pa.Table) -> pa.Table:
        # list columns as matrices, without a Python object per row
        matrix = lambda name: table[name].combine_chunks().flatten().to_numpy(
            zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        all_x, all_y, cells = matrix("x"), matrix("resp"), table["cell"].to_numpy()
        first = {k: table[k][0].as_py() for k in [*keys, "_piece", "widths"]}
        out = []
        for cell in np.unique(cells):
            x, y = all_x[cells == cell], all_y[cells == cell]
            out.append({**first, "cell": int(cell), "n": float(len(x)), "sx": x.sum(0), "sy": y.sum(0),
                        "syy": (y * y).sum(0), "g": (x.T @ x).ravel(), "c": (x.T @ y).ravel()})
        names = [*keys, "cell", "_piece", *STAT_NAMES]
        return pa.Table.from_pylist([{n: row[n] for n in names} for row in out], schema=to_arrow(names))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.sort_values("_piece").groupby("cell"):
            row = part.iloc[0].to_dict()
            for name in ("n", "sx", "sy", "syy", "g", "c"):
                row[name] = sum(part[name].iloc[1:], part[name].iloc[0])
            out.append(row)
        return pd.DataFrame(out)[[*keys, "cell", *STAT_NAMES]]

    (rows,) = spread([*keys, "_piece"], rows.withColumn("_piece", F.floor(F.col("place") / SALT_ROWS)))
    pieces = rows.groupBy(*keys, "_piece").applyInArrow(add_up, f"{head}, _piece bigint, {STATS}")
    (pieces,) = spread([*keys, "_group"], pieces.withColumn("_group", F.floor(F.col("_piece") / FAN_IN)))
    return pieces.groupBy(*keys, "_group").applyInPandas(merge, f"{head}, {STATS}")


def gather(pdf: pd.DataFrame, n_cells: int):
    """Rows of one voxel block -> its Cells and block widths."""
    widths = np.asarray(pdf["widths"].iloc[0], int)
    p, v = int(widths.sum()), len(pdf["sy"].iloc[0])
    g, c = np.zeros((n_cells, p, p)), np.zeros((n_cells, p, v))
    sx, sy, syy = np.zeros((n_cells, p)), np.zeros((n_cells, v)), np.zeros((n_cells, v))
    n = np.zeros(n_cells)
    for row in pdf.sort_values(["cell", "n"]).itertuples(index=False):
        k = row.cell
        n[k] += row.n
        sx[k] += row.sx
        sy[k] += row.sy
        syy[k] += row.syy
        g[k] += np.reshape(row.g, (p, p))
        c[k] += np.reshape(row.c, (p, v))
    return Cells(g, c, sx, sy, syy, n), widths


def join_design(responses: DataFrame, predictors: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows for `cell_stats`: responses with their image's predictors and cell."""
    cells = folds.select("subject", "image_id", "place", "cell")
    return responses.join(predictors.join(cells, ["subject", "image_id"]), ["subject", "image_id"])


def pool_cells(stats: DataFrame, cells, keys=("subject", "layer")) -> DataFrame:
    """Sums of a training set of cells, centred and scaled by the training sd.

    One row per voxel block: n, xbar, scale, ybar, and gram and cross in standard units.
    """
    keys = [*keys, "voxel_block"]
    types = dict(stats.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    cells = [int(c) for c in cells]

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        every, widths = gather(pdf, max(cells) + 1)
        train = every.pick(np.array(cells), np.arange(int(widths.sum())))
        g, c, s, xm, ym = standardised(train)
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(n=train.n, xbar=xm, scale=s, ybar=ym, gram=g.ravel(), cross=c.ravel())
        return pd.DataFrame([row])

    (stats,) = spread(keys, stats.filter(F.col("cell").isin(cells)))
    return stats.groupBy(*keys).applyInPandas(
        pool, f"{head}, n double, xbar array<double>, scale array<double>, ybar array<double>, "
              "gram array<double>, cross array<double>")


def ridge_weights(pooled: DataFrame, alpha: float, cfg: RidgeConfig = RidgeConfig(),
                  keys=("subject", "layer"), block_size: int = 512) -> DataFrame:
    """Non-negative weights (voxel_id, place, w) of pooled training sums at one penalty."""
    types = dict(pooled.dtypes)

    def solve(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                p = len(row.scale)
                w = nn_ridge(np.reshape(row.gram, (p, p)), np.reshape(row.cross, (p, -1)), alpha,
                             None, cfg.max_sweeps, cfg.tol)
                place, voxel = np.indices(w.shape)
                out = pd.DataFrame({"voxel_id": row.voxel_block * block_size + voxel.ravel(),
                                    "place": place.ravel(), "w": w.ravel()})
                for k in keys:
                    out[k] = getattr(row, k)
                yield out[[*keys, "voxel_id", "place", "w"]]

    head = ", ".join(f"{k} {types[k]}" for k in keys)
    return pooled.mapInPandas(solve, f"{head}, voxel_id bigint, place int, w double")


def _fit_blocks(stats: DataFrame, keys, cfg, fits, block_size: int) -> DataFrame:
    types = dict(stats.dtypes)
    n_cells = cfg.k_outer * cfg.k_inner

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, widths = gather(pdf, n_cells)
        first = int(pdf["voxel_block"].iloc[0]) * block_size
        ids = first + np.arange(cells.syy.shape[1])
        out = []
        for fit, models in fits.items():
            r2, alpha = nested_fit(cells, cfg, models, widths)
            values = {**r2, f"alpha_{fit}": alpha}
            out += [pd.DataFrame({"voxel_id": ids, "measure": k, "value": v})
                    for k, v in values.items()]
        table = pd.concat(out)
        for k in keys:
            table[k] = pdf[k].iloc[0]
        return table[[*keys, "voxel_id", "measure", "value"]]

    head = ", ".join(f"{k} {types[k]}" for k in keys)
    (stats,) = spread([*keys, "voxel_block"], stats)
    return stats.groupBy(*keys, "voxel_block").applyInPandas(
        run, f"{head}, voxel_id bigint, measure string, value double")


def nested_cv_r2(stats: DataFrame, models: dict, cfg: RidgeConfig = RidgeConfig(),
                 keys=("subject", "layer"), block_size: int = 512) -> DataFrame:
    """One nested cross-validated fit: R2 of its sub-models and the median penalty, long."""
    return _fit_blocks(stats, list(keys), cfg, {"fit": models}, block_size)


def encode_voxels(stats: DataFrame, cfg: RidgeConfig = RidgeConfig(), keys=("subject", "layer"),
                  block_size: int = 512) -> DataFrame:
    """All fits of a layer: each unit type alone, face with body, and those with mixed."""
    return _fit_blocks(stats, list(keys), cfg, FITS, block_size)


def fixed_alpha_r2(stats: DataFrame, alphas: DataFrame, models: dict,
                   cfg: RidgeConfig = RidgeConfig(), keys=("subject", "layer"), extra=(),
                   block_size: int = 512) -> DataFrame:
    """R2 at given penalties; `alphas` is (keys, voxel_id, alpha), `extra` are further stats keys."""
    keys, extra = list(keys), list(extra)
    types = dict(stats.dtypes)
    n_cells = cfg.k_outer * cfg.k_inner
    packed = alphas.withColumn(
        "voxel_block", F.floor(F.col("voxel_id") / block_size).cast(types["voxel_block"])
    ).groupBy(*keys, "voxel_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("voxel_id", "alpha"))),
                    lambda e: e["alpha"]).alias("alpha"))  # at most block_size values
    rows = stats.join(packed, [*keys, "voxel_block"])
    held = [*keys, *extra]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, widths = gather(pdf, n_cells)
        alpha = np.asarray(pdf["alpha"].iloc[0], float)
        r2 = fixed_fit(cells, cfg, models, widths, alpha)
        ids = int(pdf["voxel_block"].iloc[0]) * block_size + np.arange(len(alpha))
        table = pd.concat([pd.DataFrame({"voxel_id": ids, "measure": k, "value": v})
                           for k, v in r2.items()])
        for k in held:
            table[k] = pdf[k].iloc[0]
        return table[[*held, "voxel_id", "measure", "value"]]

    head = ", ".join(f"{k} {types[k]}" for k in held)
    (rows,) = spread([*held, "voxel_block"], rows)
    return rows.groupBy(*held, "voxel_block").applyInPandas(
        run, f"{head}, voxel_id bigint, measure string, value double")


def shuffled_place(place: np.ndarray, n, key: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A keyed permutation of 0..n-1, computed for each place on its own; n for each place or for all.

    Feistel rounds on the smallest even-bit range that holds n; values beyond n walk on.
    """
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, limit, key = place.astype(np.uint64), np.asarray(n).astype(np.uint64), key.astype(np.uint64)
    out, at = np.empty(len(x), np.int64), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(at):
            left, right = x >> half, x & mask
            for r in range(rounds):
                h = right * np.uint64(0x9E3779B97F4A7C15) + (key + np.uint64(r + 1))
                h ^= h >> np.uint64(31)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(27)
                h *= np.uint64(0x94D049BB133111EB)
                h >>= np.uint64(33)
                left, right = right, left ^ (h & mask)
            x = (left << half) | right
            beyond = x >= limit
            out[at[~beyond]] = x[~beyond]
            x, key, at = x[beyond], key[beyond], at[beyond]
            if limit.ndim:
                half, mask, limit = half[beyond], mask[beyond], limit[beyond]
    return out


RUN_X, RUN_Y = 1 << 19, 1 << 18  # places of a run: of predictors, held by a task, and of responses, which pass by
WIDE = 512  # voxels of a block of which a task makes `per_task` permutations; of a narrower one it makes more
DRAWN = 1 << 16  # places drawn at once


class PairSums:
    """Sums by outer fold over the pairs of one run of predictors and of responses, for some permutations.

    `sums` holds, for each permutation and fold, the voxels' sums, X'Y and sums of squares; `grams`
    holds the predictors' counts, sums and X'X. The real order comes first, where it is asked for.
    """

    def __init__(self, head: dict, k_outer: int, k_inner: int):
        self.head, self.k_outer, self.k_inner = head, k_outer, k_inner
        self.first, self.size, self.n = head["first_place"], head["places"], head["n_images"]
        self.perms = [*([-1] if head["first_perm"] == 0 else []),
                      *range(head["first_perm"], head["first_perm"] + len(head["keys"]))]
        self.x = self.sums = None

    def predict(self, place: np.ndarray, cell: np.ndarray, x: np.ndarray) -> None:
        if self.x is None:
            self.x, self.fold = np.ones((self.size, x.shape[1] + 1)), np.full(self.size, -1)
        self.x[place - self.first, 1:] = x
        self.fold[place - self.first] = cell // self.k_inner

    def respond(self, place: np.ndarray, y: np.ndarray) -> None:
        if self.x is None:
            return
        q, v, many = self.x.shape[1], y.shape[1], len(self.perms)
        if self.sums is None:
            self.sums = np.zeros((many, self.k_outer, q + 1, v))
            self.grams = np.zeros((1 if self.head["whole"] else many, self.k_outer, q, q))
        at = 0
        if self.perms[0] < 0:
            self._add(0, place, y)
            at = 1
        keys = np.asarray(self.head["keys"])
        step = max(1, DRAWN // len(place))
        for i in range(0, len(keys), step):
            own = keys[i:i + step]
            drawn = shuffled_place(np.tile(place, len(own)), self.n, np.repeat(own, len(place)))
            for j, moved in enumerate(drawn.reshape(len(own), -1)):
                self._add(at + i + j, moved, y)

    def _add(self, i: int, moved: np.ndarray, y: np.ndarray) -> None:
        to = moved - self.first
        here = np.flatnonzero((to >= 0) & (to < len(self.x)))
        here = here[self.fold[to[here]] >= 0]
        here = here[np.argsort(to[here], kind="stable")]  # equal pairs add up to equal sums
        fold = self.fold[to[here]]
        if (np.diff(fold) < 0).any():
            order = np.argsort(fold, kind="stable")
            here, fold = here[order], fold[order]
        x, y = self.x[to[here]], y[here]
        ends = np.searchsorted(fold, np.arange(self.k_outer + 1))
        for k, (s, e) in enumerate(zip(ends[:-1], ends[1:])):
            if s < e:
                self.sums[i, k, :-1] += x[s:e].T @ y[s:e]
                self.sums[i, k, -1] += np.einsum("ij,ij->j", y[s:e], y[s:e])
                if i < len(self.grams) and (self.perms[i] < 0 or not self.head["whole"]):
                    self.grams[i, k] += x[s:e].T @ x[s:e]

    def rows(self):
        """(perm_id, sums, grams): grams is null where those of the real order hold."""
        if self.sums is None:
            return
        for i, perm in enumerate(self.perms):
            held = not self.head["whole"] or perm < 0
            yield perm, self.sums[i].tobytes(), self.grams[i].tobytes() if held else None


def runs_of(batches, keys):
    """(key, rows) of sorted rows, in slices of a batch: a key may come in several, one after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = [batch.column(k).to_pandas() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for column in held:
            new[1:] |= (column != column.shift()).to_numpy()[1:]
        for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(new)):
            yield tuple(column.iloc[rows[0]] for column in held), batch.slice(rows[0], len(rows))


def list_matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if column.null_count or len(column.value_lengths().unique()) > 1:
        raise ValueError("rows without values, or of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def permutation_sums(pairs: DataFrame, names, cfg: RidgeConfig) -> DataFrame:
    """(names, perm_id, sums, grams) of tasks: one run of predictors is held, and responses pass by it.

    Rows of `pairs` are of three sides: what a task is to do (0), predictors (1) and responses (2).
    They are sorted by numbers alone, as all rows of a task are equal in its names.
    """
    types = dict(pairs.dtypes)
    schema = pa.schema([*[(k, ARROW[types[k]]) for k in names], ("perm_id", pa.int64()),
                        ("sums", pa.binary()), ("grams", pa.binary())])

    def run(batches):
        def done():
            rows, size = [], 0
            for perm, *held in own.rows() if own else ():
                rows.append((*[own.head[k] for k in names], perm, *held))
                size += len(held[0])
                if size >= 1 << 22:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                              schema=schema)

        own = None
        for (_, side), rows in runs_of(batches, ["task", "side"]):
            if side == 0:
                yield from done()
                own = PairSums(rows.to_pylist()[0], cfg.k_outer, cfg.k_inner)
                continue
            place = rows.column("place").to_numpy()
            if side == 1:
                own.predict(place, rows.column("cell").to_numpy(), list_matrix(rows.column("x")))
            else:
                own.respond(place, list_matrix(rows.column("resp")))
        yield from done()

    (pairs,) = spread(["task"], pairs)
    head = ", ".join(f"{k} {types[k]}" for k in names)
    return pairs.sortWithinPartitions("task", "side", "place").mapInArrow(
        run, f"{head}, perm_id bigint, sums binary, grams binary")


def permutation_null(responses: DataFrame, predictors: DataFrame, folds: DataFrame,
                     alphas: DataFrame, n_perm: int = 1000, cfg: RidgeConfig = RidgeConfig(),
                     seed: int = 0, block_size: int = 512, per_task: int = 100,
                     run_x: int = RUN_X, run_y: int = RUN_Y) -> DataFrame:
    """R2 of the face + body + mixed fit at given penalties, against permuted responses.

    Two kinds of rows: per voxel (r2, n_ge: permutations that reach it), and per permutation and
    voxel block (perm_id, null_max). Real and null values come from the same fit. Folds stay with
    the predictors; every voxel of a subject sees the same permutation of its images. A task holds
    one run of predictors of a layer, and one run of the responses of a voxel block passes by it:
    it adds up the products of the pairs that meet there, for many permutations, by outer fold.
    These sums are added up over the runs and fitted, `per_task` permutations in a task: no task
    holds rows in proportion to the images, and nothing is copied per permutation.
    """
    model = {"r2_fbm": FITS["fbm"]["r2_fbm"]}
    outer = replace(cfg, k_inner=1)  # a fit at given penalties needs no inner folds
    block = ["subject", "layer", "voxel_block"]
    block_type = dict(responses.dtypes)["voxel_block"]
    own = folds.select("subject", "image_id", "place", "cell", "n_images")
    packed = alphas.withColumn(
        "voxel_block", F.floor(F.col("voxel_id") / block_size).cast(block_type)
    ).groupBy(*block).agg(
        F.array_sort(F.collect_list(F.struct("voxel_id", "alpha"))).alias("at"))  # one block's voxels
    held = responses.join(own.select("subject", "image_id", "place"), ["subject", "image_id"])
    width = sum((F.col("widths")[i] for i in range(1, 3)), F.col("widths")[0])  # face, body and mixed come first
    design = predictors.join(own, ["subject", "image_id"]).select(
        "subject", "layer", "place", "cell", F.slice("x", F.lit(1), width).alias("x"))

    # with one response and one predictor at every place, all permutations meet the same predictors
    once = lambda rows, keys, n: rows.groupBy(*keys).agg(F.count("*").alias(f"{n}_rows"),
                                                         F.count_distinct("place").alias(f"{n}_places"))
    every = lambda n: (F.col(f"{n}_rows") == F.col("n_images")) & (F.col(f"{n}_places") == F.col("n_images"))
    n_runs = lambda size: F.ceil(F.col("n_images") / size)
    pairs = n_runs(run_x) * n_runs(run_y)
    few = F.ceil(n_perm * F.size("at") / (per_task * WIDE))  # by the memory of the sums
    # runs are work for many tasks; a few images are so by their permutations alone
    n_parts = F.greatest(few, F.ceil(-(-n_perm // per_task) / pairs))
    plan = packed.join(own.groupBy("subject").agg(F.max("n_images").alias("n_images")), "subject").join(
        once(held, ["subject", "voxel_block"], "y"), ["subject", "voxel_block"]).join(
        once(design, ["subject", "layer"], "x"), ["subject", "layer"]).select(
        *block, "n_images", (every("x") & every("y")).alias("whole"),
        F.ceil(n_perm / n_parts).alias("perms"))
    plan = materialize(plan.coalesce(1).withColumn("number", F.monotonically_increasing_id()), "plan")  # a row a block

    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    of_run = lambda size: F.floor(F.col("place") / size)
    parts = F.ceil(n_perm / F.col("perms"))
    with_parts = lambda df: df.withColumn("part", upto(parts))
    task = (((F.col("number") * parts + F.col("part")) * n_runs(run_x) + F.col("run_x")) * n_runs(run_y)
            + F.col("run_y")).alias("task")
    of_side = lambda side, place: (task, F.lit(side).alias("side"), place.cast("bigint").alias("place"))
    heads = with_parts(plan).withColumn("run_x", upto(n_runs(run_x))).withColumn("run_y", upto(n_runs(run_y)))
    first = F.col("part") * F.col("perms")
    # keys are drawn per subject and permutation, so that they do not depend on the tasks
    drawn = F.when(first < n_perm, F.sequence(first, F.least(first + F.col("perms"), F.lit(n_perm)) - 1))
    start = F.col("run_x") * run_x
    heads = heads.select(*of_side(0, F.lit(-1)), *block, "run_x", "run_y", "n_images", "whole",
                         start.alias("first_place"), F.least(F.lit(run_x), F.col("n_images") - start).alias("places"),
                         first.alias("first_perm"),
                         F.transform(drawn, lambda p: F.xxhash64(F.lit(seed), "subject", p.cast("int"))).alias("keys"))
    plan = plan.drop("whole")
    x_rows = with_parts(design.join(plan, ["subject", "layer"])).withColumn("run_x", of_run(run_x)).withColumn(
        "run_y", upto(n_runs(run_y))).select(*of_side(1, F.col("place")), F.col("cell").cast("int").alias("cell"), "x")
    y_rows = with_parts(held.join(plan, ["subject", "voxel_block"])).withColumn("run_y", of_run(run_y)).withColumn(
        "run_x", upto(n_runs(run_x))).select(*of_side(2, F.col("place")), "resp")
    # empty lists, not null ones: Arrow's writer goes back over all null lists of a batch at every row
    lists = {"x": "array<double>", "resp": dict(responses.dtypes)["resp"], "keys": "array<bigint>"}
    filled = lambda df: df.withColumns({n: F.array().cast(kind) for n, kind in lists.items() if n not in df.columns})
    rows = filled(heads).unionByName(filled(x_rows), allowMissingColumns=True).unionByName(
        filled(y_rows), allowMissingColumns=True)
    sums = permutation_sums(rows, [*block, "run_x", "run_y"], cfg)

    last = -(-n_perm // per_task) - 1
    part = F.explode(F.when(F.col("perm_id") < 0, F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).otherwise(
        F.array(F.floor(F.col("perm_id") / per_task))))
    to_fit = sums.withColumn("part", part).join(packed.select(*block, F.col("at.alpha").alias("alpha")), block)

    def run(batches):
        def fitted():
            """The R2 of the permutation whose sums are complete."""
            nonlocal real, grams
            q = np.sqrt(len(gram if gram is not None else grams) / outer.k_outer)
            q = int(round(q))
            g = (gram if gram is not None else grams).reshape(outer.k_outer, q, q)
            s = total.reshape(outer.k_outer, q + 1, -1)
            cells = Cells(g[:, 1:, 1:], s[:, 1:-1], g[:, 0, 1:], s[:, 0], s[:, -1], g[:, 0, 0])
            r2 = fixed_fit(cells, outer, model, [q - 1, 0, 0, 0], alpha)["r2_fbm"]
            if perm < 0:
                real, grams = r2, gram
                out.update(reached=np.zeros(len(r2), int), perms=[], best=[])
            else:
                out["reached"] += r2 >= real
                out["perms"].append(perm)
                out["best"].append(r2.max())

        def table():
            subject, layer, voxel_block, _ = key
            ids = int(voxel_block) * block_size + np.arange(len(real))
            found = pd.concat([pd.DataFrame({"voxel_id": ids, "r2": real, "n_ge": out["reached"]}),
                               pd.DataFrame({"perm_id": out["perms"], "null_max": out["best"]})])
            return found.assign(subject=subject, layer=layer)

        key = perm = total = gram = real = grams = alpha = None
        out = {}
        for (*now, at_perm), rows in runs_of(batches, [*block, "part", "perm_id"]):
            if key is not None and (now != key or at_perm != perm):
                fitted()
            if key is not None and now != key:
                yield table()
            if now != key or at_perm != perm:
                total = gram = None
            key, perm, alpha = now, at_perm, np.asarray(rows.column("alpha")[0].as_py(), float)
            for sums_of, grams_of in zip(rows.column("sums"), rows.column("grams")):
                total = np.frombuffer(sums_of.as_buffer()) + (0 if total is None else total)
                if grams_of.is_valid:
                    gram = np.frombuffer(grams_of.as_buffer()) + (0 if gram is None else gram)
        if key is not None:
            fitted()
            yield table()

    names = ["subject", "layer", "voxel_id", "r2", "n_ge", "perm_id", "null_max"]
    schema = pa.schema([("subject", pa.string()), ("layer", pa.string()), ("voxel_id", pa.int64()), ("r2", pa.float64()),
                        ("n_ge", pa.int64()), ("perm_id", pa.int64()), ("null_max", pa.float64())])

    def batches_out(batches):
        for found in run(batches):
            found = found.reindex(columns=names).astype({"voxel_id": "Int64", "n_ge": "Int64", "perm_id": "Int64"})
            yield pa.RecordBatch.from_pandas(found, schema=schema, preserve_index=False)

    (to_fit,) = spread([*block, "part"], to_fit)
    return to_fit.sortWithinPartitions(*block, "part", "perm_id", "run_x", "run_y").mapInArrow(
        batches_out, "subject string, layer string, voxel_id bigint, r2 double, n_ge bigint, perm_id bigint, "
                     "null_max double")


def permutation_pvalues(nulls: DataFrame, n_perm: int) -> DataFrame:
    """(subject, layer, voxel_id, r2, p_perm) from `permutation_null`: (1 + n_ge) / (1 + n_perm)."""
    return nulls.filter("voxel_id IS NOT NULL").groupBy("subject", "layer", "voxel_id").agg(
        F.max("r2").alias("r2"), ((1 + F.sum("n_ge")) / (1 + n_perm)).alias("p_perm"))


def null_maxima(nulls: DataFrame) -> DataFrame:
    """Largest null R2 over all voxels of a subject, per permutation."""
    return nulls.filter("perm_id IS NOT NULL").groupBy("subject", "layer", "perm_id").agg(
        F.max("null_max").alias("null_max"))
