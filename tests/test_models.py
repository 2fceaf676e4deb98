import heapq

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from unimass.operators import glm as gl
from unimass.operators import graph as gr
from unimass.operators import nmf
from unimass.operators import readout as rd
from unimass.operators import ridge as rg


def test_ridge_closed_form_and_optimality():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 6)))
    y = rng.normal(size=(40, 5))
    assert np.allclose(rg.nn_ridge(q.T @ q, q.T @ y, 0.0), np.maximum(q.T @ y, 0), atol=1e-7)
    x = rng.normal(size=(60, 8))
    g, c = x.T @ x, x.T @ rng.normal(size=(60, 20))
    alpha = np.repeat([0.0, 1.0, 10.0, 100.0], 5)
    w = rg.nn_ridge(g, c, alpha, max_sweeps=2000, tol=1e-12)
    slope = g @ w + alpha * w - c
    assert (w >= 0).all() and (slope > -1e-6).all() and np.abs(slope * w).max() < 1e-6
    assert rg.nn_ridge(np.zeros((0, 0)), np.zeros((0, 3)), 1.0).shape == (0, 3)


CFG = rg.RidgeConfig(k_outer=4, k_inner=3, alphas=(0.1, 10.0, 1000.0))


def encoding_fixture(spark, n=200, v=20, seed=1):
    rng = np.random.default_rng(seed)
    x = {b: np.maximum(rng.normal(size=(n, 3)), 0) for b in ("f", "b", "m")}
    x["ns"] = np.zeros((n, 0))
    y = x["f"] @ rng.random((3, v)) + rng.normal(size=(n, v))
    y[:, 10:] = rng.normal(size=(n, v - 10))
    blocks = spark.createDataFrame(
        [("s", "fc7", b, i, a[i].tolist()) for b, a in x.items() for i in range(n)],
        "subject string, layer string, block string, image_id bigint, x array<double>")
    resp = spark.createDataFrame(
        [("s", i, k, y[i, k * 8:(k + 1) * 8].tolist()) for i in range(n) for k in range(3)],
        "subject string, image_id bigint, voxel_block int, resp array<double>").repartition(5)
    rng.shuffle(order := np.arange(n))
    cell = np.empty(n, int)
    for o, outer in enumerate(np.array_split(order, CFG.k_outer)):
        for i, inner in enumerate(np.array_split(outer, CFG.k_inner)):
            cell[inner] = o * CFG.k_inner + i
    place = np.argsort(order)
    folds = spark.createDataFrame(
        [("s", i, int(place[i]), n, int(cell[i])) for i in range(n)],
        "subject string, image_id bigint, place bigint, n_images bigint, cell int")
    return x, y, blocks, resp, folds, cell


def direct_r2(x, y, cell, alphas=None):
    """Nested cross-validation on the rows themselves."""
    k_in, err, picked = CFG.k_inner, np.zeros(y.shape[1]), []

    def fit(train, test, a):
        xm, ym, s = x[train].mean(0), y[train].mean(0), x[train].std(0)
        z = (x - xm) / np.where(s < 1e-10, 1, s)
        w = rg.nn_ridge(z[train].T @ z[train], z[train].T @ (y[train] - ym), a)
        return ((y[test] - ym - z[test] @ w) ** 2).sum(0)

    for o in range(CFG.k_outer):
        train, test = cell // k_in != o, cell // k_in == o
        if alphas is None:
            sums = [sum(fit(train & (cell % k_in != i), train & (cell % k_in == i), a) for i in range(k_in))
                    for a in CFG.penalties]
            best = CFG.penalties[np.argmin(sums, axis=0)]
        else:
            best = alphas
        picked.append(best)
        err += fit(train, test, best)
    return 1 - err / ((y - y.mean(0)) ** 2).sum(0), np.exp(np.median(np.log(picked), axis=0))


def test_nested_fit_from_cell_sums_equals_fit_on_rows(spark, monkeypatch):
    monkeypatch.setattr(rg, "SALT_ROWS", 7)  # many pieces, merged in groups
    monkeypatch.setattr(rg, "FAN_IN", 3)
    x, y, blocks, resp, folds, cell = encoding_fixture(spark)
    stats = rg.cell_stats(rg.join_design(resp, rg.assemble_predictors(blocks), folds), ["subject", "layer"]).cache()
    got = rg.encode_voxels(stats, CFG, block_size=8).toPandas().pivot(index="voxel_id", columns="measure", values="value")
    r2, alpha = direct_r2(np.hstack([x["f"], x["b"]]), y, cell)
    assert np.allclose(got["r2_fb"], r2, atol=1e-5) and np.allclose(got["alpha_fb"], alpha)
    assert np.allclose(got["f"], direct_r2(x["f"], y, cell)[0], atol=1e-5)
    assert (got["f"][:10] > 0.05).all() and np.abs(got["ns"]).max() < 0.1
    fixed = rg.fixed_alpha_r2(stats, spark.createDataFrame(
        [("s", "fc7", i, 10.0) for i in range(20)], "subject string, layer string, voxel_id bigint, alpha double"),
        {"r2": ("f", "b", "m")}, CFG, block_size=8).toPandas().set_index("voxel_id")["value"].sort_index()
    full = np.hstack([x["f"], x["b"], x["m"]])
    assert np.allclose(fixed, direct_r2(full, y, cell, np.full(20, 10.0))[0], atol=1e-5)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 100, 1000])
def test_keyed_shuffle_is_a_permutation(n):
    for key in (0, 1, -7):
        p = rg.shuffled_place(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(p) == list(range(n))


def test_permutations_destroy_the_signal(spark):
    x, y, blocks, resp, folds, cell = encoding_fixture(spark)
    alphas = spark.createDataFrame([("s", "fc7", i, 10.0) for i in range(20)],
                                   "subject string, layer string, voxel_id bigint, alpha double")
    pred = rg.assemble_predictors(blocks)
    nulls = rg.permutation_null(resp, pred, folds, alphas, 7, CFG, block_size=8, per_task=3)
    full = np.hstack([x["f"], x["b"], x["m"]])
    real, _ = direct_r2(full, y, cell, np.full(20, 10.0))
    placed = folds.toPandas().sort_values("image_id")
    place, by_place = placed["place"].to_numpy(), np.argsort(placed["place"].to_numpy())
    direct = []
    for p in range(7):  # the responses moved to other places, row by row
        key = spark.range(1).select(F.xxhash64(F.lit(0), F.lit("s"), F.lit(p))).first()[0]
        moved = rg.shuffled_place(place, np.full(len(place), len(place)), np.full(len(place), key))
        shuffled = np.empty_like(y)
        shuffled[by_place[moved]] = y
        direct.append(direct_r2(full, shuffled, cell, np.full(20, 10.0))[0])
    direct = np.array(direct)
    got = rg.permutation_pvalues(nulls, 7).toPandas().sort_values("voxel_id")
    assert np.allclose(got["r2"], real, atol=1e-5) and direct.max() < real[:10].min()
    assert np.allclose(got["p_perm"], (1 + (direct >= real).sum(0)) / 8)
    top = rg.null_maxima(nulls).toPandas().sort_values("perm_id")
    assert np.allclose(top["null_max"], direct.max(1), atol=1e-5)


@pytest.mark.parametrize("odd", [False, True])
def test_permutations_by_runs_of_images(spark, monkeypatch, odd):
    """Many short runs add up to what the rows give, also with images twice or without predictors."""
    x, y, blocks, resp, folds, cell = encoding_fixture(spark)
    n = len(y)
    if odd:
        resp = resp.union(resp.where("image_id % 7 = 0"))
        blocks = blocks.where("image_id % 11 > 0")
    alphas = spark.createDataFrame([("s", "fc7", i, 10.0) for i in range(20)],
                                   "subject string, layer string, voxel_id bigint, alpha double")
    add_up, tasks = rg.permutation_sums, []
    monkeypatch.setattr(rg, "permutation_sums", lambda pairs, *more: tasks.append(pairs) or add_up(pairs, *more))
    nulls = rg.permutation_null(resp, rg.assemble_predictors(blocks), folds, alphas, 7, CFG, block_size=8, per_task=3,
                                run_x=70, run_y=60).cache()
    held = tasks[0].groupBy("task", "side").count().toPandas()
    assert held["count"].max() <= 70  # no task holds all 200 images
    got = rg.permutation_pvalues(nulls, 7).toPandas().sort_values("voxel_id")
    full = np.hstack([x["f"], x["b"], x["m"]])
    rows = np.concatenate([np.arange(n), np.arange(0, n, 7)]) if odd else np.arange(n)
    placed = folds.toPandas().sort_values("image_id")["place"].to_numpy()
    image_at = np.argsort(placed)
    known_of = np.arange(n) % 11 > 0 if odd else np.ones(n, bool)

    def direct(moved):
        image = image_at[moved]
        known = known_of[image]
        return direct_r2(full[image[known]], y[rows][known], cell[image[known]], np.full(20, 10.0))[0]

    null = []
    for p in range(7):
        key = spark.range(1).select(F.xxhash64(F.lit(0), F.lit("s"), F.lit(p))).first()[0]
        null.append(direct(rg.shuffled_place(placed[rows], np.full(len(rows), n), np.full(len(rows), key))))
    real, null = direct(placed[rows]), np.array(null)
    assert np.allclose(got["r2"], real, atol=1e-5)
    assert np.allclose(got["p_perm"], (1 + (null >= real).sum(0)) / 8)
    top = rg.null_maxima(nulls).toPandas().sort_values("perm_id")
    assert np.allclose(top["null_max"], null.max(1), atol=1e-5)


def test_widths_are_reported(spark):
    _, _, blocks, _, _, _ = encoding_fixture(spark, n=10)
    r = rg.block_widths(blocks).first()
    assert (r["f"], r["ns"], r["unequal"]) == (3, 0, True)


def test_factorisation_reconstructs(spark):
    rng = np.random.default_rng(3)
    a = rng.random((40, 3)) @ rng.random((3, 12))
    acts = spark.createDataFrame([(i, u, float(a[i, u])) for i in range(40) for u in range(12)],
                                 "image_id bigint, unit_id bigint, act double")
    basis = nmf.nmf_fit(acts, 4, max_iter=30)
    weights = nmf.nmf_transform(acts, basis)
    err = nmf.reconstruction_error(acts, weights, basis).first()
    assert err["mse"] < 6e-3 * err["power"]
    assert all(min(r["x"]) >= 0 for r in weights.collect())
    empty = acts.filter("unit_id > 99")
    assert nmf.nmf_fit(empty).count() == 0


def test_groups_are_factorised_together(spark, monkeypatch):
    monkeypatch.setattr(nmf, "BLOCK", 60)  # several blocks a group
    rng = np.random.default_rng(4)
    data = {("s1", "fc6"): (30, 8, 2), ("s1", None): (25, 5, 3), ("s2", "fc6"): (4, 9, 2), ("s2", "fc7"): (20, 1, 1)}
    rows, of = [], {}
    for (subject, layer), (n, p, k) in data.items():
        a = of[subject, layer] = rng.random((n, k)) @ rng.random((k, p))
        rows += [(subject, layer, 100 + i, 7 * u, float(a[i, u])) for i in range(n) for u in range(p)]
    acts = spark.createDataFrame(rows, "subject string, layer string, image_id bigint, unit_id bigint, act double")
    keys = ["subject", "layer"]
    basis = nmf.nmf_fit(acts, 3, max_iter=60, keys=keys, tol=1e-7).cache()
    weights = nmf.nmf_transform(acts, basis, keys=keys).cache()
    assert weights.count() == 79 and all(min(r["x"]) >= 0 for r in weights.collect())
    for r in nmf.reconstruction_error(acts, weights, basis, keys=keys).collect():
        assert r["mse"] < 2e-3 * r["power"]
    widths = {(r["subject"], r["layer"]): len(r["h"]) for r in basis.collect()}
    assert widths == {("s1", "fc6"): 3, ("s1", None): 3, ("s2", "fc6"): 3, ("s2", "fc7"): 1}
    # weights are the least-squares ones on the basis
    h = np.array([r["h"] for r in basis.where("subject = 's1' AND layer = 'fc6'").orderBy("unit_id").collect()])
    x = np.array([r["x"] for r in weights.where("subject = 's1' AND layer = 'fc6'").orderBy("image_id").collect()])
    slope = (x @ h.T - of["s1", "fc6"].astype(np.float32)) @ h
    assert (slope > -1e-5).all() and np.abs(slope[x > 1e-9]).max() < 1e-5


def test_blocks_of_all_types_and_subjects(spark):
    rng = np.random.default_rng(5)
    acts = spark.createDataFrame([(s, i, u, float(rng.normal() + u)) for s in ("a", "b") for i in range(9) for u in range(7)],
                                 "subject string, image_id bigint, unit_id bigint, act double")
    cohort = spark.createDataFrame([(0, "face"), (1, "face"), (2, "body"), (2, "mixed"), (3, "other")], "unit_id bigint, sel_type string")
    got = nmf.predictor_blocks(acts, cohort, 5, keys=("subject",)).collect()
    assert {(r["subject"], r["block"]): len(r["x"]) for r in got} == {
        (s, b): w for s in ("a", "b") for b, w in (("f", 2), ("b", 1), ("m", 1))}
    assert len(got) == 2 * 3 * 9


def dijkstra(points, seeds):
    at = {tuple(p): i for i, p in enumerate(points)}
    best = {s: 0.0 for s in seeds}
    heap = [(0.0, s) for s in seeds]
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i]:
            continue
        for step in [*gr.STEPS, *[tuple(-v for v in s) for s in gr.STEPS]]:
            j = at.get(tuple(np.add(points[i], step)))
            if j is not None:
                nd = d + 1.8 * np.linalg.norm(step)
                if nd < best.get(j, np.inf) - 1e-12:
                    best[j] = nd
                    heapq.heappush(heap, (nd, j))
    return best


def grid(spark, points, seeds):
    data = [("s", "lh", i, *map(int, p), *[1.8 * float(v) for v in p], i in seeds) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "subject string, hemi string, voxel_id bigint, i int, j int, k int, "
                                       "x double, y double, z double, seed boolean")


def test_distances_on_a_line(spark):
    nodes = grid(spark, [(0, 0, k) for k in range(10)], {0})
    got = rows(gr.geodesic_distance(nodes, gr.neighbour_edges(nodes)), "voxel_id", "d_mm")
    assert [d for _, d in got] == pytest.approx([1.8 * k for k in range(10)])


def test_rounds_touch_active_cubes_alone(spark, monkeypatch):
    """Along a line of cubes every round writes the cube that the values have reached, and offers."""
    monkeypatch.setattr(gr, "TILE", 4)
    nodes = grid(spark, [(0, 0, k) for k in range(40)], {0})
    written = []
    path = gr.stage_path
    monkeypatch.setattr(gr, "stage_path", lambda spark, label: written.append(path(spark, label)) or written[-1])
    monkeypatch.setattr(gr, "delete_path", lambda *a: None)  # keep all rounds for a look
    got = rows(gr.geodesic_distance(nodes, gr.neighbour_edges(nodes)), "voxel_id", "d_mm")
    assert [d for _, d in got] == pytest.approx([1.8 * k for k in range(40)])
    folder = next(f for f in written if "/rounds-" in f)
    sizes = [spark.read.parquet(f"{folder}/{r}").count() for r in range(1, 11)]
    assert sizes[0] == 4 + 1 and max(sizes) <= 4 + 2 and sizes[-1] == 4 + 1


def test_distances_match_dijkstra_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(gr, "TILE", 3)
    rng = np.random.default_rng(5)
    points = [p for p in np.ndindex(9, 8, 7) if rng.random() < 0.5]
    nodes = grid(spark, points, {0, 7})
    edges = gr.neighbour_edges(nodes).cache()
    got = dict(rows(gr.geodesic_distance(nodes, edges), "voxel_id", "d_mm"))
    want = dijkstra(points, {0, 7})
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_components_take_few_rounds_along_many_cubes(spark, monkeypatch):
    """Fifty cubes in a row and a broken line beside them: rounds follow the logarithm of the cubes."""
    monkeypatch.setattr(gr, "TILE", 2)
    points = [(0, 0, k) for k in range(100)] + [(9, 0, k) for k in range(100) if k not in (30, 71)]
    written = []
    plain = gr.materialize
    monkeypatch.setattr(gr, "materialize", lambda df, label="stage": written.append(label) or plain(df, label))
    nodes = grid(spark, points, set())
    got = dict(rows(gr.components(nodes, gr.neighbour_edges(nodes)), "voxel_id", "comp"))
    starts = [0, 100, 130, 170]
    assert got == {i: max(s for s in starts if s <= i) for i in range(len(points))}
    assert len(written) <= 30


def test_only_the_seeded_component_stays(spark):
    far = [(20 + i, 0, 0) for i in range(3)]
    nodes = grid(spark, [*np.ndindex(4, 4, 4), *far], {0, 1, 64})
    out = gr.build_gradient(nodes, gr.neighbour_edges(nodes)).toPandas()
    assert sorted(out["voxel_id"]) == list(range(64))
    assert out["d_norm"].max() == 1 and out["d_norm"].min() == 0
    assert out["scale_mm"].iloc[0] == pytest.approx(np.percentile(out["d_mm"], 99))


def test_glm_finds_the_planted_response_and_matches_ols(spark):
    names, tr, n = list(gl.DOMAINS), 1.6, 120
    rng = np.random.default_rng(6)
    events, bold = [], []
    for run in range(2):
        for k in range(30):
            events.append(("s", run, 4.0 + 6 * k, 3.0, names[rng.integers(0, 5)]))
    import pandas as pd

    table = pd.DataFrame(events, columns=["subject", "run", "onset", "duration", "trial_type"])
    design = {r: gl.design_matrix(table[table.run == r], n, tr, names) for r in range(2)}
    y = {}
    for run in range(2):
        y[run] = rng.normal(size=(n, 3)) + 50
        y[run][:, 0] += 8 * design[run][:, 0]
        bold += [("s", run, v, t, float(y[run][t, v])) for v in range(3) for t in range(n)]
    b = spark.createDataFrame(bold, "subject string, run int, voxel_id bigint, t int, value double").repartition(6)
    e = spark.createDataFrame(events, "subject string, run int, onset double, duration double, trial_type string")
    out = {(r["voxel_id"], r["contrast"]): r for r in gl.mass_glm(b, e, tr, ar1=False).collect()}
    assert out[(0, "face>object")]["z"] > 4 and abs(out[(1, "face>object")]["z"]) < 4
    w = gl.contrast_weights(*gl.CONTRASTS["face>object"], names)
    effect = var = 0.0
    for run in range(2):
        x = design[run]
        inv = np.linalg.pinv(x.T @ x)
        beta = inv @ x.T @ y[run][:, 0]
        c = np.concatenate([w, np.zeros(x.shape[1] - 5)])
        effect += c @ beta
        var += ((y[run][:, 0] - x @ beta) ** 2).sum() / (n - x.shape[1]) * (c @ inv @ c)
    assert out[(0, "face>object")]["t"] == pytest.approx(effect / np.sqrt(var), rel=1e-6)
    white = gl.mass_glm(b, e, tr).filter("voxel_id = 0 AND contrast = 'face>object'").first()
    assert white["z"] > 4
    assert list(gl.contrast_weights(("a", "b"), ("c",), ["a", "b", "c"])) == [0.5, 0.5, -1.0]


def test_topk_ties_go_to_the_smaller_class(spark):
    scores = spark.createDataFrame([(1, c, l, s) for l, c, s in [(2, 0, .5), (2, 1, .5), (2, 2, .5), (2, 3, .1)]],
                                   "row_id bigint, class int, label int, score double")
    assert rd.topk_flags(scores, 2).first()["correct"] == 0
    assert rd.topk_flags(scores, 3).first()["correct"] == 1
    outside = scores.withColumn("label", F.lit(9))
    assert rd.topk_flags(outside, 4).first()["correct"] == 0


def test_lesioning_the_informative_units_costs_accuracy(spark):
    rng = np.random.default_rng(7)
    labels = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 9))
    x[np.arange(150), labels] += 6  # units 0-2 tell the classes apart
    acts = spark.createDataFrame([(i, "fc7", u, float(x[i, u])) for i in range(150) for u in range(9)],
                                 "image_id bigint, layer string, unit_id bigint, act double")
    images = spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "image_id bigint, label int")
    cohort = spark.createDataFrame([("fc7", u, "face" if u < 3 else "body") for u in range(6)],
                                   "layer string, unit_id bigint, sel_type string")
    flags = rd.repeat_runs(images, acts, cohort, "t", n_repeats=2).cache()
    acc = {(r["repeat"], r["condition"]): r["a"] for r in flags.groupBy("repeat", "condition").agg(
        F.avg("correct").alias("a")).collect()}
    assert {c for _, c in acc} == {"baseline", "face", "body"}
    for rep in range(2):
        assert acc[(rep, "baseline")] > 0.95 and acc[(rep, "face")] < 0.7 and acc[(rep, "body")] > 0.9
    zeroed = rd.lesion_units(acts, cohort, "face")
    assert zeroed.filter("unit_id < 3 AND act <> 0").count() == 0 and zeroed.count() == 150 * 9
    readout = rd.linear_readout(rd.features(acts.join(images, "image_id")), max_iter=30)
    scores = rd.readout_scores(rd.features(acts.join(images, "image_id")), readout)
    assert rd.accuracy(rd.topk_flags(scores, 1, row="image_id")).first()["accuracy"] > 0.95
    assert rd.mean_log_loss(scores, row="image_id").first()["loss"] < 0.2


def test_work_of_a_factorisation_is_dealt_by_images(spark):
    """Few units make small blocks in bytes, but as much work per image as the basis asks for."""
    acts = spark.range(4000 * 4).select((F.col("id") / 4).cast("long").alias("image_id"), (F.col("id") % 4).alias("unit_id"),
                                        (F.rand(3) + F.col("id") % 3).alias("act"))
    groups = nmf.numbered(acts, [], "act")
    units = spark.createDataFrame([(0, u, u) for u in range(4)], "gid int, unit_id long, pos int")
    sizes = [r["n"] for r in nmf.image_blocks(acts, units, groups, [], "act").select(F.size("images").alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 1.2 * nmf.IMAGES


def test_weights_are_those_of_the_ridge_without_penalty():
    rng = np.random.default_rng(4)
    a, h = np.maximum(rng.standard_normal((300, 20)), 0), np.maximum(rng.standard_normal((20, 9)), 0)
    h[:, 4] = 0
    got = nmf.weights_on(a, h, 500, 1e-7)
    assert np.allclose(got, rg.nn_ridge(h.T @ h, (a @ h).T, 0.0, max_sweeps=500).T, atol=1e-9)
    assert got.min() == 0 and not got[:, 4].any() and nmf.weights_on(a[:0], h, 5, 1e-4).shape == (0, 9)
