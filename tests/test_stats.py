import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from unimass.operators import cohorts as co
from unimass.operators import curves as cu
from unimass.operators import inference as inf
from unimass.operators import resample as rs
from unimass.operators import scores as sc


def curve_rows(spark, values):
    return spark.createDataFrame(
        [(e, k, b, float(b), y) for e, k, ys in values for b, y in enumerate(ys)],
        "entity string, key string, bin int, x double, y double")


def test_gradient_of_increasing_curves(spark):
    up = [(f"s{i}", "face", [float(j) for j in range(10)]) for i in range(8)]
    flat = [(f"s{i}", "flat", [1.0] * 10) for i in range(8)]
    out = {r["key"]: r for r in inf.gradient_stats(curve_rows(spark, up + flat)).collect()}
    assert out["face"]["median_r"] == 1 and out["face"]["n_pos"] == 8 and out["face"]["w"] == 0
    # eight equal correlations are ties: the normal limit applies
    assert out["face"]["p_raw"] == pytest.approx(0.0046777, abs=1e-6)
    assert out["face"]["p_sign"] == pytest.approx(2 / 256)
    assert out["flat"]["n"] == 0 and out["flat"]["p"] is None


def test_signed_rank_exact(spark):
    df = spark.createDataFrame([("k", v) for v in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)], "key string, v double")
    r = inf.wilcoxon_signed_rank(df, ["key"], "v").first()
    assert (r["w"], r["p"]) == (0.0, pytest.approx(2 / 256))


def test_one_sample_t(spark):
    data = [("a", v) for v in (1.0, 2.0, 3.0, None, float("nan"))] + [("one", 1.0)] + [("const", 2.0)] * 3
    out = {r["k"]: r for r in inf.one_sample_t(spark.createDataFrame(data, "k string, diff double"), ["k"]).collect()}
    a = out["a"]
    assert (a["n"], a["t"], a["d"]) == (3, pytest.approx(2 * np.sqrt(3)), pytest.approx(2.0))
    assert a["p"] == pytest.approx(0.0741799, abs=1e-6)
    assert a["ci_low"] == pytest.approx(2 - 4.302653 / np.sqrt(3), abs=1e-5)
    assert out["one"]["t"] is None and out["const"]["d"] is None


def test_interpolation_holds_ends_and_skips_missing(spark):
    df = spark.createDataFrame([("m", 0, None), ("m", 1, 1.0), ("m", 2, 3.0), ("n", 0, 1.0), ("n", 1, None)],
                               "model string, layer_ord int, y double")
    out = cu.interp_curve(df, ["model"], 5).collect()
    got = {(r["model"], r["bin"]): r["y"] for r in out}
    assert [got[("m", b)] for b in range(5)] == pytest.approx(list(np.interp([0, .25, .5, .75, 1], [.5, 1], [1, 3])))
    assert got[("n", 3)] is None


def test_gradient_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (1.0,), (None,)], "d_norm double")
    assert [r["bin"] for r in cu.gradient_bins(df).collect()] == [0, 0, 1, 9, None]


def test_within_subject_interval(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 4)) + rng.normal(size=(8, 1)) * 5
    data = [("r", f"s{i}", f"c{j}", float(x[i, j])) for i in range(8) for j in range(4)]
    data += [("r", "partial", "c0", 100.0)]
    df = spark.createDataFrame(data, "roi string, subject string, condition string, score double")
    norm = x - x.mean(1, keepdims=True) + x.mean()
    half = 2.364624 * norm.std(0, ddof=1) / np.sqrt(8) * np.sqrt(4 / 3)
    for out in (cu.within_subject_ci(df, ["roi"]), cu.within_subject_ci(df.drop("roi"))):
        got = {r["condition"]: r for r in out.collect()}
        assert [got[f"c{j}"]["ci_half"] for j in range(4)] == pytest.approx(list(half), abs=1e-5)
        assert [got[f"c{j}"]["mean"] for j in range(4)] == pytest.approx(list(x.mean(0)))


def test_mean_and_error_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0)], "k string, y double")
    few = {r["k"]: r for r in cu.mean_sem(df, ["k"]).collect()}
    assert few["a"]["mean"] is None and few["b"]["err"] == pytest.approx(1.0)
    every = {r["k"]: r for r in cu.mean_sem_rows(df, ["k"], single_zero=True).collect()}
    assert every["a"]["n"] == 2 and every["a"]["mean"] == 1.0
    one = cu.mean_sem_rows(df.filter("y = 3"), ["k"], single_zero=True).first()
    assert one["err"] == 0


def naive(values, n_iter, seed=5):
    rng = np.random.default_rng(seed)
    return np.array([values[rng.integers(0, len(values), len(values))].mean(0) for _ in range(n_iter)])


def test_bootstrap_matches_naive_resampling(spark, monkeypatch):
    monkeypatch.setattr(rs, "CHUNK_ROWS", 60)  # several chunks per group
    rng = np.random.default_rng(4)
    v = rng.gamma(2.0, size=300)
    df = spark.createDataFrame([("g", float(a)) for a in v], "g string, v double").repartition(5)
    boot = rs.bootstrap_means(df, ["g"], ["v"], 4000).toPandas()["v"]
    other = naive(v, 4000)
    assert len(boot) == 4000
    assert boot.mean() == pytest.approx(v.mean(), abs=0.01)
    assert boot.std() == pytest.approx(other.std(), rel=0.06)
    again = rs.bootstrap_means(df.repartition(3), ["g"], ["v"], 4000).toPandas()["v"]
    assert np.allclose(np.sort(boot), np.sort(again))


def flags(spark, n=400, repeats=3):
    rng = np.random.default_rng(6)
    base = rng.random((repeats, n)) < 0.8
    a = base & (rng.random((repeats, n)) < 0.9)
    data = []
    for r in range(repeats):
        for i in range(n):
            for c, x in (("baseline", base), ("face", a), ("body", a if r < 99 else base)):
                data.append(("t", r, i, c, int(x[r, i])))
    return spark.createDataFrame(data, "task string, repeat int, image_id int, condition string, correct int"), base, a


def test_paired_flags(spark):
    df, base, a = flags(spark)
    pat = rs.flag_patterns(df, ["face", "body"])
    drop = rs.boot_drop_ci(pat, ["face", "body"], n_iter=2000).toPandas()
    first = drop[(drop.repeat == 0) & (drop.condition == "face")].iloc[0]
    other = naive(np.column_stack([base[0], a[0]]).astype(float), 4000)
    other = other[:, 0] - other[:, 1]
    assert first["drop_point"] == pytest.approx(base[0].mean() - a[0].mean())
    assert first["ci_low"] == pytest.approx(np.percentile(other, 2.5), abs=0.006)
    pair = rs.boot_paired_diff(pat, ["face", "body"], n_iter=500).toPandas()
    assert (pair["p"] == 2).all() and (pair["mean_diff"] == 0).all()  # equal flags: p is not capped


def test_hierarchical_drop_matches_naive(spark):
    df, base, a = flags(spark)
    pat = rs.flag_patterns(df, ["face"])
    out = {r["scale"]: r for r in rs.boot_hier_drop(pat, ["face"], n_iter=3000).collect()}
    rng = np.random.default_rng(7)
    draws = []
    for _ in range(3000):
        d = []
        for s in rng.integers(0, 3, 3):
            i = rng.integers(0, 400, 400)
            d.append(base[s][i].mean() - a[s][i].mean())
        draws.append(np.mean(d))
    assert out["abs"]["mean_drop"] == pytest.approx(np.mean(draws), abs=0.002)
    assert out["abs"]["ci_high"] - out["abs"]["ci_low"] == pytest.approx(
        np.subtract(*np.percentile(draws, [97.5, 2.5])), rel=0.08)
    assert out["rel"]["mean_drop"] > out["abs"]["mean_drop"] and out["abs"]["n_splits"] == 3


def test_hierarchical_units_match_naive(spark):
    rng = np.random.default_rng(8)
    tree = {(m, k): rng.normal(m, 1, size=5 + 10 * k) for m in range(3) for k in range(2)}
    df = spark.createDataFrame([("x", f"m{m}", f"l{k}", float(v)) for (m, k), vs in tree.items() for v in vs],
                               "sel_type string, model string, layer string, v double")
    got = rs.boot_hier_units(df, ["sel_type"], "v", 3000).first()
    draws = []
    for _ in range(3000):
        parts = []
        for m in rng.integers(0, 3, 3):
            for k in rng.integers(0, 2, 2):
                u = tree[(m, k)]
                parts.append(u[rng.integers(0, len(u), len(u))])
        draws.append(np.concatenate(parts).mean())
    assert got["mean"] == pytest.approx(np.concatenate(list(tree.values())).mean())
    assert got["ci_high"] - got["ci_low"] == pytest.approx(np.subtract(*np.percentile(draws, [97.5, 2.5])), rel=0.08)


def test_dprime_contrasts_share_one_family(spark):
    rng = np.random.default_rng(9)
    data = [(f"m{m}", f"l{k}", s, float(rng.normal(2 if s == "face" else 0)), float(rng.normal(2 if s == "body" else 0)))
            for m in range(3) for k in range(2) for s in rs.UNIT_TYPES for _ in range(20)]
    df = spark.createDataFrame(data, "model string, layer string, sel_type string, face_d double, body_d double")
    out = {r["contrast"]: r for r in rs.boot_dprime_contrasts(df, n_iter=400).collect()}
    assert len(out) == 13 and out["interaction"]["p"] == 0
    assert out["interaction"]["value"] == pytest.approx(4, abs=0.8)
    assert out["mixed_face"]["p_raw"] > 0


def test_splits_and_folds(spark):
    images = spark.createDataFrame([(i, "a" if i < 25 else "b") for i in range(60)], "image_id bigint, category string")
    split = co.stratified_split(images, seed=1)
    got = {(r[0], r[1]): r[2] for r in rows(split.groupBy("category", "split").count())}
    assert got == {("a", "train"): 15, ("a", "val"): 5, ("a", "test"): 5,
                   ("b", "train"): 21, ("b", "val"): 7, ("b", "test"): 7}
    assert rows(split) == rows(co.stratified_split(images.repartition(5), seed=1))
    assert rows(split) != rows(co.stratified_split(images, seed=2))
    with pytest.raises(ValueError):
        co.stratified_split(images, 0.5, 0.2, 0.2)
    folds = co.fold_cells(images.withColumn("subject", F.lit("s")), k_outer=7, k_inner=2)
    sizes = sorted(r["count"] for r in folds.groupBy("outer_fold").count().collect())
    assert sizes == [8, 8, 8, 9, 9, 9, 9]


def test_top_images_and_winner(spark):
    data = [("m", i, "face", float(i)) for i in range(6)]
    top = co.top_images(spark.createDataFrame(data, "model string, image_id bigint, sel_type string, resp double"), 2)
    assert [r["image_id"] for r in top.orderBy("rank").collect()] == [5, 4]
    values = spark.createDataFrame(
        [("s", 1, "f", 0.5), ("s", 1, "b", 0.5), ("s", 2, "f", None), ("s", 2, "b", float("nan")), ("s", 3, "b", 0.1)],
        "subject string, voxel_id int, block string, value double")
    got = {r["voxel_id"]: r["winner"] for r in co.winner_take_all(values, ["f", "b"]).collect()}
    assert got == {1: "f", 2: None, 3: "b"}


def test_constant_maps_and_scales(spark):
    px = spark.createDataFrame([(1, "face", 0, x, 2.0) for x in range(4)],
                               "image_id int, sel_type string, y int, x int, value double")
    assert {r["value"] for r in sc.rescale_maps(px).collect()} == {0.0}
    assert {r["value"] for r in sc.rescale_maps(px, "joint").collect()} == {0.0}
    scale = sc.percentile_scale(px.withColumn("value", F.lit(-1.0)), ["sel_type"]).first()
    assert (scale["lo"], scale["hi"]) == (0.0, 1e-6)


def test_variance_portions_add_up(spark):
    enc = spark.createDataFrame(
        [("m", "l", "s", v, k, x) for v in range(5) for k, x in
         (("r2_f", 0.1 + v), ("r2_b", 0.2), ("r2_fb", 0.25 + v), ("r2_fbm", 0.3 + v))],
        "model string, layer string, subject string, voxel_id int, measure string, value double")
    total = sc.variance_partition(enc).filter("measure <> 'delta_m'").groupBy("voxel_id").agg(F.sum("value").alias("s"))
    assert all(r["s"] == pytest.approx(0.25 + r["voxel_id"]) for r in total.collect())


def test_significance_only_where_tested(spark):
    enc = spark.createDataFrame([("m", "l", s, v, "f", 1.0) for s in ("a", "b") for v in range(3)],
                                "model string, layer string, subject string, voxel_id int, measure string, value double")
    regions = enc.select("subject", "voxel_id", F.lit("FFA").alias("roi"))
    sig = spark.createDataFrame([("a", 1)], "subject string, voxel_id int")
    got = sc.voxelwise_to_roi(enc, regions, significant=sig)
    assert rows(got, "subject", "voxel_id") == [("a", 1), ("b", 0), ("b", 1), ("b", 2)]


def test_fwe_threshold(spark):
    null = spark.createDataFrame([("s", i, float(i)) for i in range(1, 101)], "subject string, perm_id int, null_max double")
    limit = inf.fwe_threshold(null)
    assert limit.first()["threshold"] == pytest.approx(95.05)
    r2 = spark.createDataFrame([("s", 1, 95.05), ("s", 2, 95.06)], "subject string, voxel_id int, r2 double")
    assert rows(inf.sig_mask(r2, limit), "voxel_id") == [(2,)]


def test_nulls_equal_but_for_rounding_reach_the_real_value(spark):
    mean = (0.1 + 0.1 + 0.1) / 3  # an ulp above 0.1
    assert mean > 0.1
    nulls = spark.createDataFrame([("s", 1, mean, 0.1)] * 3 + [("s", 2, 0.5, 0.4)] * 3, "subject string, voxel_id long, r2 double, null_r2 double")
    assert rows(inf.permutation_p(nulls), "voxel_id", "p_perm") == [(1, 1.0), (2, 0.25)]


def test_winners_tied_but_for_rounding_go_to_the_earlier_block(spark):
    values = spark.createDataFrame(
        [("s", 1, "f", 0.03573312716026923), ("s", 1, "b", 0.03573312716026924), ("s", 2, "b", 2.0), ("s", 2, "f", 1.0),
         ("s", 3, "f", None), ("s", 3, "b", float("nan")), ("s", 4, "b", float("inf")), ("s", 4, "f", 1.0)],
        "subject string, voxel_id long, block string, value double")
    got = rows(co.winner_take_all(values, ["f", "b"]), "voxel_id", "winner", "best")
    assert got == [(1, "f", 0.03573312716026924), (2, "b", 2.0), (3, None, None), (4, "b", float("inf"))]


def test_rounded_means_do_not_depend_on_the_order_of_the_rows(spark, tmp_path):
    """10.38, 4.45 and 160.67 have the mean 58.5, whose sum in one order lies below."""
    import datetime

    from unimass.plans import QUERIES

    betas = [10.38, 4.45, 160.67]
    data = []
    for user, order in enumerate(([0, 1, 2], [0, 2, 1], [1, 2, 0])):
        data += [(3 * user + i, datetime.datetime(2024, 1, 1 + i), user, "view", betas[b], '{"k": 61}') for i, b in enumerate(order)]
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert rows(QUERIES["winner_take_all"](spark, str(tmp_path)), "best") == [(59.0,)] * 3


def test_sums_drawn_row_by_row_have_the_spread_of_counted_ones():
    """The mean n * m and the sd sqrt(n) * s of n draws, for distinct and for repeated rows."""
    from unimass.operators.resample import drawn_sums

    rng = np.random.default_rng(3)
    v = np.column_stack([rng.random(5000), np.ones(5000)])
    for w in (np.ones(5000), np.repeat([1.0, 3.0], 2500), np.full(5000, 50.0)):
        n = int(w.sum())
        sums = drawn_sums(rng, np.full(2000, n), v, w)
        mean = (v[:, 0] * w).sum()
        sd = np.sqrt(n * (np.average(v[:, 0] ** 2, weights=w) - (mean / n) ** 2))
        assert (sums[:, 1] == n).all()
        assert abs(sums[:, 0].mean() - mean) < 5 * sd / np.sqrt(2000)
        assert abs(sums[:, 0].std() / sd - 1) < 0.1
