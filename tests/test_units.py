import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from unimass.operators import cohorts as co
from unimass.operators import moments as mo
from unimass.operators import rules as ru

CATS = ("face", "body", "scene", "object", "scrambled")
SIZES = (30, 30, 30, 30, 15)
PLANTED = {"face": range(0, 10), "body": range(10, 20), "mixed": range(20, 25), "scene": range(25, 30)}


def matrix(seed):
    rng = np.random.default_rng(seed)
    labels = np.repeat(CATS, SIZES)
    x = rng.normal(size=(len(labels), 200))
    for kind, units in PLANTED.items():
        hit = np.isin(labels, ["face", "body"] if kind == "mixed" else [kind])
        x[np.ix_(hit, list(units))] += 3.0
    x[:, 190:] = 1.0
    return labels, x.astype(np.float32)


@pytest.fixture(scope="module")
def planted(spark):
    data = []
    for m in ("alexnet_ecoset", "vgg16_imagenet"):
        for layer in ("conv1", "fc7"):
            labels, x = matrix(len(m + layer))
            for i, (lab, row) in enumerate(zip(labels, x)):
                data += [(m, layer, i, str(lab), b, row[b * 50:(b + 1) * 50].tolist()) for b in range(4)]
    return spark.createDataFrame(
        data, "model string, layer string, image_id bigint, category string, block_id int, acts array<float>").cache()


SPEC = ru.UnitSpec(CATS, single=("face", "body"), mixed=(("face", "body"),), solo=("scene",))


@pytest.fixture(scope="module")
def selected(planted):
    return ru.select_units(mo.unit_moments(mo.explode_units(planted, 50)), SPEC).cache()


def test_rules_recover_exactly_the_planted_units(selected):
    got = {}
    for r in selected.filter("selected").collect():
        got.setdefault((r["model"], r["layer"], r["sel_type"]), set()).add(r["unit_id"])
    for m in ("alexnet_ecoset", "vgg16_imagenet"):
        for layer in ("conv1", "fc7"):
            for kind, units in PLANTED.items():
                assert got.get((m, layer, kind), set()) == set(units)


def test_types_are_exclusive(selected):
    assert ru.exclusivity_check(selected).count() == 0


def test_block_size_and_partitions_do_not_matter(planted):
    wide = mo.unit_moments(mo.explode_units(planted, 50))
    narrow = planted.select("model", "layer", "image_id", "category", F.posexplode(F.array(
        F.slice("acts", 1, 25), F.slice("acts", 26, 25))).alias("half", "acts"), "block_id")
    narrow = narrow.withColumn("block_id", F.col("block_id") * 2 + F.col("half")).drop("half")
    again = mo.unit_moments(mo.explode_units(narrow.repartition(13), 25))
    cut = lambda df: rows(df.select("model", "layer", "unit_id", "category", "n", F.round("mean", 6), F.round("var", 6)))
    assert cut(wide) == cut(again)


def test_dprime_matches_numpy(planted):
    profiles = mo.unit_profiles(mo.unit_moments(mo.explode_units(planted.filter(
        "model = 'alexnet_ecoset' AND layer = 'conv1'"), 50)))
    got = {(r["unit_id"], r["sel_type"]): r["dval"] for r in mo.dprime(
        profiles, {"face": ["face"], "mixed": ["face", "body"]}).collect()}
    labels, x = matrix(len("alexnet_ecosetconv1"))
    for kind, cats in (("face", ["face"]), ("mixed", ["face", "body"])):
        a, b = x[np.isin(labels, cats)].astype(float), x[~np.isin(labels, cats)].astype(float)
        pooled = ((len(a) - 1) * a.var(0, ddof=1) + (len(b) - 1) * b.var(0, ddof=1)) / (len(a) + len(b) - 2)
        want = (a.mean(0) - b.mean(0)) / np.sqrt(pooled + 1e-10)
        assert np.allclose([got[(u, kind)] for u in range(190)], want[:190], atol=1e-6)
        assert got[(195, kind)] == 0


def test_unit_z_is_missing_for_constant_units(planted):
    profiles = mo.unit_profiles(mo.unit_moments(mo.explode_units(planted, 50)))
    z = mo.unit_response_z(profiles)
    assert z.filter("unit_id >= 190 AND z IS NOT NULL").count() == 0
    assert z.filter("unit_id < 190 AND z IS NULL").count() == 0


def test_cohorts_are_ordered_and_matched(selected):
    groups = co.unit_groups(selected)
    ranked = co.rank_units(groups, controlled=True).toPandas()
    assert set(ranked.groupby(["model", "layer", "sel_type"]).size()) == {5}
    for (_, _, kind), part in ranked.sort_values("rank").groupby(["model", "layer", "sel_type"]):
        assert part["dval"].is_monotonic_increasing if kind == "nonselective" else part["dval"].is_monotonic_decreasing
    top = co.rank_units(groups, n_top=3).groupBy("sel_type").count()
    assert dict(rows(top))["face"] == 12 and dict(rows(top))["nonselective"] == 4 * (200 - 25)
    assert co.nonselective_units(selected).count() == 4 * (200 - 25)


def test_layers_without_selective_units_stay_whole(spark):
    none = spark.createDataFrame(
        [("m", "l", u, s, float(u), False) for u in range(6) for s in ("face", "body", "mixed")],
        "model string, layer string, unit_id bigint, sel_type string, dval double, selected boolean")
    assert co.lesion_cohorts(co.unit_groups(none)).count() == 6


def test_specs_are_validated():
    with pytest.raises(ValueError):
        ru.UnitSpec(("face", "object"), single=("face",))
    with pytest.raises(ValueError):
        ru.UnitSpec(CATS, single=("face", "dog"))
    with pytest.raises(ValueError):
        ru.UnitSpec(CATS, single=("face", "body"), solo=("face",))
    with pytest.raises(ValueError):
        ru.UnitSpec(CATS, single=("face", "body"), solo=("object",))
    with pytest.raises(ValueError):
        ru.UnitSpec(CATS, single=("face", "body"), mixed=(("face",),))
    several = ru.UnitSpec(CATS, single=("face", "body", "scene"))
    assert several.mixed_name(("face", "body")) == "face&body" and several.rival("face") is None


def test_session_zscore_and_ncsnr(spark):
    rng = np.random.default_rng(0)
    data = [("s", s, s * 30 + k, v, (s * 30 + k) % 10, 1.0 if v == 0 else float(rng.normal()))
            for s in range(2) for k in range(15) for v in range(20)]
    trials = spark.createDataFrame(
        data, "subject string, session int, trial_id int, voxel_id int, image_id int, beta double")
    z = mo.session_zscore(trials)
    assert z.filter("voxel_id = 0 AND z <> 0").count() == 0
    per = z.filter("voxel_id = 3").groupBy("session").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in per.collect())
    snr = {r["voxel_id"]: r["ncsnr"] for r in mo.ncsnr(z).collect()}
    assert snr[0] == 0 and len(snr) == 20
    two = mo.ncsnr(z.filter("image_id > 100"))
    assert two.count() == 0


def test_cross_correlation_of_equal_views(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(v.tolist(), v.tolist()) for v in rng.normal(size=(400, 5))],
                               "a array<double>, b array<double>").repartition(4)
    corr = mo.cross_correlation(df)
    assert all(abs(r["c"] - 1) < 1e-3 for r in corr.filter("i = j").collect())
    assert mo.redundancy_score(corr).first()["on_diag"] < 1e-4


def test_noise_within_rounding_is_no_noise(spark):
    z = [0.7071067811865476, 0.7071067811865474, 0.7071067811865475]
    trials = spark.createDataFrame([("s", 1, 8, v) for v in z], "subject string, voxel_id long, image_id long, z double")
    assert rows(mo.ncsnr(trials), "ncsnr") == [(0.0,)]


def test_mixed_units_come_with_their_dprime(spark):
    from unimass.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["select_mixed"](spark, sf)
    every = QUERIES["dprime"](spark, sf).columns
    assert got.columns == every and got.filter("dval IS NULL").isEmpty()
