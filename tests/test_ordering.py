import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from unimass.operators import inference as inf
from unimass.operators.ordering import average_rank, exact_percentile, global_order


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value most of that group."""
    rng = np.random.default_rng(1)
    data = [("hot", i, float(0 if i % 3 == 0 else rng.normal())) for i in range(3000)]
    data += [(f"g{i % 40}", 3000 + i, float(rng.normal())) for i in range(400)]
    return spark.createDataFrame(data, "g string, id int, v double").repartition(7)


def test_positions_are_exact(skewed):
    got = {(r["g"], r["id"]): (r["pos"], r["group_n"]) for r in global_order(
        skewed, ["g"], [F.col("v"), F.col("id")]).collect()}
    pdf = skewed.toPandas()
    for g, part in pdf.groupby("g"):
        for pos, i in enumerate(part.sort_values(["v", "id"])["id"], 1):
            assert got[(g, i)] == (pos, len(part))


def test_percentiles_match_numpy(skewed):
    got = {r["g"]: (r["a"], r["b"]) for r in exact_percentile(
        skewed, ["g"], "v", {"a": 0.99, "b": 0.5}).collect()}
    for g, part in skewed.toPandas().groupby("g"):
        assert got[g] == pytest.approx(np.percentile(part["v"], [99, 50]))


def test_percentiles_of_wide_brackets(skewed, monkeypatch):
    """Brackets that hold more than a task may order, and sketches that are too coarse."""
    from unimass.operators import ordering

    monkeypatch.setattr(ordering, "FEW", 3)
    monkeypatch.setattr(ordering, "ACCURACY", 7)
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in exact_percentile(
        skewed, ["g"], "v", {"a": 0.975, "b": 0.5, "c": 0.0}).collect()}
    for g, part in skewed.toPandas().groupby("g"):
        assert got[g] == pytest.approx(np.percentile(part["v"], [97.5, 50, 0]))


def test_positions_are_taken_from_one_sort(skewed):
    """The written slices are numbered in order: no window sorts the rows again."""
    plan = global_order(skewed, ["g"], [F.col("v"), F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_percentile_without_keys_skips_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (float("nan"),)], "v double")
    assert exact_percentile(df, [], "v", {"q": 0.975}).first()["q"] == pytest.approx(3.9)


def test_average_ranks(skewed):
    pdf = skewed.toPandas()
    want = {(g, i): r for g, part in pdf.groupby("g") for i, r in zip(part["id"], part["v"].rank())}
    for r in average_rank(skewed, ["g"], "v").collect():
        assert r["avg_rank"] == want[(r["g"], r["id"])]


def step_up(p, method):
    order = np.argsort(p)
    m = len(p)
    factor = m * (1 if method == "bh" else sum(1 / i for i in range(1, m + 1)))
    raw = p[order] * factor / np.arange(1, m + 1)
    adj = np.empty(m)
    adj[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    return adj


@pytest.mark.parametrize("method", ["bh", "by"])
def test_fdr_matches_brute_force(skewed, method):
    df = skewed.withColumn("p", F.when(F.col("id") % 11 == 0, None).otherwise(
        F.when(F.col("v") == 0, 1.0).otherwise(F.abs(F.col("v")) / 5)))
    pdf = inf.fdr_adjust(df, ["g"], "p", method, tie="id").toPandas()
    assert len(pdf) == 3400
    for _, part in pdf.groupby("g"):
        ok = part["p"].notna()
        assert np.allclose(part["p_adj"][ok], step_up(part["p"][ok].to_numpy(), method))
        assert part["p_adj"][~ok].isna().all()
        assert (part["p_adj"][ok] >= part["p"][ok] - 1e-12).all()


def test_few_and_many_agree(skewed):
    df = skewed.withColumn("p", F.abs(F.col("v")) / 5)
    a = inf.fdr_adjust_few(df, ["g"]).select("id", F.round("p_adj", 9))
    b = inf.fdr_adjust(df, ["g"]).select("id", F.round("p_adj", 9))
    assert rows(a) == rows(b)


@pytest.fixture(scope="module")
def gaps(spark):
    """A missing value and two missing keys, one of them with ties."""
    return spark.createDataFrame(
        [("a", 1, 0.5), ("a", 2, None), (None, 3, 0.1), (None, 4, 0.1), ("b", 5, 0.2)],
        "g string, id int, v double")


def test_missing_keys_are_a_group(gaps):
    got = {r["id"]: (r["pos"], r["group_n"]) for r in global_order(
        gaps, ["g"], [F.col("v"), F.col("id")]).collect()}
    assert got == {1: (2, 2), 2: (1, 2), 3: (1, 2), 4: (2, 2), 5: (1, 1)}
    ranks = {r["id"]: r["avg_rank"] for r in average_rank(gaps, ["g"], "v").collect()}
    assert ranks == {1: 2.0, 2: 1.0, 3: 1.5, 4: 1.5, 5: 1.0}
    top = {r["g"]: r["q"] for r in exact_percentile(gaps, ["g"], "v", {"q": 1.0}).collect()}
    assert top == {"a": 0.5, None: 0.1, "b": 0.2}


def test_missing_p_and_families(gaps):
    got = {r["id"]: r["p_adj"] for r in inf.fdr_adjust(gaps, ["g"], "v", "bh", tie="id").collect()}
    assert got[2] is None and got[1] == 0.5 and got[3] == got[4] == pytest.approx(0.1)
    every = {r["id"]: r["p_adj"] for r in inf.fdr_adjust(gaps, [], "v", "bh", tie="id").collect()}
    assert every == {1: 0.5, 2: None, 3: pytest.approx(0.2), 4: pytest.approx(0.2),
                     5: pytest.approx(0.2 * 4 / 3)}


def test_one_formula_for_harmonic_numbers(spark):
    n = spark.range(1, 3000).select("id", inf._harmonic(F.col("id")).alias("h")).collect()
    exact = np.cumsum(1 / np.arange(1, 3000))
    assert np.allclose([r["h"] for r in sorted(n)], exact, rtol=0, atol=1e-12)
