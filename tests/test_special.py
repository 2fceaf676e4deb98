import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unimass.functions import special as sp


@pytest.mark.parametrize("t, df, p", [(2.228139, 10, 0.025), (12.706205, 1, 0.025), (0.0, 7, 0.5),
                                      (-2.228139, 10, 0.975)])
def test_t_tail(t, df, p):
    assert float(sp.t_tail(t, df)) == pytest.approx(p, abs=1e-6)


def test_t_tail_is_accurate_far_out():
    # df = 2 has the closed form (1 - t / sqrt(2 + t^2)) / 2
    t = np.array([1e2, 1e4, 1e6])
    exact = 1 / (np.sqrt(2 + t * t) * (np.sqrt(2 + t * t) + t))
    assert np.allclose(sp.t_tail(t, 2.0), exact, rtol=1e-10)
    assert float(sp.t_tail(40.0, 200.0)) < 1e-90


def test_t_quantile_inverts_the_tail():
    q = sp.t_quantile(np.array([0.975, 0.5, 0.1]), np.array([10.0, 3.0, 25.0]))
    assert q[0] == pytest.approx(2.228139, abs=1e-6)
    assert q[1] == pytest.approx(0.0, abs=1e-9)
    assert 1 - float(sp.t_tail(q[2], 25.0)) == pytest.approx(0.1, abs=1e-9)


def test_signed_rank_and_sign_tests():
    assert sp.signed_rank_p(0, 8) == pytest.approx(2 / 256)
    assert sp.signed_rank_p(3, 5) == pytest.approx(2 * 5 / 32)


@given(st.floats(0.5, 200))
@settings(max_examples=50, deadline=None)
def test_log_gamma(x):
    assert float(sp.log_gamma(x)) == pytest.approx(math.lgamma(x), abs=1e-9)


def test_columns_keep_missing_values(spark):
    df = spark.createDataFrame([(1.959964, 10.0), (None, 3.0), (0.0, None)], "x double, df double")
    out = df.select(sp.normal_sf(F.col("x")).alias("z"), sp.t_sf(F.col("x"), F.col("df")).alias("t")).collect()
    assert out[0]["z"] == pytest.approx(0.025, abs=1e-7)
    assert out[1]["z"] is None and out[1]["t"] is None and out[2]["t"] is None
    p = spark.createDataFrame([(8, 8), (4, 8), (1, 8)], "k int, n int").select(
        sp.binom_two_sided(F.col("k"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in p] == pytest.approx([2 / 256, 1.0, 2 * 9 / 256])
