"""Distribution tails against Apache Commons Math (shipped with Spark)."""
import math

import pytest

from statsmith.functions import dist


@pytest.mark.parametrize("t,df", [(0.5, 3), (2.1, 10), (-3.3, 25), (1.96, 1000), (8.0, 4)])
def test_t_two_sided(spark, t, df):
    jt = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df))
    expect = 2 * (1 - jt.cumulativeProbability(abs(t)))
    assert dist.t_sf_two_sided(t, df) == pytest.approx(expect, rel=1e-7, abs=1e-12)


@pytest.mark.parametrize("f,d1,d2", [(1.0, 2, 10), (3.5, 4, 40), (0.2, 1, 5), (12.0, 3, 1000)])
def test_f_sf(spark, f, d1, d2):
    jf = spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(d1), float(d2))
    assert dist.f_sf(f, d1, d2) == pytest.approx(1 - jf.cumulativeProbability(f), rel=1e-7, abs=1e-12)


@pytest.mark.parametrize("x,k", [(0.5, 1), (3.84, 1), (10.0, 4), (40.0, 30), (2.0, 7)])
def test_chi2_sf(spark, x, k):
    jc = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(k))
    assert dist.chi2_sf(x, k) == pytest.approx(1 - jc.cumulativeProbability(x), rel=1e-7, abs=1e-12)


def test_tiny_tail_is_not_zero():
    assert 0 < dist.chi2_sf(400.0, 2) < 1e-80
    assert dist.norm_sf(10) == pytest.approx(7.619853024160527e-24, rel=1e-9)


def test_ndtri_column_matches_stdlib(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from statsmith.functions.columns import ndtri
    ps = [1e-10, 0.001, 0.02425, 0.1, 0.3, 0.5, 0.7, 0.975, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(ndtri(F.col("p"))).collect()]
    for p, g in zip(ps, got):
        assert g == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-12)
    assert math.isclose(dist.norm_ppf(0.975), 1.959963984540054, rel_tol=1e-12)
