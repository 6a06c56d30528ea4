"""PCA and factor analysis."""
import numpy as np
import pytest

from statsmith.operators import reduce


def _frame(spark, X, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in X], ", ".join(f"{n} double" for n in names))


def test_pca_matches_numpy_and_sums_to_100(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    names = ["a", "b", "c", "d"]
    res = reduce.pca(_frame(spark, X, names), names, k=4)
    Z = (X - X.mean(0)) / X.std(0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(Z, rowvar=False)))[::-1]
    got = [r["eigenvalue"] for r in res.variance.orderBy("component").collect()]
    assert np.allclose(got, ev, rtol=1e-9)
    assert res.variance.agg({"variance_pct": "sum"}).first()[0] == pytest.approx(100.0)
    sc = res.scores.select([f"PC{i}" for i in range(1, 5)]).toPandas().to_numpy()
    assert np.allclose(sc.var(axis=0, ddof=1), ev, rtol=1e-9)


def test_pca_scale_shift_invariance(spark):
    rng = np.random.default_rng(12)
    X = rng.normal(size=(200, 3))
    a = reduce.pca(_frame(spark, X, ["a", "b", "c"]), ["a", "b", "c"], 2).loadings_matrix
    b = reduce.pca(_frame(spark, X * [3, 0.5, 10] + [100, -4, 7], ["a", "b", "c"]), ["a", "b", "c"], 2).loadings_matrix
    assert np.allclose(a, b, atol=1e-9)


def test_scores_null_on_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 4.0)], "a double, b double")
    s = reduce.pca(df, ["a", "b"], 1).scores.orderBy("a").collect()
    assert s[1]["PC1"] is None and s[0]["PC1"] is not None


def test_factor_analysis_recovers_planted_loadings(spark):
    rng = np.random.default_rng(13)
    L = np.array([[0.9, 0], [0.8, 0], [0.7, 0], [0, 0.9], [0, 0.8], [0, 0.7]])
    F_ = rng.normal(size=(5000, 2))
    X = F_ @ L.T + rng.normal(size=(5000, 6)) * np.sqrt(1 - (L ** 2).sum(1))
    names = [f"x{i}" for i in range(6)]
    res = reduce.factor_analysis(_frame(spark, X, names), names, 2, "varimax")
    got = np.abs(res.loadings_matrix)
    # match factor order
    if got[0, 0] < got[0, 1]:
        got = got[:, ::-1]
    assert np.allclose(got, L, atol=0.05)
    sc = res.scores.select("Factor1", "Factor2").toPandas().to_numpy()
    var = [r["variance"] for r in res.variance.orderBy("component").collect()]
    assert np.allclose(sc.var(axis=0, ddof=0), var, rtol=1e-6)
    for rot in ("quartimax", "promax", None):
        r = reduce.factor_analysis(_frame(spark, X[:500], names), names, 2, rot)
        assert r.loadings_matrix.shape == (6, 2)


def test_varimax_is_orthogonal_rotation():
    rng = np.random.default_rng(14)
    L = rng.normal(size=(8, 3))
    V = reduce.varimax(L)
    assert np.allclose(V @ V.T, L @ L.T, atol=1e-9)


def test_pca_rejects_bad_k(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        reduce.pca(df, ["a", "b"], 3)


def test_wide_gram_matches_numpy(spark):
    from statsmith.operators.gram import WIDE, gram
    rng = np.random.default_rng(15)
    p = WIDE + 5
    X = rng.normal(size=(700, p)) * rng.uniform(0.5, 3, p) + rng.normal(0, 50, p)
    names = [f"c{i}" for i in range(p)]
    g = gram(_frame(spark, X, names).repartition(5), names)
    assert g.n == 700
    assert np.allclose(g.mean, X.mean(0), rtol=1e-10)
    assert np.allclose(g.cov, np.cov(X, rowvar=False, ddof=0), rtol=1e-9, atol=1e-9)
