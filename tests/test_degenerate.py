"""Constant columns, no variance inside groups, oblique factors, binned charts."""

import math

import numpy as np
import pytest

from statsmith.operators import chartdata, multivariate, reduce, tests_parametric


def planted(spark, n=4000, seed=1):
    r = np.random.default_rng(seed)
    f = r.multivariate_normal([0, 0], [[1, 0.4], [0.4, 1]], n)
    load = np.array([[0.9, 0], [0.8, 0], [0.7, 0], [0, 0.85], [0, 0.75], [0, 0.6]])
    X = f @ load.T + r.normal(size=(n, 6)) * np.sqrt(1 - (load ** 2).sum(axis=1))
    rows = [(*map(float, x), 3.0) for x in X]
    return X, spark.createDataFrame(rows, ", ".join(f"v{i} double" for i in range(6)) + ", flat double")


COLS = [f"v{i}" for i in range(6)]


def test_promax_is_oblique(spark):
    X, df = planted(spark)
    res = reduce.factor_analysis(df, COLS, 2, "promax")
    P, phi, psi = res.loadings_matrix, res.correlation, res.uniqueness
    plain = reduce.factor_analysis(df, COLS, 2, None).loadings_matrix
    assert P @ phi @ P.T == pytest.approx(plain @ plain.T, abs=1e-9)             # the same common part
    R = np.corrcoef(X.T)
    assert np.abs(R - (P @ phi @ P.T + np.diag(psi))).max() < 0.03
    assert phi[0, 0] == pytest.approx(1) and 0.25 < phi[0, 1] < 0.55
    assert res.structure == pytest.approx(P @ phi)
    Z = (X - X.mean(axis=0)) / X.std(axis=0)
    A = np.linalg.inv(P @ phi @ P.T + np.diag(psi)) @ P @ phi                     # regression scores, the other closed form
    got = np.array([[r["Factor1"], r["Factor2"]] for r in res.scores.collect()])
    order = lambda m: m[np.lexsort(m.T)]
    assert order(got) == pytest.approx(order(Z @ A), abs=1e-6)
    assert res.values == pytest.approx((Z @ A).var(axis=0), abs=1e-6)


def test_constant_columns(spark):
    _, df = planted(spark, 500)
    with_flat, without = (reduce.factor_analysis(df, c, 2, "varimax") for c in ([*COLS, "flat"], COLS))
    assert with_flat.loadings_matrix[:6] == pytest.approx(without.loadings_matrix) and not with_flat.loadings_matrix[6].any()
    assert chartdata.scree_data(with_flat.variance).columns == ["component", "eigenvalue", "reference"]
    assert [r["eigenvalue"] for r in chartdata.scree_data(without.variance).collect()] == pytest.approx(list(without.values))
    with pytest.raises(ValueError):
        reduce.factor_analysis(df, ["v0", "flat"], 1)
    k = {r["variable"]: r for r in multivariate.kmo(df, [*COLS, "flat"]).collect()}
    want = {r["variable"]: r["msa"] for r in multivariate.kmo(df, COLS).collect()}
    assert k["flat"]["msa"] is None and k["flat"]["interpretation"] == "undefined"
    assert {c: k[c]["msa"] for c in want} == pytest.approx(want)
    b = multivariate.bartlett_sphericity(df, ["v0", "v1", "flat"]).first()
    assert b["chi2"] is None and b["significant"] is None and b["verdict"] == "undefined: flat does not vary"


def test_no_variance_inside_groups(spark):
    rows = [("a", 1.0, i, 2.0) for i in range(5)] + [("b", 3.0, i, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, v double, k int, same double")
    t = tests_parametric.ttest_ind(df, "g", "v").first()
    assert t["t_statistic"] == -math.inf and t["p_value"] == 0 and t["significant"]
    assert tests_parametric.ttest_ind(df, "g", "same").first()["t_statistic"] is None
    f = tests_parametric.anova_oneway(df, "g", "v").first()
    assert f["f_statistic"] == math.inf and f["p_value"] == 0
    assert tests_parametric.anova_oneway(df, "g", "same").first()["f_statistic"] is None
    assert tests_parametric.ttest_rel(df, "g", "v", "k").first()["t_statistic"] == -math.inf


def test_binned_charts(spark):
    r = np.random.default_rng(2)
    pts = np.round(r.normal(size=(700, 2)), 2)
    rows = [(float(a), float(b)) for a, b in pts] + [(None, 1.0), (1.0, None), (float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "`x.a` double, y double")
    got = {(g["x_bin"], g["y_bin"]): g["count"] for g in chartdata.scatter_bins(df, "x.a", "y", 10).collect()}
    h, _, _ = np.histogram2d(pts[:, 0], pts[:, 1], 10)
    assert sum(got.values()) == 700 and np.abs(sum(got.values()) - h.sum()) == 0
    low, step = pts.min(axis=0), (pts.max(axis=0) - pts.min(axis=0)) / 10
    cells = np.minimum(np.floor((pts - low) / step), 9).astype(int)
    assert got == {tuple(c): int(n) for c, n in zip(*np.unique(cells, axis=0, return_counts=True), strict=True)}
    line = chartdata.line_buckets(df, "x.a", "y", 5).collect()
    assert sum(b["points"] for b in line) == 700
    assert min(b["low_y"] for b in line) == pts[:, 1].min() and max(b["last_x"] for b in line) == pts[:, 0].max()
    one = spark.createDataFrame([(1.0, 2.0)] * 3, "a double, b double")
    assert [tuple(x) for x in chartdata.scatter_bins(one, "a", "b").collect()] == [(0, 0, 1.0, 2.0, 3)]
    assert chartdata.scatter_bins(one.limit(0), "a", "b").count() == 0 == chartdata.line_buckets(one.limit(0), "a", "b").count()
