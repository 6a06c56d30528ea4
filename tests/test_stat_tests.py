"""Statistical tests: published values, brute force and Commons Math."""
import itertools

import numpy as np
import pytest

from statsmith.operators import multivariate, tests_parametric as TP, tests_rank as TR


def _jarr(spark, xs):
    a = spark.sparkContext._gateway.new_array(spark._jvm.double, len(xs))
    for i, v in enumerate(xs):
        a[i] = float(v)
    return a


def _two_groups(spark, a, b, name="v"):
    rows = [("g1", float(x)) for x in a] + [("g2", float(x)) for x in b]
    return spark.createDataFrame(rows, f"g string, {name} double")


def test_shapiro_published_values(spark):
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = TR.shapiro(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert r["w_statistic"] == pytest.approx(0.788815, abs=2e-6)
    assert r["p_value"] == pytest.approx(0.0067038, abs=2e-6)
    mpg = [21.0, 21.0, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4,
           14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26.0, 30.4, 15.8, 19.7, 15.0, 21.4]
    r = TR.shapiro(spark.createDataFrame([(v,) for v in mpg], "x double"), "x").first()
    assert r["w_statistic"] == pytest.approx(0.947565, abs=2e-6)
    assert r["p_value"] == pytest.approx(0.122881, abs=2e-6)


def test_shapiro_constant_and_chunked(spark):
    r = TR.shapiro(spark.createDataFrame([(1.0,)] * 10, "x double"), "x").first()
    assert r["w_statistic"] == 1.0 and r["p_value"] == 1.0
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=400), 1)          # many ties
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    a = TR.shapiro(df, "x").first()
    b = TR.shapiro(df, "x", chunk=3).first()       # ties expanded in many small chunks
    assert a["w_statistic"] == pytest.approx(b["w_statistic"], rel=1e-12)


def test_mannwhitney_exact_matches_enumeration(spark):
    a, b = [1.1, 3.4, 2.2, 8.9], [4.5, 5.6, 6.7, 7.8, 0.3, 9.9]
    r = TR.mannwhitney(_two_groups(spark, a, b), "g", "v").first()
    assert r["method"] == "exact"
    allv = a + b
    m = len(a)
    us = []
    for idx in itertools.combinations(range(len(allv)), m):
        xs = [allv[i] for i in idx]
        ys = [allv[i] for i in range(len(allv)) if i not in idx]
        us.append(sum(1 for x in xs for y in ys if x > y))
    u1 = sum(1 for x in a for y in b if x > y)
    umax = max(u1, m * len(b) - u1)
    p = min(1.0, 2 * np.mean([u >= umax for u in us]))
    assert r["u_statistic"] == u1
    assert r["p_value"] == pytest.approx(p, rel=1e-12)


def test_mannwhitney_asymptotic_and_auc_identity(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 60), 1), np.round(rng.normal(0.4, 1, 45), 1)
    r = TR.mannwhitney(_two_groups(spark, a, b), "g", "v").first()
    assert r["method"] == "asymptotic"
    u1 = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u_statistic"] == pytest.approx(u1)


def test_kruskal_no_ties_closed_form(spark):
    groups = {"a": [1.0, 5.0, 9.0], "b": [2.0, 6.0, 10.0, 11.0], "c": [3.0, 4.0, 7.0, 8.0, 12.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    r = TR.kruskal(df, "g", "v").first()
    allv = sorted(v for vs in groups.values() for v in vs)
    rank = {v: i + 1 for i, v in enumerate(allv)}
    N = len(allv)
    h = 12 / (N * (N + 1)) * sum(sum(rank[v] for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (N + 1)
    assert r["h_statistic"] == pytest.approx(h, rel=1e-12)


def test_ttests_and_anova_against_commons_math(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(10, 2, 40), rng.normal(11, 2, 55)
    tt = spark._jvm.org.apache.commons.math3.stat.inference.TTest()
    r = TP.ttest_ind(_two_groups(spark, a, b), "g", "v").first()
    assert r["t_statistic"] == pytest.approx(tt.homoscedasticT(_jarr(spark, a), _jarr(spark, b)), rel=1e-10)
    assert r["p_value"] == pytest.approx(tt.homoscedasticTTest(_jarr(spark, a), _jarr(spark, b)), rel=1e-7)
    x, y = rng.normal(5, 1, 30), rng.normal(5.3, 1, 30)
    rows = [(i, "pre", float(v)) for i, v in enumerate(x)] + [(i, "post", float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    r = TP.ttest_rel(df, "g", "v", "k").first()         # group 1 = 'post'
    assert r["t_statistic"] == pytest.approx(tt.pairedT(_jarr(spark, y), _jarr(spark, x)), rel=1e-10)
    assert r["p_value"] == pytest.approx(tt.pairedTTest(_jarr(spark, y), _jarr(spark, x)), rel=1e-7)
    gs = [rng.normal(m, 1, n) for m, n in ((0, 20), (0.5, 25), (1, 30))]
    df = spark.createDataFrame([(str(i), float(v)) for i, g in enumerate(gs) for v in g], "g string, v double")
    r = TP.anova_oneway(df, "g", "v").first()
    jl = spark._jvm.java.util.ArrayList()
    for g in gs:
        jl.add(_jarr(spark, g))
    ow = spark._jvm.org.apache.commons.math3.stat.inference.OneWayAnova()
    assert r["f_statistic"] == pytest.approx(ow.anovaFValue(jl), rel=1e-10)
    assert r["p_value"] == pytest.approx(ow.anovaPValue(jl), rel=1e-7)


def test_chi_square_yates_and_rxc(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 12
    r = TP.chi_square(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    assert r["yates"] and r["chi2"] == pytest.approx(4.8869, abs=1e-4)
    rng = np.random.default_rng(2)
    rows = [(str(rng.integers(0, 3)), str(rng.integers(0, 4))) for _ in range(400)]
    r = TP.chi_square(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    tab = np.zeros((3, 4), dtype=np.int64)
    for a, b in rows:
        tab[int(a), int(b)] += 1
    jt = spark.sparkContext._gateway.new_array(spark._jvm.long, 3, 4)
    for i in range(3):
        for j in range(4):
            jt[i][j] = int(tab[i, j])
    cs = spark._jvm.org.apache.commons.math3.stat.inference.ChiSquareTest()
    assert r["chi2"] == pytest.approx(cs.chiSquare(jt), rel=1e-10)
    assert r["p_value"] == pytest.approx(cs.chiSquareTest(jt), rel=1e-7)


def test_anova_twoway_balanced(spark):
    rng = np.random.default_rng(4)
    rows = [(a, b, float(rng.normal(i + 2 * j, 1))) for i, a in enumerate("xyz") for j, b in enumerate("pq")
            for _ in range(6)]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    t = {r["source"]: r for r in TP.anova_twoway(df, "a", "b", "v").collect()}
    y = np.array([r[2] for r in rows])
    M = y.mean()
    ssa = sum(12 * (np.mean([r[2] for r in rows if r[0] == a]) - M) ** 2 for a in "xyz")
    sst = ((y - M) ** 2).sum()
    assert t["a"]["sum_sq"] == pytest.approx(ssa, rel=1e-10)
    assert t["Residual"]["df"] == 36 - 6
    total = sum(t[k]["sum_sq"] for k in t)
    assert total == pytest.approx(sst, rel=1e-10)


def test_cronbach_bartlett_kmo(spark):
    rng = np.random.default_rng(8)
    f = rng.normal(size=300)
    X = np.column_stack([f + rng.normal(scale=s, size=300) for s in (0.5, 0.7, 1.0)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double")
    k = 3
    alpha = k / (k - 1) * (1 - X.var(axis=0, ddof=1).sum() / X.sum(axis=1).var(ddof=1))
    assert TP.cronbach_alpha(df, ["a", "b", "c"]).first()["alpha"] == pytest.approx(alpha, rel=1e-10)
    R = np.corrcoef(X, rowvar=False)
    chi2 = -((300 - 1) - (2 * 3 + 5) / 6) * np.log(np.linalg.det(R))
    assert multivariate.bartlett_sphericity(df, ["a", "b", "c"]).first()["chi2"] == pytest.approx(chi2, rel=1e-9)
    per, overall = multivariate.kmo_values(R)
    got = {r["variable"]: r["msa"] for r in multivariate.kmo(df, ["a", "b", "c"]).collect()}
    assert got["__overall__"] == pytest.approx(overall, rel=1e-9)
    assert 0 < overall < 1


def test_run_test_dispatch_and_per_test_errors(spark):
    from statsmith.operators import testing
    rows = [("a", "x", "p", 1.0), ("b", "y", "p", 2.0), ("a", "z", "q", 3.5), ("b", "x", "q", 0.5),
            ("a", "y", "p", 2.5), ("b", "z", "q", 4.0)]
    df = spark.createDataFrame(rows, "g2 string, g3 string, h string, v double")
    r = {x["group_variable"]: x for x in testing.run_test(df, "ttest", ["g2", "g3"], "v").collect()}
    assert r["g2"]["error"] is None and r["g2"]["t_statistic"] is not None
    assert "exactly 2 levels" in r["g3"]["error"]
    k = testing.run_test(df, "kruskal", ["g3", "h"], "v").collect()
    assert len(k) == 2 and all(x["error"] is None for x in k)
    two = testing.run_test(df, "anova_two", ["g2", "h"], "v").collect()
    assert len(two) == 4
    with pytest.raises(ValueError):
        testing.run_test(df, "nonsense", ["g2"], "v")
