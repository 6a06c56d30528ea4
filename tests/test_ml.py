"""Modelling: parameter conversions against closed forms, split, evaluation."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statsmith.ml import evaluate, registry, split, tune
from statsmith.operators import tests_rank


def _reg_data(spark, n=500, seed=21):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3)) * [1.0, 3.0, 0.5] + [2.0, -1.0, 0.0]
    y = 1.5 + X @ [2.0, -0.7, 3.0] + rng.normal(scale=0.5, size=n)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y)
    return spark.createDataFrame(pdf), X, y


def test_ridge_matches_closed_form(spark):
    df, X, y = _reg_data(spark)
    prep = registry.prepare(df, "y", "regression")
    alpha = 50.0
    m = registry.fit(prep.frame, "ridge", "regression", {"alpha": alpha})
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, rtol=1e-6)
    assert m.intercept == pytest.approx(y.mean() - X.mean(0) @ w, rel=1e-6)


def test_lasso_matches_coordinate_descent(spark):
    df, X, y = _reg_data(spark)
    prep = registry.prepare(df, "y", "regression")
    alpha = 0.3
    m = registry.fit(prep.frame, "lasso", "regression", {"alpha": alpha, "tol": 1e-10})
    n = len(y)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (Xc[:, j] @ Xc[:, j] / n)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-5)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(22)
    X = rng.normal(size=(600, 2))
    p = 1 / (1 + np.exp(-(0.3 + X @ [1.2, -0.8])))
    y = (rng.random(600) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame(X, columns=["a", "b"]).assign(y=y))
    prep = registry.prepare(df, "y", "classification")
    C = 0.5
    m = registry.fit(prep.frame, "logistic regression", "classification", {"C": C})
    Z = np.column_stack([np.ones(600), X])
    beta = np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-Z @ beta))
        reg = np.diag([0.0, 1.0 / C, 1.0 / C])
        g = Z.T @ (q - y) + reg @ beta
        H = Z.T @ (Z * (q * (1 - q))[:, None]) + reg
        beta -= np.linalg.solve(H, g)
    assert np.allclose(m.coefficients.toArray(), beta[1:], atol=1e-4)
    assert m.intercept == pytest.approx(beta[0], abs=1e-4)


def test_split_is_exact_and_partition_invariant(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n = ev.count()
    tr, te = split.train_test_split(ev, 0.2, 42, key="event_id")
    assert te.count() == int(np.ceil(n * 0.2)) and tr.count() + te.count() == n
    ids1 = sorted(r[0] for r in te.select("event_id").collect())
    _, te2 = split.train_test_split(ev.repartition(7), 0.2, 42, key="event_id")
    assert ids1 == sorted(r[0] for r in te2.select("event_id").collect())
    dup = spark.createDataFrame([(i % 3,) for i in range(100)], "k long")   # heavy duplicate keys
    tr, te = split.train_test_split(dup, 0.25, 1, key="k")
    assert te.count() == 25 and tr.count() == 75


def test_auc_equals_u_over_n1n2(spark):
    rng = np.random.default_rng(23)
    s = np.round(rng.normal(size=300), 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * s))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    auc = evaluate.roc_auc(df)
    pos, neg = s[y == 1], s[y == 0]
    u = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert auc == pytest.approx(u / (len(pos) * len(neg)), rel=1e-12)
    grp = df.select(F.when(F.col("label") == 1, "b").otherwise("a").alias("g"), F.col("score").alias("v"))
    mw = tests_rank.mannwhitney(grp, "g", "v").first()
    assert auc == pytest.approx(1 - mw["u_statistic"] / (len(pos) * len(neg)), rel=1e-12)
    roc = evaluate.roc_curve(df).orderBy(F.desc("threshold")).toPandas()
    assert roc.fpr.iloc[-1] == pytest.approx(1.0) and roc.tpr.iloc[-1] == pytest.approx(1.0)
    assert (np.diff(roc.fpr) >= 0).all() and (np.diff(roc.tpr) >= 0).all()


def test_classification_metrics_weighted(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 1)] * 2 + [(2, 2)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = {r["metric"]: r["value"] for r in evaluate.classification_metrics(df).collect()}
    y = np.array([r[0] for r in rows])
    p = np.array([r[1] for r in rows])
    prec, rec, sup = [], [], []
    for c in range(3):
        tp = ((y == c) & (p == c)).sum()
        prec.append(tp / max((p == c).sum(), 1))
        rec.append(tp / (y == c).sum())
        sup.append((y == c).sum())
    sup = np.array(sup)
    f1 = [2 * a * b / (a + b) if a + b else 0 for a, b in zip(prec, rec)]
    assert m["accuracy"] == pytest.approx((y == p).mean())
    assert m["precision"] == pytest.approx((sup * prec).sum() / sup.sum())
    assert m["recall"] == pytest.approx((sup * rec).sum() / sup.sum())
    assert m["f1"] == pytest.approx((sup * np.array(f1)).sum() / sup.sum())


def _cls_data(spark, n=800, seed=24):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    y = np.where(X[:, 0] + 0.5 * X[:, 1] > 0.3, "yes", "no")
    return spark.createDataFrame(pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y).assign(id=range(n)))


@pytest.mark.parametrize("model", ["logistic regression", "decision tree", "stochastic gradient descent",
                                   "support vector machine", "gradient boosting"])
def test_classifiers_beat_majority(spark, model):
    df = _cls_data(spark)
    tm = registry.train_model(df, "y", model, "classification", features=["a", "b", "c"], key="id")
    m = {r["metric"]: r["value"] for r in tm.metrics.collect()}
    assert m["n_test"] == 160 and m["accuracy"] > 0.8
    assert set(r[0] for r in tm.predictions.select("predicted_class").distinct().collect()) <= {"yes", "no"}


@pytest.mark.parametrize("model", ["linear regression", "random forest", "stochastic gradient descent",
                                   "support vector machine", "gaussian process", "xgboost"])
def test_regressors_beat_mean(spark, model):
    df, _, _ = _reg_data(spark, n=600)
    tm = registry.train_model(df, "y", model, "regression")
    m = {r["metric"]: r["value"] for r in tm.metrics.collect()}
    assert m["r2"] > 0.6


def test_bad_parameters_and_pairs_raise(spark):
    df, _, _ = _reg_data(spark, n=50)
    prep = registry.prepare(df, "y", "regression")
    with pytest.raises(ValueError):
        registry.fit(prep.frame, "ridge", "regression", {"C": 1.0})
    with pytest.raises(ValueError):
        registry.fit(prep.frame, "logistic regression", "regression")


def test_feature_importance_top(spark):
    df, _, _ = _reg_data(spark, n=400)
    tm = registry.train_model(df, "y", "random forest", "regression", params={"n_estimators": 20})
    fi = tm.feature_importance()
    assert len(fi) == 3 and fi[0][1] >= fi[1][1] >= fi[2][1]


def test_tuning_runs_small_budget(spark):
    df, _, _ = _reg_data(spark, n=200)
    best, hist = tune.auto_optimize(df, "y", "ridge", "regression", init_points=2, n_iter=2)
    assert 0.01 <= best["alpha"] <= 100 and hist.count() == 4


def test_order_statistic_bracket_equals_full(spark):
    from statsmith.operators import ordered
    rng = np.random.default_rng(41)
    vals = np.concatenate([np.full(3000, 0.5), rng.normal(size=6000)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    srt = np.sort(vals)
    for k in (0, 1500, 2999, 4500, 8999):
        a = ordered.order_statistic(df, "x", k, method="bracket")
        b = ordered.order_statistic(df, "x", k, method="full")
        assert a == b and a[0] == srt[k]


def test_stratified_folds_balance_each_class(spark):
    rows = [(i, "a" if i % 10 < 7 else ("b" if i % 10 < 9 else "c")) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y string")
    f = split.stratified_folds(df, "y", 3, key="id").groupBy("y", "fold").count().toPandas()
    for _, g in f.groupby("y"):
        assert len(g) == 3 and g["count"].max() - g["count"].min() <= 1
    assert f["count"].sum() == 1000


def test_tuning_classifier_uses_stratified_folds(spark):
    df = _cls_data(spark, n=300)
    best, hist = tune.auto_optimize(df, "y", "decision tree", "classification", features=["a", "b", "c"],
                                    init_points=2, n_iter=1, key="id")
    assert 3 <= best["max_depth"] <= 20 and hist.count() == 3


def test_many_training_rows_are_spread(spark, monkeypatch):
    """A small Parquet file comes as one partition; no task may hold all rows."""
    got = {}
    monkeypatch.setattr(registry, "_convert", lambda name, task, params, train, n: got.update({name: train}))
    monkeypatch.setattr(registry, "SPREAD_ROWS", 100, raising=False)
    monkeypatch.setattr(registry, "TASK_BYTES", 50_000, raising=False)
    frame = registry.prepare(_reg_data(spark)[0].coalesce(1), "y", "regression").frame
    for name in ("gaussian process", "random forest", "support vector machine", "decision tree"):
        registry.fit(frame, name, "regression")
        parts = got[name].rdd.glom().map(lambda rows: [(tuple(r["features"]), r["label"]) for r in rows]).collect()
        rows = sum(parts, [])
        assert sorted(rows) == sorted((tuple(r["features"]), r["label"]) for r in frame.collect())
        assert len(parts) >= 4 and max(map(len, parts)) < 250
        if name == "random forest":              # in the order of the features: few partitions a node
            assert len(parts) >= 15
            filled = [p for p in parts if p]
            assert all(max(x)[0] <= min(y)[0] for x, y in zip(filled, filled[1:]))
    few = frame.limit(100)
    registry.fit(few, "random forest", "regression")
    assert got["random forest"] is few


def test_spread_rows_give_the_same_classes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(600, 2))
    y = np.where(X[:, 0] > 0.4, "a", np.where(X[:, 1] > 0, "b", "c"))
    df = spark.createDataFrame(pd.DataFrame(X, columns=["u", "v"]).assign(y=y, k=range(600))).coalesce(1)
    models = [("random forest", {"n_estimators": 5, "max_depth": 4})]

    def metrics():
        return [registry.train_model(df, "y", m, "classification", ["u", "v"], p, key="k").metrics.collect() for m, p in models]

    whole = metrics()
    monkeypatch.setattr(registry, "SPREAD_ROWS", 100)
    monkeypatch.setattr(registry, "TASK_BYTES", 100_000)
    spread = metrics()
    for a, b in zip(whole, spread):
        a, b = ({r["metric"]: r["value"] for r in x} for x in (a, b))
        assert a["n_test"] == b["n_test"] == 120
        assert a["accuracy"] == pytest.approx(b["accuracy"], abs=0.1) and b["accuracy"] > 0.8
