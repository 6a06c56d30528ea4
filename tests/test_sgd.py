"""Parallel stochastic descent against exact optima."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from statsmith.ml.registry import fit
from statsmith.ml.sgd import fit_sgd


def frame(spark, X, y, parts=6):
    rows = [(i, [float(v) for v in x], float(t)) for i, (x, t) in enumerate(zip(X, y, strict=True))]
    df = spark.createDataFrame(rows, "i long, f array<double>, label double")
    return df.repartitionByRange(parts, "label").select(array_to_vector(F.col("f")).alias("features"), "label")


def data(n, seed, noise=1.0):
    r = np.random.default_rng(seed)
    X = r.normal(size=(n, 4)) * [1, 5, 0.2, 30] + [0, 3, 1, -50]
    X[:, 3] += 10 * X[:, 0]                                  # correlated inputs
    y = 2 + X @ [3, -0.5, 4, 0.1] + noise * r.normal(size=n)
    return X, y


def standard(v):
    return (v - v.mean(axis=0)) / v.std(axis=0)


@pytest.mark.parametrize("rate", ["invscaling", "adaptive"])
def test_squared_error_reaches_the_least_squares_optimum(spark, rate):
    """Partitions hold different ranges of the label, so their own optima differ."""
    X, y = data(3000, 1, noise=6.0)
    m = fit_sgd(frame(spark, X, y), "regression", penalty=None, learning_rate=rate, tol=1e-4)
    Z, t = np.c_[standard(X), np.ones(len(X))], standard(y)
    exact = 0.5 * np.mean((t - Z @ np.linalg.lstsq(Z, t, rcond=None)[0]) ** 2)
    assert exact <= min(m.objective) <= 1.01 * exact
    assert len(m.objective) <= 25 and m.n_iter <= 1000


def test_log_loss_reaches_newton(spark):
    X, y = data(2500, 2, noise=5.0)
    c = (y > np.median(y)).astype(float)
    m = fit_sgd(frame(spark, X, c), "classification", loss="log_loss", alpha=1e-3, tol=1e-5)
    Z, s, w = np.c_[standard(X), np.ones(len(X))], 2 * c - 1, np.zeros(5)
    pen = np.array([1e-3] * 4 + [0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(Z @ w)))
        w = w - np.linalg.solve((Z * (p * (1 - p))[:, None]).T @ Z / len(Z) + np.diag(pen), Z.T @ (p - c) / len(Z) + pen * w)
    exact = np.mean(np.logaddexp(0, -s * (Z @ w))) + 0.5 * (pen * w * w).sum()
    assert exact - 1e-9 <= min(m.objective) <= 1.01 * exact


def test_max_iter_counts_epochs(spark):
    X, y = data(400, 3)
    df = frame(spark, X, y)
    assert fit_sgd(df, "regression", max_iter=2, tol=None).n_iter == 2
    assert fit_sgd(df, "regression", max_iter=7, tol=None).n_iter == 7
    svr = fit(df, "support vector machine", "regression", {"kernel": "linear", "max_iter": 2})
    assert svr.n_iter == 2
    with pytest.raises(ValueError):
        fit_sgd(df, "regression", max_iter=0)
    with pytest.raises(ValueError):
        fit_sgd(df, "regression", learning_rate="fast")


def test_chunks_and_classes(spark, monkeypatch):
    from statsmith.ml import sgd
    monkeypatch.setattr(sgd, "CHUNK_CELLS", 600)              # several chunks a task
    X, _ = data(900, 4)
    c = np.digitize(X[:, 0], [-0.5, 0.5]).astype(float)
    df = frame(spark, X, c)
    m = fit_sgd(df, "classification", loss="modified_huber", max_iter=60)
    hit = m.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert hit > 0.8 and m.classes == 3
    again = fit_sgd(df, "classification", loss="modified_huber", max_iter=60)
    assert np.allclose(m.W, again.W)
    lasso = fit_sgd(df, "regression", penalty="l1", alpha=10.0, max_iter=40)
    assert np.allclose(lasso.W, 0)
