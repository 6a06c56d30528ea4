"""Second-order boosting against sums over all rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from statsmith.ml.boosting import Tree, best_split, binned, fit_boosted, gradients


def frame(spark, X, y, parts=5):
    rows = [([float(v) for v in x], float(t)) for x, t in zip(X, y, strict=True)]
    df = spark.createDataFrame(rows, "f array<double>, label double").repartition(parts)
    return df.select(array_to_vector(F.col("f")).alias("features"), "label")


def brute_split(X, g, h, lam, gamma=0.0, min_h=0.0):
    """Best (gain, feature, threshold, missing left) over all values."""
    best = (0, None, None, None)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + lam)
    for f in range(X.shape[1]):
        x = X[:, f]
        for v in np.unique(x[~np.isnan(x)]):
            for to_left in (True, False):
                left = (x <= v) | (np.isnan(x) if to_left else False)
                if 0 < left.sum() < len(x) and min(h[left].sum(), h[~left].sum()) >= min_h:
                    gain = (score(left) + score(~left) - score(np.ones(len(x), bool))) / 2 - gamma
                    if gain > best[0] + 1e-9:
                        best = (gain, f, v, to_left)
    return best


def test_one_round_of_depth_one(spark):
    r = np.random.default_rng(1)
    X = r.integers(0, 12, (300, 3)).astype(float)
    X[r.random(300) < 0.2, 1] = np.nan
    y = 3.0 * (np.nan_to_num(X[:, 1], nan=9.0) > 6) + r.normal(size=300)
    m = fit_boosted(frame(spark, X, y), "regression", rounds=1, rate=1.0, max_depth=1, reg_lambda=1.0, min_child_weight=0)
    g, h = y.mean() - y, np.ones(300)
    gain, f, v, to_left = brute_split(X, g, h, 1.0)
    tree = m.trees[0][0]
    assert tree.feature[0] == f and tree.missing_left[0] == to_left
    assert m.gain[f] == pytest.approx(gain)
    left = (X[:, f] <= v) | (np.isnan(X[:, f]) & to_left)
    assert tree.value[tree.left[0]] == pytest.approx(-g[left].sum() / (h[left].sum() + 1))
    got = [x[0] for x in m.transform(frame(spark, X, y, 1)).select("prediction").collect()]
    want = y.mean() + np.where(left, tree.value[tree.left[0]], tree.value[tree.right[0]])
    assert sorted(got) == pytest.approx(sorted(want))


def test_leaf_by_leaf_takes_the_best_leaf(spark):
    """A step inside the far quarter only: three leaves by best gain are not a level of a tree."""
    x = np.arange(240.0)
    y = np.where(x < 180, 0.0, np.where(x < 210, 10.0, np.where(x < 225, 40.0, 400.0)))
    leaf = fit_boosted(frame(spark, x[:, None], y), "regression", rounds=1, rate=1.0, grow="leaf", max_depth=None, max_leaves=4,
                       reg_lambda=0.0, min_child_weight=0)
    level = fit_boosted(frame(spark, x[:, None], y), "regression", rounds=1, rate=1.0, max_depth=2, reg_lambda=0.0, min_child_weight=0)
    pred = lambda m: dict(m.transform(frame(spark, x[:, None], y)).select("label", "prediction").distinct().collect())
    got = pred(leaf)
    assert got == pytest.approx({0.0: 0.0, 10.0: 10.0, 40.0: 40.0, 400.0: 400.0}, abs=1e-9)
    assert leaf.trees[0][0].feature.count(0) >= 3 and len([1 for f in leaf.trees[0][0].feature if f >= 0]) == 3
    assert max(abs(v - k) for k, v in pred(level).items()) > 1             # four leaves too, but one in the flat part


def greedy(X, y, rounds, rate, depth, lam):
    """Boosting of the logistic loss by brute force."""
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        g, h = (v[:, 0] for v in gradients("classification", y, margin[:, None]))
        parts = [np.arange(len(y))]
        for _ in range(depth):
            new = []
            for rows in parts:
                gain, f, v, to_left = brute_split(X[rows], g[rows], h[rows], lam, min_h=1.0)
                if f is None:
                    new.append(rows)
                    continue
                left = (X[rows, f] <= v) | (np.isnan(X[rows, f]) & bool(to_left))
                new += [rows[left], rows[~left]]
            parts = new
        for rows in parts:
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + lam)
    return margin


def test_rounds_against_brute_force(spark):
    r = np.random.default_rng(2)
    X = np.round(r.normal(size=(250, 3)), 1)
    X[r.random(250) < 0.15, 0] = np.nan
    y = (X[:, 1] + np.nan_to_num(X[:, 0], nan=1.5) + 0.5 * r.normal(size=250) > 0.3).astype(float)
    m = fit_boosted(frame(spark, X, y), "classification", 2, rounds=12, rate=0.3, max_depth=2)
    want = greedy(X, y, 12, 0.3, 2, 1.0)
    got = m.transform(spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "i long, f array<double>").select(
        "i", array_to_vector(F.col("f")).alias("features"))).orderBy("i").collect()
    assert [x["rawPrediction"][1] for x in got] == pytest.approx(list(want), abs=1e-6)
    assert all(x["prediction"] == (w > 0) and abs(sum(x["probability"]) - 1) < 1e-9 for x, w in zip(got, want, strict=True))


def test_classes_sampling_and_limits(spark):
    r = np.random.default_rng(3)
    X = r.normal(size=(600, 4))
    X[:, 3] = 7.0                                                           # one value
    y = np.digitize(X[:, 0] + X[:, 1], [-0.7, 0.7]).astype(float)
    df = frame(spark, X, y)
    m = fit_boosted(df, "classification", 3, rounds=6, rate=0.3, grow="leaf", max_depth=None, max_leaves=8, min_child_samples=5)
    hit = m.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert hit > 0.85 and m.featureImportances.toArray()[3] == 0
    for trees in m.trees:
        for t in trees:
            leaves = [n for n in range(len(t.value)) if t.feature[n] < 0]
            assert len([n for n in range(len(t.value)) if t.feature[n] >= 0]) <= 7 and leaves
    one = fit_boosted(df, "classification", 3, rounds=4, grow="leaf", max_depth=None, max_leaves=8, top_rate=0.3, other_rate=0.3)
    hit = one.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert hit > 0.7
    flat = fit_boosted(df, "classification", 3, rounds=1, gamma=1e9)
    assert all(t.feature == [-1] for t in flat.trees[0])
    with pytest.raises(ValueError):
        fit_boosted(df.limit(0), "regression")


def test_binning_and_leaves():
    edges = [np.array([0.5, 1.5]), np.array([])]
    assert binned(np.array([[0.0, 3], [1, np.nan], [2, 3], [np.nan, 3]]), edges).tolist() == [[0, 1, 2, 255], [0, 255, 0, 0]]
    t = Tree()
    for v in (0.0, 1.0, 2.0):
        t.add(v)
    t.feature[0], t.cut[0], t.missing_left[0], t.left[0], t.right[0] = 0, 0, False, 1, 2
    assert t.leaves(np.array([[0, 1, 2, 255]], np.uint8)).tolist() == [1, 2, 2, 2]
    assert best_split(np.zeros((2, 3, 3)), 1.0, 0.0, 0.0, 0) is None
