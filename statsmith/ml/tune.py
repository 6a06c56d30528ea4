"""Guided hyper-parameter search with k-fold cross-validation.

Five uniform points, then fifteen chosen by maximising the upper confidence
bound (mean + 2.576 sd) of a Gaussian process (Matern 5/2) fitted to the
scores so far, over random candidates in the unit box.  The driver only
proposes points (<= 20, numpy); every evaluation is a Spark job: the model is
fitted on two hash folds and scored on the third, three times.  Tuning uses
the training part only (the reference tuned on all rows, test included).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.ml import evaluate, registry
from statsmith.ml.split import hash_folds, stratified_folds, train_test_split
from statsmith.session import stored

CLS, REG = registry.CLS, registry.REG

# Search bounds of the reference, per model and task.
BOUNDS = {
    (CLS, "logistic regression"): {"C": (0.01, 100)},
    (CLS, "support vector machine"): {"C": (0.1, 100), "gamma_log": (-4, 1)},
    (CLS, "decision tree"): {"max_depth": (3, 20), "min_samples_split": (2, 20)},
    (CLS, "random forest"): {"n_estimators": (50, 300), "max_depth": (3, 20), "min_samples_split": (2, 20)},
    (CLS, "gradient boosting"): {"n_estimators": (50, 300), "max_depth": (3, 10), "learning_rate": (0.01, 0.3)},
    (CLS, "xgboost"): {"n_estimators": (50, 300), "max_depth": (3, 10), "learning_rate": (0.01, 0.3)},
    (CLS, "lgbm"): {"n_estimators": (50, 300), "max_depth": (3, 10), "learning_rate": (0.01, 0.3)},
    (REG, "ridge"): {"alpha": (0.01, 100)},
    (REG, "lasso"): {"alpha": (0.01, 100)},
    (REG, "support vector machine"): {"C": (0.1, 100), "gamma_log": (-4, 1)},
    (REG, "decision tree"): {"max_depth": (3, 20), "min_samples_split": (2, 20)},
    (REG, "random forest"): {"n_estimators": (50, 300), "max_depth": (3, 20), "min_samples_split": (2, 20)},
    (REG, "gradient boosting"): {"n_estimators": (50, 300), "max_depth": (3, 10), "learning_rate": (0.01, 0.3)},
    (REG, "xgboost"): {"n_estimators": (50, 300), "max_depth": (3, 10), "learning_rate": (0.01, 0.3)},
    (REG, "lgbm"): {"n_estimators": (50, 300), "max_depth": (3, 10), "learning_rate": (0.01, 0.3)},
}
INT_PARAMS = ("n_estimators", "max_depth", "min_samples_split")
UCB_KAPPA = 2.576


def convert(raw: dict) -> dict:
    """Integers floored, gamma searched on a log10 scale."""
    out = {}
    for k, v in raw.items():
        if k in INT_PARAMS:
            out[k] = int(v)
        elif k == "gamma_log":
            out["gamma"] = 10 ** v
        else:
            out[k] = float(v)
    return out


def cv_score(prepared: DataFrame, model: str, task: str, params: dict, folds: int = 3,
             seed: int = 42, key=None) -> float:
    """Mean k-fold score (accuracy for classification, R^2 for regression).
    Classifier folds are stratified by class; regressor folds come from a
    hash of the key (the reference's unshuffled contiguous blocks assume a
    row order a distributed frame does not have)."""
    if task == CLS:        # stratified, as k-fold scoring of a classifier is
        f = stratified_folds(prepared, "label", folds, seed, key=key, name="__fold")
    else:
        f = hash_folds(prepared, folds, seed, key=key, name="__fold")
    scores = []
    for i in range(folds):
        tr, te = f.where(F.col("__fold") != i), f.where(F.col("__fold") == i)
        m = registry.fit(tr, model, task, params)
        pred = m.transform(te)
        met = evaluate.classification_metrics(pred) if task == CLS else evaluate.regression_metrics(pred)
        want = "accuracy" if task == CLS else "r2"
        scores.append(next(r["value"] for r in met.collect() if r["metric"] == want))
    return float(np.mean(scores))


def _matern52(a: np.ndarray, b: np.ndarray, ls: float) -> np.ndarray:
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)) / ls
    return (1 + math.sqrt(5) * d + 5.0 / 3.0 * d * d) * np.exp(-math.sqrt(5) * d)


def _gp_posterior(X: np.ndarray, y: np.ndarray, C: np.ndarray):
    mu, sd = y.mean(), y.std() or 1.0
    yn = (y - mu) / sd
    best = None
    for ls in (0.05, 0.1, 0.2, 0.5, 1.0, 2.0):      # length scale by marginal likelihood
        K = _matern52(X, X, ls) + 1e-6 * np.eye(len(X))
        try:
            L = np.linalg.cholesky(K)
        except np.linalg.LinAlgError:
            continue
        a = np.linalg.solve(L.T, np.linalg.solve(L, yn))
        ll = -0.5 * yn @ a - np.log(np.diag(L)).sum()
        if best is None or ll > best[0]:
            best = (ll, ls, L, a)
    _, ls, L, a = best
    Ks = _matern52(C, X, ls)
    m = Ks @ a
    v = np.linalg.solve(L, Ks.T)
    var = np.maximum(1.0 - (v * v).sum(0), 1e-12)
    return mu + sd * m, sd * np.sqrt(var)


def propose(X: np.ndarray, y: np.ndarray, dim: int, rng: np.random.Generator, n_cand: int = 10_000) -> np.ndarray:
    C = rng.uniform(size=(n_cand, dim))
    m, s = _gp_posterior(X, y, C)
    return C[int(np.argmax(m + UCB_KAPPA * s))]


def auto_optimize(df: DataFrame, target: str, model: str, task: str, features=None, seed: int = 42,
                  init_points: int = 5, n_iter: int = 15, test_size: float = 0.2, key=None):
    """Search the reference's bounds; returns (best_params, history frame)."""
    bounds = BOUNDS.get((task, model))
    if not bounds:
        raise ValueError(f"no tuning bounds for {model} ({task})")
    keys = [key] if isinstance(key, str) else list(key or [])
    prep = registry.prepare(df, target, task, features, keep=keys)
    split_key = keys or [*prep.feature_names, target]
    train, _ = train_test_split(prep.frame, test_size, seed, key=split_key)
    train = stored(train)       # read by every fold of every evaluation
    names = list(bounds)
    lo = np.array([bounds[k][0] for k in names], dtype=float)
    hi = np.array([bounds[k][1] for k in names], dtype=float)
    rng = np.random.default_rng(seed)
    X, y, hist = [], [], []
    for it in range(init_points + n_iter):
        u = rng.uniform(size=len(names)) if it < init_points else propose(np.array(X), np.array(y), len(names), rng)
        raw = dict(zip(names, lo + u * (hi - lo)))
        params = convert(raw)
        score = cv_score(train, model, task, params, seed=seed, key=split_key)
        X.append(u)
        y.append(score)
        hist.append((it, str(params), score))
    best = int(np.argmax(y))
    best_params = convert(dict(zip(names, lo + np.array(X[best]) * (hi - lo))))
    frame = df.sparkSession.createDataFrame(hist, "iteration int, params string, score double")
    return best_params, frame
