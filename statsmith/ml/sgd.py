"""M9: stochastic-gradient linear models, trained in parallel rounds on Spark.

A round is one job.  Every task goes through its rows in chunks that fit in
memory; each chunk starts from the common weights, makes several epochs of
mini-batch steps over its own rows, and reports the average of the weights over
its last epoch; the driver averages the chunks' weights by their numbers of
rows.  The rows are dealt over the tasks anew once, and what chunks still differ
in is corrected: their steps carry the gradient of all rows less the chunk's
own, both at the weights of the round before.  At the optimum of the whole
objective the corrected steps stand still, whatever the chunks hold.  The loss and
gradient at the round's start come out of the same pass, so the objective of
every averaged model is known exactly and the best one is returned.

Losses: hinge, log_loss, modified_huber, squared_hinge, perceptron
(classification, one-vs-rest for more than two classes); squared_error,
huber, epsilon_insensitive, squared_epsilon_insensitive (regression).
Schedules: constant, optimal, invscaling, adaptive; a mini-batch makes the
step of its rows together, no longer than half the inverse of the curvature.
``max_iter`` counts epochs.  Inputs are standardised internally; weights are
reported on that scale and applied through the same transform.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.ml.features import Standardizer
from statsmith.session import shuffle_partitions, stored

CLS_LOSSES = ("hinge", "log_loss", "modified_huber", "squared_hinge", "perceptron")
REG_LOSSES = ("squared_error", "huber", "epsilon_insensitive", "squared_epsilon_insensitive")


def loss_and_grad(loss: str, s: np.ndarray, y: np.ndarray, eps: float):
    """Per-row loss and d loss / d score.  Classification y in {-1, +1}."""
    if loss == "hinge":
        z = y * s
        return np.maximum(0, 1 - z), np.where(z < 1, -y, 0.0)
    if loss == "squared_hinge":
        z = y * s
        m = np.maximum(0, 1 - z)
        return m * m, -2 * y * m
    if loss == "log_loss":
        z = y * s
        return np.logaddexp(0, -z), -y / (1 + np.exp(np.clip(z, -500, 500)))
    if loss == "modified_huber":
        z = y * s
        l = np.where(z >= 1, 0.0, np.where(z >= -1, (1 - z) ** 2, -4 * z))
        g = np.where(z >= 1, 0.0, np.where(z >= -1, -2 * y * (1 - z), -4 * y))
        return l, g
    if loss == "perceptron":
        z = y * s
        return np.maximum(0, -z), np.where(z <= 0, -y, 0.0)
    r = s - y
    if loss == "squared_error":
        return 0.5 * r * r, r
    if loss == "huber":
        a = np.abs(r)
        return np.where(a <= eps, 0.5 * r * r, eps * a - 0.5 * eps * eps), np.where(a <= eps, r, eps * np.sign(r))
    if loss == "epsilon_insensitive":
        a = np.abs(r)
        return np.maximum(0, a - eps), np.where(a > eps, np.sign(r), 0.0)
    if loss == "squared_epsilon_insensitive":
        a = np.maximum(0, np.abs(r) - eps)
        return a * a, 2 * np.sign(r) * a
    raise ValueError(f"unknown loss {loss!r}")


@dataclass
class SGDModel:
    task: str
    loss: str
    W: np.ndarray                  # K x p on standardised inputs
    b: np.ndarray                  # K
    std: Standardizer
    classes: int = 1
    n_iter: int = 0
    objective: list = field(default_factory=list)

    def scores(self, features: str = "features") -> list:
        xs = self.std.columns(features)
        out = []
        for k in range(self.W.shape[0]):
            e = F.lit(float(self.b[k]))
            for i, x in enumerate(xs):
                e = e + x * F.lit(float(self.W[k, i]))
            out.append(e)
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        sc = self.scores(features)
        if self.task == "regression":
            return df.withColumn("prediction", sc[0])
        if self.W.shape[0] == 1:
            raw = F.array(-sc[0], sc[0])
            pred = F.when(sc[0] > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        else:
            raw = F.array(*sc)
            pred = F.array_position(raw, F.array_max(raw)).cast("double") - 1.0
        out = df.withColumn("rawPrediction", raw).withColumn("prediction", pred)
        if self.loss in ("log_loss", "modified_huber"):
            if self.loss == "log_loss":
                pk = [1 / (1 + F.exp(-s)) for s in sc]
            else:
                pk = [(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0)) + 1) / 2 for s in sc]
            if len(pk) == 1:
                prob = F.array(1 - pk[0], pk[0])
            else:
                tot = sum(pk[1:], pk[0])
                prob = F.array(*[F.coalesce(F.try_divide(p, tot), F.lit(1.0 / len(pk))) for p in pk])
            out = out.withColumn("probability", prob)
        return out


BATCH = 32                            # rows of a mini-batch
CHUNK_CELLS = 4_000_000               # numbers of a chunk held by a task (32 MB)
STALE_ROUNDS = 3                      # rounds without a gain before the descent stops
FIRST_EPOCHS = 5                      # epochs of a round; doubled after every fourth round


def fit_sgd(df: DataFrame, task: str, features: str = "features", label: str = "label",
            loss: str | None = None, penalty: str = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15,
            learning_rate: str | None = None, eta0: float | None = None, power_t: float = 0.25,
            max_iter: int = 1000, tol: float | None = 1e-3, n_iter_no_change: int = 5,
            epsilon: float = 0.1, fit_intercept: bool = True, n_classes: int | None = None,
            random_state: int = 42) -> SGDModel:
    if task == "classification":
        loss = loss or "hinge"
        learning_rate = learning_rate or "optimal"
        if loss not in CLS_LOSSES:
            raise ValueError(f"classification loss must be one of {CLS_LOSSES}")
    else:
        loss = loss or "squared_error"
        learning_rate = learning_rate or "invscaling"
        if loss not in REG_LOSSES:
            raise ValueError(f"regression loss must be one of {REG_LOSSES}")
    if penalty not in ("l2", "l1", "elasticnet", None, "None"):
        raise ValueError("penalty must be l2, l1, elasticnet or None")
    if learning_rate not in ("constant", "optimal", "invscaling", "adaptive"):
        raise ValueError("learning_rate must be constant, optimal, invscaling or adaptive")
    if int(max_iter) < 1:
        raise ValueError("max_iter must be at least 1")
    eta0 = 0.01 if eta0 is None else eta0
    std = Standardizer.fit(df, features)
    p = len(std.mean)
    K = 1
    if task == "classification":
        n_classes = n_classes or int(df.agg(F.max(label)).first()[0]) + 1
        K = 1 if n_classes <= 2 else n_classes
    y_mean, y_scale = 0.0, 1.0
    if task != "classification":
        # fit on a standardised target (well-conditioned steps), map back after;
        # losses growing linearly in the residual rescale epsilon and alpha
        r = df.agg(F.avg(label), F.stddev_pop(label)).first()
        y_mean, y_scale = float(r[0] or 0.0), float(r[1] or 1.0) or 1.0
        epsilon = epsilon / y_scale
        if loss in ("epsilon_insensitive", "huber"):
            alpha = alpha * y_scale
    yc = (F.col(label).cast("double") - F.lit(y_mean)) / F.lit(y_scale)
    # dealt anew once, so that chunks resemble each other also where the table is sorted; read once a round
    data = stored(df.select(F.array(*std.columns(features)).alias("x"), yc.alias("y")).repartition(shuffle_partitions(df.sparkSession)))
    l2 = alpha * (1 - l1_ratio) if penalty == "elasticnet" else (alpha if penalty == "l2" else 0.0)
    l1 = alpha * l1_ratio if penalty == "elasticnet" else (alpha if penalty == "l1" else 0.0)
    t0 = 0.0
    if learning_rate == "optimal":
        typw = np.sqrt(1.0 / np.sqrt(alpha))
        _, g0 = loss_and_grad(loss, np.array([-typw]), np.array([1.0]), epsilon)
        t0 = 1.0 / (typw / max(1.0, abs(float(g0[0]))) * alpha)
    plan = dict(loss=loss, epsilon=epsilon, task=task, l2=l2, l1=l1, rate=learning_rate, power_t=power_t, alpha=alpha, t0=t0,
                intercept=fit_intercept, seed=int(random_state), p=p, K=K)
    w = np.zeros(K * (p + 1))                                  # weights, then intercepts
    before, pull = w, None                                     # weights of the last round, gradient of all rows there
    best, best_w, bad, eta, stale, history, done, rounds = np.inf, w, 0, eta0, 0, [], 0, 0
    while True:
        epochs = min(int(max_iter) - done, FIRST_EPOCHS * 2 ** (rounds // 4))
        n, lossv, grad, mean = _round(data, w, before, pull, epochs, done, eta, plan)
        W = w[:K * p]
        obj = lossv + 0.5 * l2 * float((W * W).sum()) + l1 * float(np.abs(W).sum())
        history.append(obj)
        bad = 0 if obj < best - (tol or 0.0) else bad + epochs
        stale = 0 if bad == 0 else stale + 1
        if obj < best:
            best, best_w = obj, w
        if n == 0 or epochs == 0:
            break
        # the correction is a round late, so every other round moves little
        if tol is not None and bad >= n_iter_no_change and stale >= STALE_ROUNDS:
            if learning_rate != "adaptive" or eta <= 1e-6:
                break
            eta, bad, stale = eta / 5.0, 0, 0
        before, pull, w = w, grad, mean
        done, rounds = done + epochs, rounds + 1
    W, b = best_w[:K * p].reshape(K, p), best_w[K * p:]
    if task != "classification":
        W, b = W * y_scale, b * y_scale + y_mean
    return SGDModel(task, loss, W, b, std, classes=max(K, 2) if task == "classification" else 1,
                    n_iter=done, objective=history)


def _gradient(X: np.ndarray, Y: np.ndarray, w: np.ndarray, plan: dict):
    """(summed loss, mean gradient) of rows; ``Y`` has a column for each class."""
    p, K = plan["p"], plan["K"]
    lv, g = loss_and_grad(plan["loss"], X @ w[:K * p].reshape(K, p).T + w[K * p:], Y, plan["epsilon"])
    return float(lv.sum()), np.concatenate([(g.T @ X).ravel(), g.sum(axis=0) * plan["intercept"]]) / len(X)


def _local(X: np.ndarray, Y: np.ndarray, w: np.ndarray, shift: np.ndarray, epochs: int, done: int, eta: float, plan: dict):
    """Average weights of the last of ``epochs`` passes over one chunk."""
    p, K, n = plan["p"], plan["K"], len(X)
    rng = np.random.default_rng(plan["seed"] + done)
    longest = 0.5 / (p + 1)                                    # half the inverse curvature on standardised inputs
    inner = np.arange(len(w)) < K * p
    total, steps, t = np.zeros_like(w), 0, done * n
    for e in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            at = order[i:i + BATCH]
            if plan["rate"] == "invscaling":
                rate = eta / (t + 1) ** plan["power_t"]
            elif plan["rate"] == "optimal":
                rate = 1.0 / (plan["alpha"] * (plan["t0"] + t))
            else:
                rate = eta
            step = min(rate * len(at), longest)
            w = w - step * (_gradient(X[at], Y[at], w, plan)[1] + shift + plan["l2"] * w * inner)
            if plan["l1"]:
                w = np.where(inner, np.sign(w) * np.maximum(0.0, np.abs(w) - step * plan["l1"]), w)
            t += len(at)
            if e == epochs - 1:
                total, steps = total + w, steps + 1
    return total / steps if steps else w


def _round(data: DataFrame, w: np.ndarray, before: np.ndarray, pull, epochs: int, done: int, eta: float, plan: dict):
    """One job: (rows, mean loss and gradient at ``w``, averaged new weights).
    Weights travel in the task closure; 2 + 2 K (p + 1) numbers come back."""
    p, K = plan["p"], plan["K"]
    size = max(BATCH, CHUNK_CELLS // (p + K + 1))

    def chunk(parts):
        X = np.concatenate([x for x, _ in parts])
        y = np.concatenate([v for _, v in parts])
        Y = y[:, None]
        if plan["task"] == "classification":
            Y = np.where(Y == (np.arange(K) if K > 1 else 1.0), 1.0, -1.0)
        loss, grad = _gradient(X, Y, w, plan)
        shift = np.zeros_like(w) if pull is None else pull - _gradient(X, Y, before, plan)[1]
        mean = _local(X, Y, w, shift, epochs, done, eta, plan)
        return np.concatenate([[len(X), loss], grad * len(X), mean * len(X)])

    def run(batches):
        total, parts, n = np.zeros(2 + 2 * len(w)), [], 0
        for bt in batches:
            X = bt.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y = bt.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(y), size):
                parts.append((X[lo:lo + size], y[lo:lo + size]))
                n += len(parts[-1][1])
                if n >= size:
                    total += chunk(parts)
                    parts, n = [], 0
        if n:
            total += chunk(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    got = np.zeros(2 + 2 * len(w))
    for r in data.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        got[r["i"]] = r["v"]
    n = int(got[0])
    scale = max(1, n)
    return n, got[1] / scale, got[2:2 + len(w)] / scale, got[2 + len(w):] / scale
