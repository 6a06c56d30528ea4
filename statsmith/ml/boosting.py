"""Second-order boosted trees on binned features.

Every round fits one tree a class to the gradient and hessian of the loss.
Rows are kept in blocks: the features as one byte each (the number of a
quantile bin, 255 for a missing value), the label, and the margins so far.  One
job adds up, for a set of open nodes, the sums of gradient, hessian and rows in
every bin of every feature, in groups of tasks; the driver, which gets nodes x
features x bins numbers a few times, picks the splits.  A leaf weighs ``-G / (H + lambda)``; a split gains
``(GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda)) / 2 - gamma``; rows
without a value go to the side that gains more, learned at each split.  Only
the smaller child of a split is counted, the other is its parent less it.

Trees grow level by level to a depth (``grow="depth"``) or leaf by leaf, the
leaf of the greatest gain first, to a number of leaves (``grow="leaf"``).
One-sided sampling by gradient keeps the rows of the largest gradients and a
weighted part of the others in each block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.session import stored

MISSING = 255                         # bin of a row without a value
BLOCK_ROWS = 16_384                   # rows of a stored block
JOB_CELLS = 250_000                   # nodes x features x bins counted by one job, about
FAN_IN = 32                           # partial sums that one task, or the driver, adds up
STORE_EVERY = 10                      # rounds after which the margins are stored


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1.  ``cut``: the last bin that goes left."""
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for x, v in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value)):
            x.append(v)
        return len(self.value) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row (features x rows of bins) ends."""
        feature, cut, missing = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(bins.shape[1], np.int64)
        open_ = np.flatnonzero(feature[at] >= 0)
        while len(open_):
            node = at[open_]
            b = bins[feature[node], open_]
            go = np.where(b == MISSING, missing[node], b <= cut[node])
            at[open_] = np.where(go, left[node], right[node])
            open_ = open_[feature[at[open_]] >= 0]
        return at


def gradients(task: str, y: np.ndarray, margin: np.ndarray):
    """(gradient, hessian), rows x outputs, of half the squared error, the
    logistic and the multinomial loss."""
    if task == "regression":
        return margin - y[:, None], np.ones_like(margin)
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin))
        return p - y[:, None], p * (1 - p)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(margin.shape[1])), 2 * p * (1 - p)


def quantile_edges(df: DataFrame, p: int, max_bins: int) -> list[np.ndarray]:
    """Inner edges of at most ``max_bins`` bins for each feature, one pass: a
    value belongs to the number of edges below it.  Edges lie halfway between
    quantiles, so every distinct value has its own bin where there are few."""
    a = vector_to_array(F.col("features"))
    probs = [i / max_bins for i in range(max_bins + 1)]
    x = [F.when(~F.isnan(a[i]), a[i]) for i in range(p)]
    row = df.agg(*[F.percentile_approx(c, probs, 20 * max_bins).alias(f"q{i}") for i, c in enumerate(x)]).first()
    out = []
    for i in range(p):
        q = np.unique(np.array(row[f"q{i}"] or [], float))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def binned(X: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Features x rows of bins."""
    out = np.empty((X.shape[1], X.shape[0]), np.uint8)
    for i, e in enumerate(edges):
        out[i] = np.where(np.isnan(X[:, i]), MISSING, np.searchsorted(e, X[:, i], "left"))
    return out


def _block(b: pa.RecordBatch, i: int, p: int, k: int):
    bins = np.frombuffer(b.column(0)[i].as_buffer(), np.uint8).reshape(p, -1)
    return bins, np.frombuffer(b.column(1)[i].as_buffer(), float), np.frombuffer(b.column(2)[i].as_buffer(), float).reshape(-1, k)


def _blocks(df: DataFrame, edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    p = len(edges)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                X = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                y = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                margin = np.tile(base, (len(y), 1))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (binned(X, edges), y, margin)],
                                                 names=["bins", "y", "margin"])

    rows = df.select(vector_to_array(F.col("features")).alias("x"), F.col("label").cast("double").alias("y"))
    return stored(rows.mapInArrow(run, "bins binary, y binary, margin binary"))


def _with_trees(blocks: DataFrame, trees: list[Tree], p: int) -> DataFrame:
    """The blocks with the trees' values (one tree an output) added."""
    k = len(trees)

    def run(batches):
        for b in batches:
            new = []
            for i in range(b.num_rows):
                bins, _, margin = _block(b, i, p, k)
                new.append((margin + np.stack([np.array(t.value)[t.leaves(bins)] for t in trees], axis=1)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.binary())], names=["bins", "y", "margin"])

    return blocks.mapInArrow(run, "bins binary, y binary, margin binary")


def _sums(blocks: DataFrame, trees: list[Tree], wanted: list[tuple[int, int]], task: str, p: int, width: int, parts: int, sampling, seed: int):
    """One job: array (node, feature, bin, [gradient, hessian, rows]) for the
    wanted nodes (output, node)."""
    k = len(trees)
    cells = len(wanted) * p * width
    if not any(t.value for t in trees):
        trees = [Tree([-1], [0], [False], [-1], [-1], [0.0]) for _ in trees]          # roots

    def run(batches):
        total = np.zeros((3, cells))
        for b in batches:
            for i in range(b.num_rows):
                bins, y, margin = _block(b, i, p, k)
                g, h = gradients(task, y, margin)
                weight = np.ones(len(y))
                if sampling:
                    weight = _one_sided(np.abs(g).sum(axis=1), *sampling, np.random.default_rng([seed, len(y), int(bins[:, 0].sum())]))
                for out, tree in enumerate(trees):
                    place = np.full(len(tree.value), -1)
                    for n, (o, node) in enumerate(wanted):
                        if o == out:
                            place[node] = n
                    if (place < 0).all():
                        continue
                    node = place[tree.leaves(bins)]
                    rows = np.flatnonzero((node >= 0) & (weight > 0))
                    w, gw, hw = weight[rows], g[rows, out] * weight[rows], h[rows, out] * weight[rows]
                    for f in range(p):
                        code = bins[f, rows].astype(np.int64)
                        code = (node[rows] * p + f) * width + np.where(code == MISSING, width - 1, code)
                        for s, v in enumerate((gw, hw, w)):
                            total[s] += np.bincount(code, v, cells)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches):
        total = np.zeros(3 * cells)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_buffer(), float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    part = blocks.mapInArrow(run, "sums binary")
    while parts > FAN_IN:                                      # summed on the executors until few are left
        parts = -(-parts // FAN_IN)
        part = part.repartition(parts).mapInArrow(add, "sums binary")
    out = np.zeros(3 * cells)
    for r in part.collect():                                   # ``FAN_IN`` arrays of ``JOB_CELLS`` cells at most
        out += np.frombuffer(r["sums"], float)
    return np.moveaxis(out.reshape(3, len(wanted), p, width), 0, -1)


def _one_sided(size: np.ndarray, top: float, other: float, rng) -> np.ndarray:
    """Weights of rows: the ``top`` share of largest gradients 1, of the others
    a share drawn at random with the weight that keeps their sum."""
    n = len(size)
    first = np.argsort(-size, kind="stable")
    big = int(np.ceil(top * n))
    weight = np.zeros(n)
    weight[first[:big]] = 1
    rest = first[big:]
    take = rng.random(len(rest)) < other / max(1e-12, 1 - top)
    weight[rest[take]] = (1 - top) / other
    return weight


def best_split(cells: np.ndarray, reg_lambda: float, gamma: float, min_weight: float, min_rows: float):
    """(gain, feature, cut, missing left, sums left, sums right) of one node's
    (feature, bin, sums) array, whose last bin is the missing values; None
    without a split that gains."""
    inside, missing = cells[:, :-1], cells[:, -1]
    total = cells[0].sum(axis=0)
    run = np.cumsum(inside, axis=1)[:, :-1]
    if not run.size:
        return None
    best = None
    score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + reg_lambda, 1e-300)
    for to_left in (True, False):
        left = run + missing[:, None] if to_left else run
        right = total - left
        gain = (score(left) + score(right) - score(total)) / 2 - gamma
        ok = (np.minimum(left[..., 1], right[..., 1]) >= min_weight) & (np.minimum(left[..., 2], right[..., 2]) >= max(min_rows, 1e-9))
        gain = np.where(ok, gain, -np.inf)
        f, c = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, c] > 1e-12 and (best is None or gain[f, c] > best[0] + 1e-12):
            best = float(gain[f, c]), int(f), int(c), to_left, left[f, c], right[f, c]
    return best


@dataclass
class BoostedModel:
    task: str
    classes: int
    base: np.ndarray
    edges: list[np.ndarray]
    trees: list[list[Tree]]               # round -> a tree an output
    gain: np.ndarray                      # total gain of each feature
    history: list[float] = field(default_factory=list)

    @property
    def featureImportances(self):  # noqa: N802 - the name Spark's tree models use
        g = self.gain / self.gain.sum() if self.gain.sum() else self.gain
        return type("Importances", (), {"toArray": lambda _: g})()

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``prediction`` and, for classes, ``rawPrediction`` and ``probability``."""
        edges, trees, base = self.edges, self.trees, self.base

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            bins = binned(np.stack(x.to_numpy()).astype(float), edges)
            out = np.tile(base, (bins.shape[1], 1))
            for each in trees:
                for o, t in enumerate(each):
                    out[:, o] += np.array(t.value)[t.leaves(bins)]
            return pd.Series(list(out))

        m = margins(vector_to_array(F.col(features)))
        if self.task == "regression":
            return df.withColumn("prediction", m[0])
        out = df.withColumn("rawPrediction", m)
        raw = F.col("rawPrediction")
        if self.classes <= 2:
            p = 1 / (1 + F.exp(-raw[0]))
            return (out.withColumn("probability", F.array(1 - p, p)).withColumn("rawPrediction", F.array(-raw[0], raw[0]))
                    .withColumn("prediction", (F.col("rawPrediction")[1] > 0).cast("double")))
        e = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        return (out.withColumn("probability", F.transform(e, lambda v: v / total))
                .withColumn("prediction", F.array_position(raw, F.array_max(raw)).cast("double") - 1.0))


def fit_boosted(df: DataFrame, task: str, n_classes: int = 1, rounds: int = 100, rate: float = 0.3, grow: str = "depth",
                max_depth: int | None = 6, max_leaves: int | None = None, reg_lambda: float = 1.0, gamma: float = 0.0,
                min_child_weight: float = 1.0, min_child_samples: int = 0, max_bins: int = 255,
                top_rate: float | None = None, other_rate: float = 0.1, seed: int = 42) -> BoostedModel:
    """Fit on a frame of ``features`` (vector; NaN is missing) and ``label``.

    ``top_rate`` turns one-sided sampling on.  A feature without values, or of
    one value, is never split.  An empty frame raises."""
    if not 2 <= max_bins <= 255 or grow not in ("depth", "leaf"):
        raise ValueError("max_bins must be 2 to 255, grow 'depth' or 'leaf'")
    first = df.select("features").first()
    if first is None:
        raise ValueError("no rows to fit")
    p = len(first[0])
    edges = quantile_edges(df, p, max_bins)
    width = max(len(e) for e in edges) + 2                     # bins of the widest feature, and missing values
    if task == "regression":
        base = np.array([df.agg(F.avg("label")).first()[0]], float)
    elif n_classes <= 2:
        share = float(df.agg(F.avg("label")).first()[0])
        share = min(max(share, 1e-6), 1 - 1e-6)
        base = np.array([np.log(share / (1 - share))])
    else:
        base = np.zeros(n_classes)
    blocks = _blocks(df, edges, base)
    sampling = (float(top_rate), float(other_rate)) if top_rate else None
    model = BoostedModel(task, n_classes, base, edges, [], np.zeros(p))
    at_once = max(1, JOB_CELLS // (p * width))
    parts = blocks.rdd.getNumPartitions()
    stale = None
    for r in range(rounds):
        blocks = blocks.persist()                              # recomputed from the last stored margins if lost
        trees = [Tree() for _ in base]
        limits = dict(reg_lambda=reg_lambda, gamma=gamma, min_weight=min_child_weight, min_rows=min_child_samples)

        def count(nodes, trees=trees, blocks=blocks, r=r):
            return np.concatenate([_sums(blocks, trees, nodes[i:i + at_once], task, p, width, parts, sampling, seed + r)
                                   for i in range(0, len(nodes), at_once)])

        growth = _Growth(trees, max_depth, max_leaves, limits)
        growth.begin(count([(o, 0) for o in range(len(trees))]))
        if stale is not None:
            stale.unpersist()                                  # these blocks are held now
        while wanted := growth.expand(grow):
            growth.learn(wanted, count(wanted))
        model.gain += growth.finish(rate, reg_lambda, p)
        model.trees.append(trees)
        stale, blocks = blocks, _with_trees(blocks, trees, p)
        if (r + 1) % STORE_EVERY == 0 and r + 1 < rounds:
            blocks = stored(blocks)
    if stale is not None:
        stale.unpersist()
    return model


class _Growth:
    """The trees of one round while they grow.

    Nodes are (output, number).  A node is expanded when its children's cells
    are known; leaf by leaf, all open leaves that may still be split are
    expanded by one job, also those that in the end stay leaves."""

    def __init__(self, trees: list[Tree], max_depth, max_leaves, limits: dict):
        self.trees, self.max_depth, self.max_leaves, self.limits = trees, max_depth, max_leaves, limits
        self.cells, self.split, self.kids, self.sums, self.depth = {}, {}, {}, {}, {}
        self.parent: dict = {}

    def _know(self, node, cells, depth) -> None:
        self.depth[node] = depth
        self.sums[node] = cells[0].sum(axis=0)
        deep = self.max_depth is not None and depth >= self.max_depth
        self.split[node] = None if deep else best_split(cells, **self.limits)
        if self.split[node] is not None:
            self.cells[node] = cells

    def begin(self, cells) -> None:
        for o, c in enumerate(cells):
            self.trees[o].add(0.0)
            self._know((o, 0), c, 0)

    def chosen(self, output: int, grow: str):
        """(splits taken so far in best-first order, nodes to expand next)."""
        leaves, taken = [(output, 0)], []
        while True:
            open_ = [n for n in leaves if self.split[n] is not None]
            full = self.max_leaves is not None and len(leaves) >= self.max_leaves
            if not open_ or full:
                return taken, []
            if grow == "depth" and (new := [n for n in open_ if n not in self.kids]):
                return taken, new
            n = max(open_, key=lambda x: (self.split[x][0], -x[1]))
            last = self.max_leaves is not None and len(leaves) + 1 >= self.max_leaves
            if n not in self.kids and not last:
                left = len(open_) if self.max_leaves is None else self.max_leaves - len(leaves)
                best = sorted((x for x in open_ if x not in self.kids), key=lambda x: (-self.split[x][0], x[1]))
                return taken, best[:left]
            taken.append(n)
            leaves.remove(n)
            if last:
                return taken, []
            leaves += self.kids[n]

    def _open(self, n) -> tuple:
        o, node = n
        tree, (_, f, c, to_left, _, _) = self.trees[o], self.split[n]
        tree.feature[node], tree.cut[node], tree.missing_left[node] = f, c, to_left
        tree.left[node], tree.right[node] = tree.add(0.0), tree.add(0.0)
        self.kids[n] = (o, tree.left[node]), (o, tree.right[node])
        return self.kids[n]

    def expand(self, grow: str) -> list:
        """The smaller child of every node to be expanded."""
        out = []
        for o in range(len(self.trees)):
            for n in self.chosen(o, grow)[1]:
                kids = self._open(n)
                one = kids[0] if self.split[n][4][2] <= self.split[n][5][2] else kids[1]
                self.parent[one] = n
                out.append(one)
        return out

    def learn(self, nodes: list, cells) -> None:
        for one, c in zip(nodes, cells, strict=True):
            n = self.parent[one]
            other = next(k for k in self.kids[n] if k != one)
            whole = self.cells.pop(n)
            self._know(one, c, self.depth[n] + 1)
            self._know(other, whole - c, self.depth[n] + 1)

    def finish(self, rate: float, reg_lambda: float, p: int) -> np.ndarray:
        """Sets the leaves' values, undoes splits that were not taken; gains by feature."""
        gain = np.zeros(p)
        for o, tree in enumerate(self.trees):
            taken = self.chosen(o, "leaf")[0]
            for n in taken:
                gain[self.split[n][1]] += self.split[n][0]
                for kid, s in zip(self.kids.get(n) or self._open(n), self.split[n][4:], strict=True):
                    self.sums[kid] = s
            for node in range(len(tree.value)):
                if (o, node) not in taken:
                    tree.feature[node] = -1
                    total = self.sums.get((o, node))
                    if total is not None and total[1] + reg_lambda > 0:
                        tree.value[node] = float(-rate * total[0] / (total[1] + reg_lambda))
        return gain
