"""Model registry and the train/evaluate path.

``train_model`` = choose features -> label-encode string features ->
exact hash split -> fit the chosen model on the training part ->
predict the test part -> metrics.  Parameters use the reference's
(scikit-learn style) names and are converted so the fitted objective is the
same where Spark has the algorithm (see ``_convert``); unknown parameters
raise instead of leaking between models.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statsmith.functions.columns import TMP, require_columns
from statsmith.ml import evaluate
from statsmith.ml.boosting import fit_boosted
from statsmith.ml.features import RandomFourier, Standardizer, with_rff
from statsmith.ml.sgd import fit_sgd
from statsmith.ml.split import train_test_split
from statsmith.operators.encode import encode_strings
from statsmith.session import stored

CLS, REG = "classification", "regression"

# Model names offered by the reference and the tasks each supports.
MODEL_TASKS = {
    "linear regression": (REG,),
    "ridge": (REG,),
    "lasso": (REG,),
    "logistic regression": (CLS,),
    "support vector machine": (CLS, REG),
    "decision tree": (CLS, REG),
    "random forest": (CLS, REG),
    "stochastic gradient descent": (CLS, REG),
    "gradient boosting": (CLS, REG),
    "xgboost": (CLS, REG),
    "lgbm": (CLS, REG),
    "gaussian process": (CLS, REG),
}

ALLOWED = {
    "linear regression": {"fit_intercept"},
    "ridge": {"alpha", "fit_intercept"},
    "lasso": {"alpha", "fit_intercept", "max_iter", "tol"},
    "logistic regression": {"C", "max_iter", "fit_intercept", "penalty", "l1_ratio", "tol"},
    "support vector machine": {"C", "kernel", "gamma", "epsilon", "n_components", "random_state", "max_iter"},
    "decision tree": {"max_depth", "min_samples_split", "random_state"},
    "random forest": {"n_estimators", "max_depth", "min_samples_split", "random_state", "max_features"},
    "stochastic gradient descent": {"loss", "penalty", "alpha", "l1_ratio", "learning_rate", "eta0",
                                    "power_t", "max_iter", "tol", "n_iter_no_change", "epsilon",
                                    "fit_intercept", "random_state"},
    "gradient boosting": {"n_estimators", "max_depth", "learning_rate", "random_state"},
    "xgboost": {"engine", "n_estimators", "max_depth", "learning_rate", "random_state", "reg_lambda", "gamma", "min_child_weight",
                "max_bin"},
    "lgbm": {"engine", "n_estimators", "max_depth", "learning_rate", "random_state", "num_leaves", "reg_lambda", "min_split_gain",
             "min_child_weight", "min_child_samples", "max_bin", "top_rate", "other_rate"},
    "gaussian process": {"length_scale", "n_components", "alpha", "random_state"},
}

# Library defaults the reference inherits (depth None = unbounded
# maps to Spark's maximum of 30).
BOOST_DEFAULTS = {"gradient boosting": (100, 3, 0.1, 32), "xgboost": (100, 6, 0.3, 32),
                  "lgbm": (100, 5, 0.1, 255)}
# what only the second-order engine takes (``engine="second_order"``)
SECOND_ORDER = {"reg_lambda", "gamma", "min_child_weight", "max_bin", "num_leaves", "min_split_gain", "min_child_samples",
                "top_rate", "other_rate"}
# the models that learn a side for missing values
TAKES_MISSING = ("xgboost", "lgbm")
MAX_DEPTH = 30


def _depth(depth) -> int:
    """The tree depth asked for; a deeper tree than Spark grows is refused."""
    if int(depth) > MAX_DEPTH:
        raise ValueError(f"max_depth can be {MAX_DEPTH} at most")
    return int(depth)


# The models whose feature importances are reported.
IMPORTANCE_MODELS = ("random forest", "gradient boosting", "xgboost", "lgbm")
# Deep trees: keep each row's node id (no re-walk of the tree per level),
# split more nodes per pass over the data, and cut the node-id lineage.
_TREE_SPEED = dict(cacheNodeIds=True, maxMemoryInMB=512, checkpointInterval=10)
# The models whose solver keeps its own form of all training rows and reads it again and again.
ITERATED = ("logistic regression", "support vector machine", "decision tree", "random forest",
            "gradient boosting", "xgboost", "lgbm", "gaussian process")
SPREAD_ROWS = 20_000                  # training rows that stay in the partitions they come in
TASK_BYTES = 256 << 20                # bytes of kept rows of a task


@dataclass
class Prepared:
    frame: DataFrame            # features vector, label, plus key columns
    feature_names: list[str]
    task: str
    label_classes: list[str] | None


@dataclass
class TrainedModel:
    name: str
    task: str
    model: object
    predictions: DataFrame
    metrics: DataFrame
    feature_names: list[str]
    label_classes: list[str] | None = None
    params: dict = field(default_factory=dict)

    def feature_importance(self, top: int = 20):
        """Top-``top`` importances for the ensemble models the reference
        reports them for; None for every other model."""
        if self.name not in IMPORTANCE_MODELS:
            return None
        inner = getattr(self.model, "inner", self.model)
        return evaluate.feature_importance(inner, self.feature_names, top)


def prepare(df: DataFrame, target: str, task: str, features: list[str] | None = None,
            keep: list[str] = (), missing: str = "error") -> Prepared:
    """Features (default: all but the target), string-like features
    label-encoded (codes fitted on all rows, as the reference does),
    booleans as 0/1, label indexed for classification.  A missing value raises,
    or with ``missing="keep"`` becomes NaN, for models that take it."""
    if task not in (CLS, REG):
        raise ValueError("task must be 'classification' or 'regression'")
    require_columns(df, [target])
    feats = list(features) if features else [c for c in df.columns if c != target]
    if not feats:
        raise ValueError("choose at least one feature")
    require_columns(df, feats)
    types = {f.name: f.dataType for f in df.schema.fields}
    textual = [c for c in feats if not isinstance(types[c], (T.NumericType, T.BooleanType))]
    keep = [k for k in keep if k not in feats and k != target]
    base = df.select(*feats, target, *keep)
    for c in textual:
        if not isinstance(types[c], T.StringType):
            base = base.withColumn(c, F.col(c).cast("string"))
    enc = encode_strings(base, textual) if textual else base
    enc = enc.select(*[F.col(c).cast("double").alias(c) for c in feats], target, *keep)
    classes = None
    if task == CLS:
        idx = StringIndexer(inputCol=TMP + "lab", outputCol="label", stringOrderType="alphabetAsc",
                            handleInvalid="error")
        enc = enc.withColumn(TMP + "lab", F.col(target).cast("string"))
        im = idx.fit(enc)
        classes = list(im.labels)
        enc = im.transform(enc).drop(TMP + "lab")
    else:
        enc = enc.withColumn("label", F.col(target).cast("double"))
    va = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid=missing)
    out = va.transform(enc)
    if textual:
        # the label-encoding joins would otherwise rerun for every consumer
        # (row count, split threshold, train part, test part): store once
        out = stored(out)
    return Prepared(out, feats, task, classes)


class _RFFModel:
    """Standardise -> random Fourier features -> inner linear model."""

    def __init__(self, std, rff, inner):
        self.std, self.rff, self.inner = std, rff, inner

    def transform(self, df):
        return self.inner.transform(with_rff(df, self.std, self.rff))


def _together(train: DataFrame, rows: int, name: str, params: dict, width: int, n_classes: int) -> int:
    """Classes fitted at once: each keeps its own copy of all rows, and copies
    of ``TASK_BYTES`` a core are kept together."""
    room = TASK_BYTES * train.sparkSession.sparkContext.defaultParallelism
    return max(1, min(n_classes, 8, room // max(1, rows * _row_bytes(name, params, width))))


def _convert(name: str, task: str, params: dict, train: DataFrame, n_classes: int):
    """Build and fit the model for ``name`` x ``task`` on ``train``."""
    bad = set(params) - ALLOWED[name]
    if bad:
        raise ValueError(f"parameters {sorted(bad)} do not apply to {name}")
    if task not in MODEL_TASKS[name]:
        raise ValueError(f"{name} is not available for {task}")
    seed = int(params.get("random_state", 42))
    fi = bool(params.get("fit_intercept", True))
    if name in ("linear regression", "ridge", "lasso"):
        n = train.count()
        if name == "linear regression":
            est = LinearRegression(regParam=0.0, solver="normal", fitIntercept=fi)
        elif name == "ridge":
            sy = train.agg(F.stddev_pop("label")).first()[0] or 1.0
            est = LinearRegression(elasticNetParam=0.0, standardization=False, solver="normal",
                                   regParam=float(params.get("alpha", 1.0)) * sy / n, fitIntercept=fi)
        else:
            est = LinearRegression(elasticNetParam=1.0, standardization=False,
                                   regParam=float(params.get("alpha", 1.0)), fitIntercept=fi,
                                   maxIter=int(params.get("max_iter", 1000)), tol=float(params.get("tol", 1e-4)))
        return est.fit(train)
    if name == "logistic regression":
        n = train.count()
        pen = params.get("penalty", "l2")
        C = float(params.get("C", 1.0))
        kinds = {"l2": 0.0, "l1": 1.0, "elasticnet": float(params.get("l1_ratio", 0.5)), None: 0.0, "None": 0.0}
        if pen not in kinds:
            raise ValueError(f"penalty must be one of {list(kinds)}")
        enet = kinds[pen]
        reg = 0.0 if pen in (None, "None") else 1.0 / (C * n)
        est = LogisticRegression(regParam=reg, elasticNetParam=enet, standardization=False,
                                 maxIter=int(params.get("max_iter", 1000)), fitIntercept=fi,
                                 tol=float(params.get("tol", 1e-4)))
        return est.fit(train)
    if name == "decision tree":
        depth = _depth(params.get("max_depth") or MAX_DEPTH)
        mins = max(1, int(params.get("min_samples_split", 2)) // 2)
        cls = DecisionTreeClassifier if task == CLS else DecisionTreeRegressor
        return cls(maxDepth=depth, minInstancesPerNode=mins, seed=seed, **_TREE_SPEED).fit(train)
    if name == "random forest":
        depth = _depth(params.get("max_depth") or MAX_DEPTH)
        mins = max(1, int(params.get("min_samples_split", 2)) // 2)
        trees = int(params.get("n_estimators", 100))
        if task == CLS:
            est = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=mins,
                                         featureSubsetStrategy=params.get("max_features", "sqrt"), seed=seed,
                                         **_TREE_SPEED)
        else:
            est = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=mins,
                                        featureSubsetStrategy=params.get("max_features", "all"), seed=seed,
                                        **_TREE_SPEED)
        return est.fit(train)
    second = params.get("engine") == "second_order"
    if params.get("engine") not in (None, "gbt", "second_order"):
        raise ValueError("engine must be 'gbt' or 'second_order'")
    if not second and set(params) & SECOND_ORDER:
        raise ValueError(f"parameters {sorted(set(params) & SECOND_ORDER)} need engine='second_order'")
    if name == "xgboost" and second:
        return fit_boosted(train, task, n_classes, rounds=int(params.get("n_estimators", 100)),
                           rate=float(params.get("learning_rate", 0.3)), grow="depth", max_depth=int(params.get("max_depth", 6)),
                           reg_lambda=float(params.get("reg_lambda", 1.0)), gamma=float(params.get("gamma", 0.0)),
                           min_child_weight=float(params.get("min_child_weight", 1.0)), max_bins=int(params.get("max_bin", 255)),
                           seed=seed)
    if name == "lgbm" and second:
        depth = int(params.get("max_depth", -1))
        top = params.get("top_rate")
        return fit_boosted(train, task, n_classes, rounds=int(params.get("n_estimators", 100)),
                           rate=float(params.get("learning_rate", 0.1)), grow="leaf", max_depth=None if depth <= 0 else depth,
                           max_leaves=int(params.get("num_leaves", 31)), reg_lambda=float(params.get("reg_lambda", 0.0)),
                           gamma=float(params.get("min_split_gain", 0.0)),
                           min_child_weight=float(params.get("min_child_weight", 1e-3)),
                           min_child_samples=int(params.get("min_child_samples", 20)), max_bins=int(params.get("max_bin", 255)),
                           top_rate=None if top is None else float(top), other_rate=float(params.get("other_rate", 0.1)), seed=seed)
    if name in BOOST_DEFAULTS:
        it, depth, rate, bins = BOOST_DEFAULTS[name]
        it = int(params.get("n_estimators", it))
        depth = _depth(params.get("max_depth", depth))
        rate = float(params.get("learning_rate", rate))
        if task == CLS:
            gbt = GBTClassifier(maxIter=it, maxDepth=depth, stepSize=rate, maxBins=bins, seed=seed)
            est = gbt if n_classes <= 2 else OneVsRest(classifier=gbt, parallelism=min(n_classes, 8))
        else:
            est = GBTRegressor(maxIter=it, maxDepth=depth, stepSize=rate, maxBins=bins, seed=seed)
        return est.fit(train)
    if name == "stochastic gradient descent":
        kw = {k: v for k, v in params.items()}
        return fit_sgd(train, task, n_classes=n_classes, **kw)
    if name == "support vector machine":
        n = train.count()
        C = float(params.get("C", 1.0))
        kernel = params.get("kernel", "rbf")
        if kernel not in ("rbf", "linear"):
            raise ValueError("kernel must be 'rbf' or 'linear' (others need an O(n^2) solver)")
        std = Standardizer.fit(train)
        data, wrap = train, None
        if kernel == "rbf":
            g = params.get("gamma", "scale")
            gamma = 1.0 / len(std.mean) if g in ("scale", "auto") else float(g)
            rff = RandomFourier.make(len(std.mean), gamma, int(params.get("n_components", 100)), seed)
            data = with_rff(train, std, rff)
            wrap = (std, rff)
        if task == CLS:
            svc = LinearSVC(regParam=1.0 / (C * n), maxIter=int(params.get("max_iter", 100)),
                            standardization=kernel == "linear")
            several = _together(train, n, name, params, len(std.mean), n_classes)
            inner = (svc if n_classes <= 2 else OneVsRest(classifier=svc, parallelism=several)).fit(data)
        else:
            inner = fit_sgd(data, REG, loss="epsilon_insensitive", alpha=1.0 / (C * n),
                            epsilon=float(params.get("epsilon", 0.1)), learning_rate="adaptive",
                            eta0=0.1, max_iter=int(params.get("max_iter", 1000)), random_state=seed)
        return _RFFModel(*wrap, inner) if wrap else inner
    if name == "gaussian process":
        ls = float(params.get("length_scale", 1.0))
        std = Standardizer.fit(train)
        rff = RandomFourier.make(len(std.mean), 1.0 / (2 * ls * ls), int(params.get("n_components", 200)), seed)
        data = with_rff(train, std, rff)
        if task == CLS:
            lr = LogisticRegression(regParam=1e-4, standardization=False, maxIter=200)
            several = _together(train, train.count(), name, params, len(std.mean), n_classes)
            inner = (lr if n_classes <= 2 else OneVsRest(classifier=lr, parallelism=several)).fit(data)
        else:
            inner = LinearRegression(regParam=float(params.get("alpha", 1e-6)), elasticNetParam=0.0,
                                     standardization=False, solver="normal").fit(data)
        return _RFFModel(std, rff, inner)
    raise ValueError(f"unknown model {name!r}")


def _row_bytes(name: str, params: dict, width: int) -> int:
    """About what the solver keeps of a training row while it iterates: bootstrap
    counts and node ids per tree, or the row's random Fourier features."""
    if name == "random forest":
        return 150 + 8 * width + 14 * int(params.get("n_estimators", 100))
    if name == "gaussian process":
        return 50 + 8 * int(params.get("n_components", 200))
    if name == "support vector machine" and params.get("kernel", "rbf") == "rbf":
        return 50 + 8 * int(params.get("n_components", 100))
    return 150 + 8 * width


def _spread(df: DataFrame, name: str, params: dict) -> DataFrame:
    """``df`` in so many partitions that each keeps ``TASK_BYTES`` at most while
    the model is fitted, and every core has one: a few MB of Parquet come as
    one partition.  A forest's rows are dealt in the order of their features:
    a deep node then has rows, and statistics to send, in few partitions.
    Few rows stay as they are."""
    first = df.select("features").first()
    rows = df.count()
    if first is None or rows <= SPREAD_ROWS:
        return df
    parts = max(df.sparkSession.sparkContext.defaultParallelism,
                -(-rows * _row_bytes(name, params, len(first[0])) // TASK_BYTES))
    df = df.select("features", "label")
    if name == "random forest":
        by = df.withColumn(TMP + "x", vector_to_array("features")).withColumn(TMP + "r", F.rand(42))
        return stored(by.repartitionByRange(parts, TMP + "x", TMP + "r").select("features", "label"))
    return stored(df.repartition(parts))


def fit(df: DataFrame, model: str, task: str, params: dict | None = None) -> object:
    """Fit ``model`` on a prepared frame (``features``, ``label``)."""
    if model not in MODEL_TASKS:
        raise ValueError(f"unknown model {model!r}; choose from {sorted(MODEL_TASKS)}")
    n_classes = 1
    params = dict(params or {})
    if model in ITERATED:
        df = _spread(df, model, params)
    if task == CLS:
        n_classes = int(df.agg(F.max("label")).first()[0]) + 1
    return _convert(model, task, params, df, n_classes)


def train_model(df: DataFrame, target: str, model: str, task: str, features: list[str] | None = None,
                params: dict | None = None, test_size: float = 0.2, seed: int = 42,
                key: str | list[str] | None = None) -> TrainedModel:
    """Full path of the reference's Train button, as Spark jobs."""
    keys = [key] if isinstance(key, str) else list(key or [])
    prep = prepare(df, target, task, features, keep=keys, missing="keep" if model in TAKES_MISSING and (params or {}).get("engine") == "second_order" else "error")
    split_key = keys or [*prep.feature_names, target]
    train, test = train_test_split(prep.frame, test_size, seed, key=split_key)
    m = fit(train, model, task, params)
    pred = m.transform(test)
    if task == CLS:
        metrics = evaluate.classification_metrics(pred)
        if prep.label_classes:
            pred = IndexToString(inputCol="prediction", outputCol="predicted_class",
                                 labels=prep.label_classes).transform(pred)
    else:
        metrics = evaluate.regression_metrics(pred)
    return TrainedModel(model, task, m, pred, metrics, prep.feature_names, prep.label_classes,
                        dict(params or {}))
