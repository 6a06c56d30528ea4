"""Model evaluation (I8, I9, I11-I15): small aggregates over predictions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.functions.columns import TMP, dbl, safe_div
from statsmith.operators import ordered


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long-form confusion table ``label, prediction, count``."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).count()


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """I8: accuracy and support-weighted precision, recall, F1 (zero_division
    = 0), plus the test-set size, as ``metric, value`` rows.  Computed from
    the confusion table (classes^2 rows at most)."""
    cm = confusion(pred, label, prediction)
    tot = cm.agg(F.sum("count").alias("n"),
                 F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count"))).alias("hit"))
    sup = cm.groupBy(F.col("label").alias("c")).agg(F.sum("count").alias("support"))
    prd = cm.groupBy(F.col("prediction").alias("c")).agg(F.sum("count").alias("predicted"))
    tp = cm.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("c"),
                                                                 F.col("count").alias("tp"))
    per = (sup.join(prd, "c", "full").join(tp, "c", "left")
              .na.fill(0, ["support", "predicted", "tp"]))
    prec = F.coalesce(safe_div(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    rec = F.coalesce(safe_div(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(safe_div(2 * prec * rec, prec + rec), F.lit(0.0))
    w = per.agg(F.sum(F.col("support") * prec).alias("p"), F.sum(F.col("support") * rec).alias("r"),
                F.sum(F.col("support") * f1).alias("f"), F.sum("support").alias("n"))
    t, ww = tot.first(), w.first()
    n = t["n"] or 0
    vals = [("accuracy", (t["hit"] or 0) / n if n else None),
            ("precision", ww["p"] / n if n else None),
            ("recall", ww["r"] / n if n else None),
            ("f1", ww["f"] / n if n else None),
            ("n_test", float(n))]
    return pred.sparkSession.createDataFrame(vals, "metric string, value double")


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MSE, MAE, R^2 and the test-set size from one aggregate."""
    y, p = dbl(label), dbl(prediction)
    r = pred.agg(F.avg((y - p) ** 2).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
                 F.sum((y - p) ** 2).alias("ssr"), (F.var_pop(y) * F.count(y)).alias("sst"),
                 F.count(y).alias("n")).first()
    r2 = 1.0 - r["ssr"] / r["sst"] if r["sst"] else None
    vals = [("mse", r["mse"]), ("mae", r["mae"]), ("r2", r2), ("n_test", float(r["n"]))]
    return pred.sparkSession.createDataFrame(vals, "metric string, value double")


def _roc_table(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct score (within ``keys``), ranked from the highest score:
    ``pos, neg`` at that score and ``tp_before, fp_before`` above it."""
    neg_score = scored.withColumn(TMP + "ns", -F.col(TMP + "s"))
    rv = ordered.ranked_values(neg_score, TMP + "ns", keys,
                               weights={"pos": F.col(TMP + "y").cast("long"),
                                        "neg": (1 - F.col(TMP + "y")).cast("long")})
    return rv.select(*keys, (-F.col(TMP + "ns")).alias("threshold"), "pos", "neg",
                     F.col("cum_pos").alias("tp_before"), F.col("cum_neg").alias("fp_before"))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """ROC points ``threshold, fpr, tpr`` at every distinct score
    (threshold = score), from a ranked value table with positive/negative
    weights, and the origin (0, 0) at an infinite threshold."""
    s = pred.select((F.col(label) == F.lit(positive)).cast("int").alias(TMP + "y"),
                    dbl(score).alias(TMP + "s")).where(F.col(TMP + "s").isNotNull())
    rt = _roc_table(s, [])
    tot = s.agg(F.sum(TMP + "y").alias("P"), F.count(F.lit(1)).alias("N")).first()
    P, N = tot["P"] or 0, tot["N"] - (tot["P"] or 0)
    origin = pred.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(rt.select(
        "threshold", safe_div((F.col("fp_before") + F.col("neg")).cast("double"), F.lit(float(N))).alias("fpr"),
                     safe_div((F.col("tp_before") + F.col("pos")).cast("double"), F.lit(float(P))).alias("tpr")))


def _auc_expr() -> F.Column:
    # trapezoid between the point above this score and the point at it
    return F.col("neg") * (2 * F.col("tp_before") + F.col("pos"))


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score", positive=1) -> float:
    """Area under the ROC curve by the trapezoid rule, as one aggregate
    over the ranked score table: sum neg_s (2 tp_above + pos_s) / (2 P N)."""
    s = pred.select((F.col(label) == F.lit(positive)).cast("int").alias(TMP + "y"),
                    dbl(score).alias(TMP + "s")).where(F.col(TMP + "s").isNotNull())
    r = _roc_table(s, []).agg(F.sum(_auc_expr()).alias("a"), F.sum("pos").alias("P"),
                              F.sum("neg").alias("N")).first()
    if not r["P"] or not r["N"]:
        return float("nan")
    return float(r["a"]) / (2.0 * r["P"] * r["N"])


def roc_auc_frame(pred: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    return pred.sparkSession.createDataFrame([(roc_auc(pred, label, score, positive),)], "auc double")


def multiclass_roc_auc(pred: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """One-vs-rest AUC per class index from the probability (or raw
    score) vector: ``class, auc`` (NULL for a class without rows of its own)."""
    arr = vector_to_array(F.col(probability)) if dict(pred.dtypes)[probability] != "array<double>" \
        else F.col(probability)
    s = pred.select(dbl(label).alias(TMP + "lab"), F.posexplode(arr).alias("class", TMP + "s"))
    s = s.withColumn(TMP + "y", (F.col(TMP + "lab") == F.col("class").cast("double")).cast("int"))
    rt = _roc_table(s, ["class"])
    return (rt.groupBy("class").agg(safe_div(F.sum(_auc_expr()).cast("double"), 2.0 * F.sum("pos") * F.sum("neg")).alias("auc"))
              .orderBy("class"))


def feature_importance(model, names: list[str], top: int = 20):
    """Top-``top`` feature importances (tree ensembles only), descending;
    a one-vs-rest ensemble reports the mean over its per-class models."""
    imp = getattr(model, "featureImportances", None)
    subs = getattr(model, "models", None)           # one-vs-rest: average the class models
    if imp is None and subs:
        parts = [m.featureImportances.toArray() for m in subs if hasattr(m, "featureImportances")]
        if not parts:
            return None
        vals = sum(parts) / len(parts)
    elif imp is None:
        return None
    else:
        vals = imp.toArray()
    pairs = sorted(zip(names, [float(v) for v in vals]), key=lambda t: (-t[1], t[0]))[:min(top, len(names))]
    return pairs


def score_column(pred: DataFrame, positive_index: int = 1) -> DataFrame:
    """The ranking score for ROC: the positive-class probability when the
    model gives one, otherwise its raw margin (SVM, hinge SGD)."""
    cols = dict(pred.dtypes)
    src = "probability" if "probability" in cols else "rawPrediction"
    arr = F.col(src) if cols[src] == "array<double>" else vector_to_array(F.col(src))
    return pred.withColumn("score", arr[positive_index])
