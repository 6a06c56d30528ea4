"""Edge cases: empty frames, all-NULL and constant columns, one group."""
import pytest
from pyspark.sql import functions as F

from statsmith.operators import (chartdata, clean, encode, groups, ordered, profile,
                                 tests_parametric as TP, tests_rank as TR)


@pytest.fixture()
def nulls(spark):
    return spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, None, "b")], "k long, x double, g string")


def test_all_null_column(spark, nulls):
    t = profile.describe_transposed(nulls, ["x"]).first()
    assert t["count"] == 0 and t["mean"] is None and t["q50"] is None
    assert clean.fill_missing(nulls, "x", "median").where(F.col("x").isNotNull()).count() == 0
    assert clean.fill_missing(nulls, "x", "mean").where(F.col("x").isNotNull()).count() == 0
    assert clean.fill_missing(nulls, "x", "ffill", order_by="k").where(F.col("x").isNotNull()).count() == 0
    assert chartdata.histogram(nulls, "x").count() == 0
    assert clean.remove_outliers(nulls, "x", "IQR").count() == 0
    assert encode.scale(nulls, "robust", cols=["x"]).where(F.col("x").isNotNull()).count() == 0


def test_empty_frame(spark):
    e = spark.createDataFrame([], "k long, x double, g string")
    assert ordered.quantiles(e, ["x"], [0.5]).count() == 0
    assert groups.group_stats(e, "g", "x").count() == 0
    assert profile.missing_summary(e).count() == 0
    assert ordered.fill_forward(e, "x", "k").count() == 0


def test_wrong_group_counts_raise(spark, nulls):
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    three = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, v double")
    with pytest.raises(ValueError):
        TP.anova_oneway(one, "g", "v")
    with pytest.raises(ValueError):
        TP.ttest_ind(three, "g", "v")
    with pytest.raises(ValueError):
        TR.mannwhitney(one, "g", "v")
    with pytest.raises(ValueError):
        TR.kruskal(one, "g", "v")
    with pytest.raises(ValueError):
        TR.shapiro(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v")
    with pytest.raises(ValueError):
        chartdata.correlation_matrix(one, ["v"])
    with pytest.raises(ValueError):
        clean.drop_column(one, None)
    with pytest.raises(ValueError):
        clean.fill_missing(one, "v", "ffill")          # no order given


def test_nan_is_missing_everywhere(spark, tmp_path):
    import math
    from statsmith.sources import read_parquet
    p = str(tmp_path / "nan.parquet")
    nan = float("nan")
    spark.createDataFrame([(1, 1.0, "a"), (2, nan, "b"), (3, 3.0, None), (4, nan, "a"), (5, 5.0, "a")],
                          "k long, x double, s string").write.parquet(p)
    df = read_parquet(spark, p)
    info = {r["column"]: r["non_null"] for r in profile.info(df).collect()}
    assert info["x"] == 3
    ms = {r["column"]: r["missing_count"] for r in profile.missing_summary(df).collect()}
    assert ms["x"] == 2
    t = profile.describe_transposed(df, ["x"]).first()
    assert t["count"] == 3 and t["mean"] == pytest.approx(3.0) and t["q50"] == pytest.approx(3.0)
    ff = [r["x"] for r in clean.fill_missing(df, "x", "ffill", order_by="k").orderBy("k").collect()]
    assert ff == [1.0, 1.0, 3.0, 3.0, 5.0]
    mean = [r["x"] for r in clean.fill_missing(df, "x", "mean").orderBy("k").collect()]
    assert mean == [1.0, 3.0, 3.0, 3.0, 5.0]
    assert sorted(r["x"] for r in chartdata.bar_counts(df, "x").collect()) == [1.0, 3.0, 5.0]
    g = {r["level"]: r["count"] for r in groups.group_stats(df, "s", "x").collect()}
    assert g == {"a": 2, "b": 0}
    kept = clean.remove_outliers(df, "x", "IQR")
    assert sorted(r["x"] for r in kept.collect()) == [1.0, 3.0, 5.0]
    assert not any(math.isnan(r["x"]) for r in kept.collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x" in plan and "LessThanOrEqual(x" in plan    # reaches the scan


def test_paired_duplicate_key_raises(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0)], "k long, g string, v double")
    with pytest.raises(ValueError):
        TP.ttest_rel(df, "g", "v", "k")
