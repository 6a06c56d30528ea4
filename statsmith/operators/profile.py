"""Profiling operators (B1-B4, F3, F4): one aggregate pass per call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.functions.columns import (TMP, dbl, numeric_columns, present, require_numeric,
                                         safe_div, string_columns, value)
from statsmith.operators.ordered import quantiles


def info(df: DataFrame) -> DataFrame:
    """B1: one row per column: position, column, non_null, dtype, n_rows."""
    aggs = [F.count(F.lit(1)).alias(TMP + "n")] + \
           [F.count(value(df, c)).alias(f"{TMP}{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.col(f"{TMP}{i}").alias("non_null"),
                 F.lit(f.dataType.simpleString()).alias("dtype"))
        for i, f in enumerate(df.schema.fields)])
    return one.select(F.inline(items), F.col(TMP + "n").alias("n_rows"))


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with at least one missing value: column, missing_count,
    percentage (= missing / rows * 100, kept at full precision)."""
    aggs = [F.count(F.lit(1)).alias(TMP + "n")] + \
           [F.count(F.when(~present(df, c), 1)).alias(f"{TMP}{i}")
            for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{TMP}{i}").alias("missing_count"))
                      for i, c in enumerate(df.columns)])
    long = one.select(F.inline(items), F.col(TMP + "n"))
    return (long.where(F.col("missing_count") > 0)
                .select("column", "missing_count",
                        (safe_div(F.col("missing_count") * 100.0, F.col(TMP + "n"))).alias("percentage")))


def numeric_projection(df: DataFrame, exclude=None) -> DataFrame:
    """Numeric (non-boolean) columns, optionally without the target."""
    return df.select(numeric_columns(df, exclude))


def string_projection(df: DataFrame, exclude=None) -> DataFrame:
    return df.select(string_columns(df, exclude))


_STATS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


def describe_transposed(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """one row per numeric column: variable, count, mean, std (ddof 1), min,
    q25, q50, q75 (exact, linear interpolation), max."""
    cols = cols or numeric_columns(df)
    require_numeric(df, cols)
    if not cols:
        raise ValueError("no numeric column to describe")
    aggs = []
    for i, c in enumerate(cols):
        x = dbl(c)
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"c{i}").alias("count"),
                               F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                               F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
                      for i, c in enumerate(cols)])
    moments = one.select(F.inline(items))
    q = quantiles(df, cols, [0.25, 0.5, 0.75]).select(
        "variable", F.col("q_0").alias("q25"), F.col("q_1").alias("q50"), F.col("q_2").alias("q75"))
    # both sides hold one row per column: a bounded broadcast
    return (moments.join(F.broadcast(q), "variable", "left")
                   .select("variable", *_STATS))


def describe(df: DataFrame) -> DataFrame:
    """B2: the pandas ``describe()`` layout, one row per statistic and one
    column per numeric variable.  Without numeric columns: count, unique,
    top, freq over the string columns."""
    cols = numeric_columns(df)
    if not cols:
        return _describe_objects(df)
    t = describe_transposed(df, cols)
    items = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(s).alias("stat"),
                               F.col(s).cast("double").alias("value"))
                      for i, s in enumerate(_STATS)])
    long = t.select("variable", F.inline(items))
    wide = long.groupBy("k", "stat").pivot("variable", cols).agg(F.first("value"))
    return wide.orderBy("k").drop("k")


def _describe_objects(df: DataFrame) -> DataFrame:
    """count, unique, top (most frequent, smallest on ties), freq for every
    column, in three aggregate passes whatever the number of columns: one for
    count / unique, one over the stacked (variable, value) counts for the top
    frequency, one for the smallest value reaching it (no window, so a column
    with many distinct values is never gathered into one task)."""
    cols = df.columns
    summ = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)],
                  *[F.count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"c{i}").alias("count"),
                               F.col(f"u{i}").alias("unique")) for i, c in enumerate(cols)])
    base = summ.select(F.inline(items))
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in cols]))).where(F.col("value").isNotNull())
    vc = stacked.groupBy("variable", "value").count()
    best = vc.groupBy("variable").agg(F.max("count").alias("freq"))
    top = (vc.join(best, "variable").where(F.col("count") == F.col("freq"))
             .groupBy("variable", "freq").agg(F.min("value").alias("top")))
    return base.join(top, "variable", "left").select("variable", "count", "unique", "top", "freq")


def value_stats(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std, min, max of one column."""
    require_numeric(df, [col])
    x = dbl(col)
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"),
                  F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
