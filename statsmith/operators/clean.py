"""Projections, missing values and outliers.

Statistics a fill or filter needs (mean, exact median, mode, quartiles,
z-score moments) are computed by one aggregate job and come back to the
driver as scalars; the apply step is then a plain projection/filter that
Catalyst pushes into the scan where it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statsmith.functions.columns import dbl, present, require_columns, require_numeric, safe_div, value
from statsmith.operators import ordered

FILL_METHODS = ("drop", "mean", "median", "mode", "ffill", "bfill",
                "linear_interpolate", "cubic_spline")


def drop_column(df: DataFrame, col: str | None) -> DataFrame:
    """Remove one column (error when none or an unknown one is given)."""
    if not col:
        raise ValueError("choose a column to delete")
    require_columns(df, [col])
    return df.drop(col)


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """Listwise deletion over ``cols``."""
    require_columns(df, cols)
    return df.na.drop(how="any", subset=list(cols))


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """Column projection."""
    require_columns(df, cols)
    return df.select(*cols)


def _replace(df: DataFrame, col: str, expr: Column) -> DataFrame:
    return df.select(*[expr.alias(c) if c == col else F.col(f"`{c}`") for c in df.columns])


def column_mode(df: DataFrame, col: str):
    """Most frequent non-NULL value, smallest among ties (None if all NULL).

    Counted with a partially aggregated ``groupBy`` and reduced by a top-1
    (per-partition best, then merge), so no task ever holds all values."""
    top = (df.where(present(df, col)).groupBy(col).count()
             .orderBy(F.desc("count"), F.asc(col)).limit(1).collect())
    return top[0][0] if top else None


def fill_missing(df: DataFrame, col: str, method: str, order_by=None, partition_by=()) -> DataFrame:
    """Fill (or drop) missing values of one column.

    ``ffill``/``bfill``/``linear_interpolate``/``cubic_spline`` need
    ``order_by``: a Spark frame has no row order of its own.
    """
    require_columns(df, [col])
    if method not in FILL_METHODS:
        raise ValueError(f"method must be one of {FILL_METHODS}")
    if method == "drop":
        return df.na.drop(subset=[col])
    if method in ("mean", "median"):
        require_numeric(df, [col])
        if method == "mean":
            v = df.agg(F.avg(dbl(col))).first()[0]
        else:
            v = ordered.quantile_values(df, col, [0.5])[0]
        if v is None:
            return df
        return _replace(df, col, F.coalesce(dbl(col), F.lit(float(v))))
    if method == "mode":
        v = column_mode(df, col)
        if v is None:
            return df
        return _replace(df, col, F.coalesce(value(df, col), F.lit(v)))
    if order_by is None:
        raise ValueError(f"{method} needs order_by (a column that orders the rows)")
    fn = {"ffill": ordered.fill_forward, "bfill": ordered.fill_backward,
          "linear_interpolate": ordered.interpolate_linear,
          "cubic_spline": ordered.interpolate_cubic}[method]
    return fn(df, col, order_by, partition_by)


def outlier_bounds(df: DataFrame, col: str, method: str = "IQR") -> tuple:
    """Driver scalars defining the kept range.

    IQR: (Q1 - 1.5 IQR, Q3 + 1.5 IQR) with exact interpolated quartiles.
    zscore: (mean, population std) for |x - mean| / std <= 3.
    """
    require_numeric(df, [col])
    if method == "IQR":
        q1, q3 = ordered.quantile_values(df, col, [0.25, 0.75])
        if q1 is None:
            return ("IQR", None, None)
        iqr = q3 - q1
        return ("IQR", q1 - 1.5 * iqr, q3 + 1.5 * iqr)
    if method == "zscore":
        r = df.agg(F.avg(dbl(col)), F.stddev_pop(dbl(col))).first()
        return ("zscore", r[0], r[1])
    raise ValueError("method must be 'IQR' or 'zscore'")


def _keep_expr(col: str, bounds: tuple) -> Column:
    kind, a, b = bounds
    x = dbl(col)
    if a is None:
        return F.lit(False)
    if kind == "IQR":
        return x.isNotNull() & (x >= F.lit(a)) & (x <= F.lit(b))
    z = F.abs(safe_div(x - F.lit(a), F.lit(b)))
    return F.coalesce(z <= F.lit(3.0), F.lit(False))


def _scan_range(col: str, bounds: tuple) -> Column | None:
    """A plain range on the raw column implied by the exact rule, so parquet
    can skip row groups (NaN compares above every value, so it fails the upper
    bound just as the exact rule drops it).  The z-score range is widened by
    a relative 1e-9 because it only pre-filters; the exact rule decides."""
    kind, a, b = bounds
    if a is None or (kind == "zscore" and not b):
        return None
    lo, hi = (a, b) if kind == "IQR" else (a - 3 * b, a + 3 * b)
    if kind == "zscore":
        eps = 1e-9 * (abs(a) + 3 * abs(b))
        lo, hi = lo - eps, hi + eps
    return (F.col(col) >= F.lit(float(lo))) & (F.col(col) <= F.lit(float(hi)))


def remove_outliers(df: DataFrame, col: str, method: str = "IQR") -> DataFrame:
    """Keep rows inside the bounds.  NULL (and NaN) rows are removed
    too, and a constant column under ``zscore`` (std 0, z undefined) keeps no
    row.  The filter carries an implied raw-column range that reaches the
    parquet scan."""
    bounds = outlier_bounds(df, col, method)
    keep = _keep_expr(col, bounds)
    pre = _scan_range(col, bounds)
    return df.where(keep if pre is None else pre & keep)


def outlier_report(df: DataFrame, col: str, method: str = "IQR") -> DataFrame:
    """One row ``n_before, n_after, removed`` from one aggregate."""
    keep = _keep_expr(col, outlier_bounds(df, col, method))
    return df.agg(F.count(F.lit(1)).alias("n_before"),
                  F.count(F.when(keep, 1)).alias("n_after")) \
             .withColumn("removed", F.col("n_before") - F.col("n_after"))


def append_derived(df: DataFrame, exprs: dict[str, Column], required: list[str]) -> DataFrame:
    """add/overwrite derived columns, NULL on rows missing any of
    ``required`` (no join: the expression is evaluated row by row)."""
    ok = None
    for c in required:
        ok = present(df, c) if ok is None else ok & present(df, c)
    cols = {k: F.when(ok, v) for k, v in exprs.items()}
    return df.withColumns(cols)
