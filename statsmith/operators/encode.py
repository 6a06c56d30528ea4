"""Encoding and scaling.

Scalers follow the single-machine library conventions the reference relies
on, which differ from ``pyspark.ml.feature`` defaults: standard scaling
divides by the population std, min-max maps a constant column to 0, robust
scaling uses exact quartiles; a zero spread divides by 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statsmith.functions.columns import TMP, dbl, numeric_columns, python_float_text, require_columns
from statsmith.operators import ordered


def as_text(df: DataFrame, col: str) -> Column:
    """Python-style text of a value: NULL -> 'nan', booleans 'True'/'False',
    doubles in plain decimal notation with at least one decimal."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.BooleanType):
        txt = F.when(c, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(dt, (T.DoubleType, T.FloatType)):
        txt = python_float_text(col)
    else:
        txt = c.cast("string")
    return F.coalesce(txt, F.lit("nan"))


# Class sets up to this size are sorted on the driver and broadcast.
SMALL_CLASS_SET = 10_000


def _mapping(df: DataFrame, col: str) -> tuple[DataFrame, bool]:
    require_columns(df, [col])
    classes = df.select(as_text(df, col).alias("class")).distinct()
    few = [r[0] for r in classes.limit(SMALL_CLASS_SET + 1).collect()]   # bounded probe
    if len(few) <= SMALL_CLASS_SET:
        # code-point order (Python) equals Spark's binary UTF-8 string order
        return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(sorted(few))],
                                               "class string, code long"), True
    rv = ordered.ranked_values(classes, "class")
    return rv.select("class", F.col("cum_before").cast("long").alias("code")), False


def label_mapping(df: DataFrame, col: str) -> DataFrame:
    """Classes of ``col`` as text, sorted by code point, with code = position:
    ``class, code``.  Up to ``SMALL_CLASS_SET`` classes (checked with a bounded
    probe) are sorted on the driver; larger sets get their codes from the
    range-partitioned prefix count over the distinct classes, so no single
    task sorts them all."""
    return _mapping(df, col)[0]


def label_encode(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Replace ``col`` by its integer code; returns (encoded, mapping).
    A mapping of at most ``SMALL_CLASS_SET`` classes is broadcast; a larger
    one is joined as the planner decides (AQE: by measured size, with skew
    splitting for a class holding many rows)."""
    mapping, small = _mapping(df, col)
    key = TMP + "cls"
    m = mapping.withColumnRenamed("class", key)
    j = df.withColumn(key, as_text(df, col)).join(F.broadcast(m) if small else m, on=key, how="left")
    out = j.select(*[F.col("code").alias(c) if c == col else F.col(f"`{c}`") for c in df.columns])
    return out, mapping


def encode_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Label-encode every string column (or the given ones)."""
    from statsmith.functions.columns import string_columns
    for c in cols if cols is not None else string_columns(df):
        df, _ = label_encode(df, c)
    return df


def scaling_stats(df: DataFrame, method: str, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Driver scalars (center, scale) per column, one job per method."""
    if method == "standard":
        r = df.agg(*[F.avg(dbl(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(dbl(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}
    if method == "minmax":
        r = df.agg(*[F.min(dbl(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                   *[F.max(dbl(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        return {c: (r[f"a{i}"], None if r[f"a{i}"] is None else r[f"b{i}"] - r[f"a{i}"])
                for i, c in enumerate(cols)}
    if method == "robust":
        q = {row["variable"]: row for row in
             ordered.quantiles(df, cols, [0.25, 0.5, 0.75]).collect()}  # one row per column
        return {c: (q[c]["q_1"], q[c]["q_2"] - q[c]["q_0"]) if c in q else (None, None)
                for c in cols}
    raise ValueError("method must be 'standard', 'minmax' or 'robust'")


def scale(df: DataFrame, method: str = "standard", target: str | None = None,
          cols: list[str] | None = None) -> DataFrame:
    """Scale every numeric column except ``target``.  NULL stays NULL."""
    cols = cols if cols is not None else numeric_columns(df, exclude=target)
    if not cols:
        raise ValueError("no numeric columns to scale")
    st = scaling_stats(df, method, cols)
    out = []
    for c in df.columns:
        if c not in st:
            out.append(F.col(f"`{c}`"))
            continue
        center, spread = st[c]
        if center is None:
            out.append(dbl(c).alias(c))
            continue
        spread = 1.0 if (spread is None or spread == 0) else spread
        out.append(((dbl(c) - F.lit(float(center))) / F.lit(float(spread))).alias(c))
    return df.select(out)


def one_vs_rest(df: DataFrame, label: str, classes: list | None = None) -> DataFrame:
    """One 0/1 indicator column ``<label>_is_<k>`` per class.  Classes
    that differ by case only get their position appended to the name."""
    if classes is None:
        from statsmith.operators.groups import distinct_levels
        classes = [r[0] for r in distinct_levels(df, label).orderBy(label).collect()]   # one output column each
    names = [f"{label}_is_{k}" for k in classes]
    lower = [x.lower() for x in names]
    names = [x if lower.count(x.lower()) == 1 else f"{x}_{i}" for i, x in enumerate(names)]
    return df.withColumns({x: (F.col(label) == F.lit(k)).cast("int") for x, k in zip(names, classes, strict=True)})
