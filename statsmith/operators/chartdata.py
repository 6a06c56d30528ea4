"""Chart-data operators (E1-E9): the frame each plot needs, never the drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.functions.columns import (TMP, column, dbl, numeric_columns, present, require_columns,
                                         require_numeric, safe_div)
from statsmith.operators import ordered


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), NULL dropped,
    empty bins present: ``bin, lower, upper, count``.

    Bin edges and the bin rule follow numpy's histogram: edges
    lo + i * (hi - lo) / bins; a value goes to bin floor((x - lo) * bins /
    (hi - lo)), corrected against the edges; min == max widens to +-0.5.
    """
    require_numeric(df, [col])
    lo, hi = df.agg(F.min(dbl(col)), F.max(dbl(col))).first()
    if lo is None:
        return df.sparkSession.range(0).select(
            F.col("id").cast("int").alias("bin"), F.lit(0.0).alias("lower"),
            F.lit(0.0).alias("upper"), F.lit(0).cast("long").alias("count"))
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins

    def edge(i):
        return F.when(i >= bins, F.lit(float(hi))).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    x = dbl(col)
    raw = F.least(F.floor((x - F.lit(lo)) * F.lit(bins / (hi - lo))).cast("int"), F.lit(bins - 1))
    b, xv = F.col(TMP + "b"), F.col(TMP + "x")
    counts = (df.where(x.isNotNull()).select(raw.alias(TMP + "b"), x.alias(TMP + "x"))
                .select(F.when(xv < edge(b), b - 1)
                         .when((xv >= edge(b + 1)) & (b != bins - 1), b + 1)
                         .otherwise(b).alias("bin"))
                .groupBy("bin").count())
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")  # at most `bins` rows
                .select("bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def boxplot_stats(df: DataFrame, col: str, whis: float = 1.5) -> DataFrame:
    """q1, median, q3 (exact), whiskers = most extreme data within
    whis * IQR of the box, flier count, mean, n."""
    require_numeric(df, [col])
    q1, med, q3 = ordered.quantile_values(df, col, [0.25, 0.5, 0.75])
    x = dbl(col)
    if q1 is None:
        lo_f, hi_f = None, None
    else:
        iqr = q3 - q1
        lo_f, hi_f = q1 - whis * iqr, q3 + whis * iqr
    inside = (x >= F.lit(lo_f)) & (x <= F.lit(hi_f))
    return df.where(x.isNotNull()).agg(
        F.lit(q1).cast("double").alias("q1"), F.lit(med).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_fliers"),
        F.avg(x).alias("mean"), F.count(x).alias("n"))


def boxplot_fliers(df: DataFrame, col: str, whis: float = 1.5) -> DataFrame:
    """E2 companion: every flier row (value outside the whiskers' range)."""
    q1, q3 = ordered.quantile_values(df, col, [0.25, 0.75])
    if q1 is None:
        return df.where(F.lit(False))
    iqr = q3 - q1
    x = dbl(col)
    return df.where((x < F.lit(q1 - whis * iqr)) | (x > F.lit(q3 + whis * iqr)))


def bar_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts without NULL, ordered by value."""
    require_columns(df, [col])
    return df.where(present(df, col)).groupBy(col).count().orderBy(col)


def pie_shares(df: DataFrame, col: str) -> DataFrame:
    """Counts (descending, ties by value) and percentage of the total."""
    require_columns(df, [col])
    nn = df.where(present(df, col))
    total = nn.count()
    return (nn.groupBy(col).count()
              .withColumn("percentage", safe_div(F.col("count") * 100.0, F.lit(total)))
              .orderBy(F.desc("count"), F.asc(col)))


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """E5: every complete (x, y) pair."""
    require_columns(df, [x, y])
    return df.select(x, y).na.drop()


def line_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) sorted by x with NULL x last (a distributed range sort)."""
    require_columns(df, [x, y])
    return df.select(x, y).orderBy(F.asc_nulls_last(x))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, exclude=None) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair of numeric
    columns, long form ``var1, var2, corr``.  A constant column gives NULL
    (undefined).  Up to ``gram.WIDE`` columns: one aggregate of masked
    ``covar_samp``/``stddev_samp``; wider: masked matrix products per Arrow
    batch (see ``_pairwise_wide``)."""
    from statsmith.operators.gram import WIDE
    cols = cols or numeric_columns(df, exclude=exclude)
    require_numeric(df, cols)
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    if len(cols) > WIDE:
        return _pairwise_wide(df, cols)
    aggs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            both = dbl(a).isNotNull() & dbl(b).isNotNull()
            xa, xb = F.when(both, dbl(a)), F.when(both, dbl(b))
            r = safe_div(F.covar_samp(xa, xb), F.stddev_samp(xa) * F.stddev_samp(xb))
            aggs.append(r.alias(f"r_{i}_{j}"))
    one = df.agg(*aggs)
    items = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            k = f"r_{min(i, j)}_{max(i, j)}"
            items.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                  F.col(k).alias("corr")))
    return one.select(F.inline(F.array(*items)))


def _pairwise_wide(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete sums for many columns: with M the not-NULL mask and X
    the pilot-centred values (0 where NULL), per batch n = M'M, Sx = X'M,
    Sxx = (X*X)'M, Sxy = X'X; partials are summed by a groupBy over cells
    (p^2 rows per partition at most), the p x p result is finished on the
    driver and returned as a long frame."""
    import numpy as np
    import pyarrow as pa

    p = len(cols)
    x = df.select([dbl(c).alias(f"x{i}") for i, c in enumerate(cols)])
    pilot = x.agg(*[F.avg(f"x{i}") for i in range(p)]).first()
    mu = np.array([v if v is not None else 0.0 for v in pilot], dtype=float)

    def partial(batches):
        acc = np.zeros((4, p, p))
        for b in batches:
            if b.num_rows == 0:
                continue
            X = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float)
                                 for i in range(p)])
            M = (~np.isnan(X)).astype(float)
            Xc = np.where(M > 0, X - mu, 0.0)
            acc[0] += M.T @ M
            acc[1] += Xc.T @ M
            acc[2] += (Xc * Xc).T @ M
            acc[3] += Xc.T @ Xc
        idx = np.indices((4, p, p)).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(idx[0], pa.int8()), pa.array(idx[1], pa.int32()),
                                          pa.array(idx[2], pa.int32()), pa.array(acc.ravel())],
                                         names=["s", "i", "j", "v"])

    cells = (x.mapInArrow(partial, "s byte, i int, j int, v double")
              .groupBy("s", "i", "j").agg(F.sum("v").alias("v")).collect())   # 4 p^2 rows
    S = np.zeros((4, p, p))
    for r in cells:
        S[r["s"], r["i"], r["j"]] = r["v"]
    n, sx, sxx, sxy = S
    sy, syy = sx.T, sxx.T                      # sums of x_j over rows where x_i is present
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = sxy - sx * sy / n
        var_x, var_y = sxx - sx * sx / n, syy - sy * sy / n
        R = cov / np.sqrt(var_x * var_y)
    R[(n < 2) | ~np.isfinite(R) | (var_x <= 0) | (var_y <= 0)] = np.nan
    rows = [(a, b, None if np.isnan(R[i, j]) else float(R[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, corr double")


def scree_data(variance: DataFrame) -> DataFrame:
    """Component or factor vs its eigenvalue (a factor's variance), with the
    reference line at 1."""
    of = "eigenvalue" if "eigenvalue" in variance.columns else "variance"
    return variance.select("component", F.col(of).alias("eigenvalue"), F.lit(1.0).alias("reference"))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """E5, binned: ``x_bin, y_bin, x_low, y_low, count`` of the cells of a grid
    over the ranges of x and y that hold points (pairs with both values); the
    last bin of each axis is closed, an axis of one value has the single bin 0.
    One pass for the ranges, one for the counts."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    pairs = df.select(dbl(column(x)).alias("x"), dbl(column(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    r = pairs.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    def cell(name):
        low, high = r[f"{name}0"], r[f"{name}1"]
        if low is None or low == high:
            return F.lit(0).cast("int")
        return F.least(F.floor((F.col(name) - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    def low(name):
        lo, hi = r[f"{name}0"], r[f"{name}1"]
        return F.lit(lo).cast("double") + F.col(f"{name}_bin") * F.lit(0.0 if lo is None else (hi - lo) / bins)
    counts = pairs.groupBy(cell("x").alias("x_bin"), cell("y").alias("y_bin")).count()
    return counts.select("x_bin", "y_bin", low("x").alias("x_low"), low("y").alias("y_low"), "count")


def line_buckets(df: DataFrame, x: str, y: str, buckets: int = 200) -> DataFrame:
    """E6, bucketed: for each of ``buckets`` equal ranges of x that holds
    points, ``bucket, points, first_x, first_y, last_x, last_y, low_y, high_y``:
    the y at the lowest and highest x (of equal x the lowest and highest y) and
    the extremes of y, which is what a line of that width can show."""
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    pairs = df.select(dbl(column(x)).alias("x"), dbl(column(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    r = pairs.agg(F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    b = F.lit(0).cast("int")
    if r["x0"] is not None and r["x0"] != r["x1"]:
        b = F.least(F.floor((F.col("x") - F.lit(r["x0"])) / F.lit((r["x1"] - r["x0"]) / buckets)), F.lit(buckets - 1)).cast("int")
    p = F.struct("x", "y")
    return (pairs.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("points"), F.min(p).alias("f"), F.max(p).alias("l"),
                                                F.min("y").alias("low_y"), F.max("y").alias("high_y"))
            .select("bucket", "points", F.col("f.x").alias("first_x"), F.col("f.y").alias("first_y"), F.col("l.x").alias("last_x"),
                    F.col("l.y").alias("last_y"), "low_y", "high_y"))


def residual_data(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(predicted, residual = actual - predicted)."""
    return pred.select(F.col(prediction).alias("predicted"),
                       (dbl(label) - dbl(prediction)).alias("residual"))
