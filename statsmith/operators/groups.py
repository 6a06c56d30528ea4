"""Grouping and aggregation.

Group statistics for several group variables run as ONE ``GROUPING SETS``
aggregate (one scan, one shuffle, map-side partial aggregation), instead of
one aggregate per variable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statsmith.functions.columns import TMP, dbl, present, require_columns, require_numeric
from statsmith.session import stored


def _moments(x):
    return [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max")]


def group_stats(df: DataFrame, groups: list[str] | str, value: str) -> DataFrame:
    """per group variable and level: ``group_variable, level, count, mean,
    std, min, max`` (count = non-NULL values; NULL levels dropped)."""
    groups = [groups] if isinstance(groups, str) else list(groups)
    require_columns(df, groups)
    require_numeric(df, [value])
    x = dbl(value)
    if len(groups) == 1:
        g = groups[0]
        return (df.where(present(df, g)).groupBy(g).agg(*_moments(x))
                  .select(F.lit(g).alias("group_variable"), F.col(g).cast("string").alias("level"),
                          "count", "mean", "std", "min", "max"))
    sets = [[F.col(g)] for g in groups]
    gid = TMP + "gid"
    agg = df.groupingSets(sets, *groups).agg(*_moments(x), F.grouping_id().alias(gid))
    n = len(groups)
    name, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, g in enumerate(groups):
        mask = (1 << n) - 1 - (1 << (n - 1 - i))     # every column but g aggregated away
        name = F.when(F.col(gid) == mask, F.lit(g)).otherwise(name)
        level = F.when(F.col(gid) == mask, F.col(g).cast("string")).otherwise(level)
    # one projection over the single aggregate: no per-variable branches, so
    # the table is scanned and shuffled once for all group variables
    return (agg.select(name.alias("group_variable"), level.alias("level"),
                       "count", "mean", "std", "min", "max")
               .where(F.col("level").isNotNull()))


def group_stats_2way(df: DataFrame, f1: str, f2: str, value: str) -> DataFrame:
    """statistics per (f1, f2) cell, NULL keys dropped."""
    require_columns(df, [f1, f2])
    require_numeric(df, [value])
    return (df.where(present(df, f1) & present(df, f2))
              .groupBy(f1, f2).agg(*_moments(dbl(value))))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """counts per non-NULL value."""
    return df.where(present(df, col)).groupBy(col).count()


def distinct_levels(df: DataFrame, col: str) -> DataFrame:
    """distinct non-NULL levels (NULL is not a level here: documented fix)."""
    return df.where(present(df, col)).select(col).distinct()


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """contingency counts in long form ``a, b, count`` including zero
    cells.  Each level of ``a`` gets the numbers of the levels of ``b``, which
    join the numbered levels and then the observed counts: no pivot, so any
    level text and any number of levels will do."""
    require_columns(df, [a, b])
    nn = df.where(present(df, a) & present(df, b))
    x, y, n = TMP + "a", TMP + "b", TMP + "n"
    seen = stored(nn.groupBy(F.col(f"`{a}`").alias(x), F.col(f"`{b}`").alias(y)).agg(F.count(F.lit(1)).alias("count")))
    lb = seen.select(y).distinct().withColumn(n, F.row_number().over(Window.orderBy(y)))
    levels = lb.count()
    if not levels:
        return seen.select(F.col(x).alias(a), F.col(y).alias(b), "count")
    every = seen.select(x).distinct().withColumn(n, F.explode(F.sequence(F.lit(1), F.lit(levels)))).join(lb, n)
    return every.join(seen, [x, y], "left").select(
        F.col(x).alias(a), F.col(y).alias(b), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def stack(frames: list[DataFrame]) -> DataFrame:
    """F8: UNION ALL by column name."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def stats_beside_test(df: DataFrame, test: str, groups_: list[str] | str | None = None,
                      value: str | None = None) -> DataFrame:
    """The group-statistics frame shown next to a test result.

    Reliability tests (cronbach, bartlett, kmo) describe their variables;
    shapiro summarises its one value column; the two-way ANOVA gives per-cell
    statistics; every other test gives per-level statistics per group
    variable."""
    from statsmith.operators.profile import describe_transposed, value_stats
    gl = [groups_] if isinstance(groups_, str) else list(groups_ or [])
    if test in ("cronbach", "bartlett", "kmo"):
        return describe_transposed(df, gl)
    if test == "shapiro":
        return value_stats(df, value)
    if test in ("anova_two", "anova_twoway"):
        if len(gl) != 2:
            raise ValueError("two-way ANOVA needs exactly 2 group variables")
        return group_stats_2way(df, gl[0], gl[1], value)
    return group_stats(df, gl, value)
