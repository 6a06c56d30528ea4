"""The statistical-analysis entry point: one test, several group variables.

Mirrors the reference's dispatch: reliability tests (cronbach, bartlett, kmo)
take the group list as their variables; the two-way ANOVA takes exactly two
group variables; Shapiro-Wilk runs once on the value column; every other test
runs once per group variable, and a failure of one (e.g. a variable without
exactly two levels for a t test) becomes an ``error`` row instead of stopping
the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.operators import multivariate, tests_parametric as TP, tests_rank as TR
from statsmith.operators.groups import stack

# The test names offered by the reference.
TESTS = ("ttest", "ttest_paired", "anova", "anova_two", "chi_square", "mannwhitney", "kruskal",
         "shapiro", "cronbach", "bartlett", "kmo")


def _one(df: DataFrame, test: str, group: str, value: str, pair_key: str | None) -> DataFrame:
    if test == "ttest":
        return TP.ttest_ind(df, group, value)
    if test == "ttest_paired":
        if pair_key is None:
            raise ValueError("the paired t test needs pair_key")
        return TP.ttest_rel(df, group, value, pair_key)
    if test == "anova":
        return TP.anova_oneway(df, group, value)
    if test == "chi_square":
        return TP.chi_square(df, group, value)
    if test == "mannwhitney":
        return TR.mannwhitney(df, group, value)
    if test == "kruskal":
        return TR.kruskal(df, group, value)
    raise ValueError(f"unknown test {test!r}")


def run_test(df: DataFrame, test: str, groups: list[str] | str, value: str | None = None,
             pair_key: str | None = None) -> DataFrame:
    """Run ``test``; returns the result rows with ``group_variable`` and
    ``error`` (NULL on success) columns."""
    if test not in TESTS:
        raise ValueError(f"test must be one of {TESTS}")
    gl = [groups] if isinstance(groups, str) else list(groups or [])
    spark = df.sparkSession
    if test in ("cronbach", "bartlett", "kmo"):
        fn = {"cronbach": TP.cronbach_alpha, "bartlett": multivariate.bartlett_sphericity,
              "kmo": multivariate.kmo}[test]
        return fn(df, gl).withColumn("group_variable", F.lit(",".join(gl))) \
                         .withColumn("error", F.lit(None).cast("string"))
    if test == "anova_two":
        if len(gl) != 2:
            raise ValueError("two-way ANOVA needs exactly 2 group variables")
        return TP.anova_twoway(df, gl[0], gl[1], value).withColumn("group_variable", F.lit(",".join(gl))) \
                 .withColumn("error", F.lit(None).cast("string"))
    if test == "shapiro":
        return TR.shapiro(df, value).withColumn("group_variable", F.lit(None).cast("string")) \
                 .withColumn("error", F.lit(None).cast("string"))
    parts = []
    for g in gl:
        try:
            r = _one(df, test, g, value, pair_key)
            parts.append(r.withColumn("group_variable", F.lit(g)).withColumn("error", F.lit(None).cast("string")))
        except ValueError as e:             # refused inputs are results; failures are not
            parts.append(spark.createDataFrame([(g, f"{type(e).__name__}: {e}")],
                                               "group_variable string, error string"))
    return stack(parts)
