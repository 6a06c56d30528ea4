"""Rank-based tests (G7-G9) built on the ranked value table.

Average ranks come from ``ordered.ranked_values``: rows are first reduced to
distinct (group, value) counts with map-side aggregation, then ranked by a
range-partitioned prefix count, so ties (even one value holding a third of the
rows) collapse to one row instead of one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.functions import dist
from statsmith.functions.columns import TMP, dbl, ndtri, present, require_columns, require_numeric
from statsmith.operators import ordered
from statsmith.operators.tests_parametric import ALPHA, _fnan, _frame
from statsmith.session import stored


def rank_sums(df: DataFrame, group: str, value: str) -> tuple[DataFrame, float, int]:
    """Per-group rank sums: frame ``group, n, rank_sum`` plus the tie term
    sum(t^3 - t) and N.  Ranks are average ranks over all groups."""
    require_columns(df, [group])
    require_numeric(df, [value])
    x = dbl(value)
    clean = df.where(present(df, group) & x.isNotNull()).select(
        F.col(group).alias(TMP + "g"), x.alias(TMP + "x"))
    gv = clean.groupBy(TMP + "g", TMP + "x").agg(F.count(F.lit(1)).alias(TMP + "n"))
    rv = _weighted_ranks(gv)
    rv = stored(rv)     # distinct values with ranks, read twice
    tie = rv.agg(F.sum(F.col("cnt").cast("double") ** 3 - F.col("cnt").cast("double")).alias("tie"),
                 F.sum("cnt").alias("N")).first()
    sums = (gv.join(rv.select(TMP + "x", "avg_rank"), TMP + "x")
              .groupBy(TMP + "g").agg(F.sum(TMP + "n").alias("n"),
                                      F.sum(F.col(TMP + "n") * F.col("avg_rank")).alias("rank_sum"))
              .withColumnRenamed(TMP + "g", group))
    return sums, float(tie["tie"] or 0.0), int(tie["N"] or 0)


def _weighted_ranks(gv: DataFrame) -> DataFrame:
    """Average ranks of the distinct values of a (group, value, n) table, where
    each value's tie size is the sum of its per-group counts."""
    rv = ordered.ranked_values(gv, TMP + "x", weights={"w": F.col(TMP + "n")})
    # cnt counts (group, value) rows; the tie size of a value is its weight w
    return rv.select(TMP + "x", F.col("w").alias("cnt"),
                     (F.col("cum_w") + (F.col("w") + 1) / 2.0).alias("avg_rank"))


def _mwu_exact_sf(u: float, m: int, n: int) -> float:
    """P(U >= u) under H0 for sample sizes m, n without ties.  The counts are
    the coefficients of the Gaussian binomial [m+n choose m](q) = prod_{i=1..m}
    (1 - q^(n+i)) / (1 - q^i), built with vectorised polynomial steps."""
    if m > n:
        m, n = n, m
    L = m * n + 1
    c = np.zeros(L + n + m + 1)
    c[0] = 1.0
    for i in range(1, m + 1):
        s = n + i                       # multiply by (1 - q^s)
        c[s:] = c[s:] - c[:-s].copy()
        # divide by (1 - q^i): c[k] += c[k - i], a strided cumulative sum
        pad = (-len(c)) % i
        v = np.concatenate([c, np.zeros(pad)]).reshape(-1, i)
        c = np.cumsum(v, axis=0).reshape(-1)[:len(c)]
    c = c[:L]
    total = c.sum()
    k = int(math.ceil(u - 1e-9))
    return float(c[k:].sum() / total) if k < L else 0.0


def mannwhitney(df: DataFrame, group: str, value: str, method: str = "auto") -> DataFrame:
    """Mann-Whitney U, two-sided.  U1 is the statistic of group 1 (the
    smaller level).  ``method``: "exact" (an array of n1 * n2 counts on the
    driver), "asymptotic" (normal approximation with tie and continuity
    corrections), or "auto": exact when min(n1, n2) <= 8 without ties."""
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError("method must be auto, exact or asymptotic")
    sums, tie, N = rank_sums(df, group, value)
    rows = sums.orderBy(group).limit(3).collect()
    if len(rows) != 2:
        raise ValueError(f"{group} must have exactly 2 levels")
    (g1, n1, r1), (g2, n2, _) = [(r[group], r["n"], r["rank_sum"]) for r in rows]
    u1 = r1 - n1 * (n1 + 1) / 2.0
    u2 = n1 * n2 - u1
    umax = max(u1, u2)
    if method == "exact" or (method == "auto" and min(n1, n2) <= 8 and tie == 0):
        method = "exact"
        p = min(1.0, 2.0 * _mwu_exact_sf(umax, n1, n2))
    else:
        method = "asymptotic"
        mu = n1 * n2 / 2.0
        sd = math.sqrt(n1 * n2 / 12.0 * ((N + 1) - tie / (N * (N - 1))))
        z = (umax - mu - 0.5) / sd if sd > 0 else float("nan")
        p = min(1.0, 2.0 * dist.norm_sf(z)) if sd > 0 else float("nan")
    return _frame(df.sparkSession, dict(
        group1=str(g1), group2=str(g2), n1=n1, n2=n2, u_statistic=u1, method=method,
        p_value=_fnan(p), significant=(p < ALPHA) if not math.isnan(p) else None),
        "group1 string, group2 string, n1 long, n2 long, u_statistic double, method string, "
        "p_value double, significant boolean")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, chi-square with k-1 df."""
    sums, tie, N = rank_sums(df, group, value)
    r = sums.agg(F.count(F.lit(1)).alias("k"),
                 F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("s")).first()
    k = r["k"]
    if k is None or k < 2:
        raise ValueError("Kruskal-Wallis needs at least 2 groups")
    h = 12.0 / (N * (N + 1)) * r["s"] - 3.0 * (N + 1)
    corr = 1.0 - tie / (N ** 3 - N)
    h = h / corr if corr > 0 else float("nan")
    p = dist.chi2_sf(h, k - 1) if not math.isnan(h) else float("nan")
    return _frame(df.sparkSession, dict(
        k=k, n=N, h_statistic=_fnan(h), df=float(k - 1), p_value=_fnan(p),
        significant=(p < ALPHA) if not math.isnan(p) else None),
        "k long, n long, h_statistic double, df double, p_value double, significant boolean")


# Royston (1995) polynomial coefficients, ascending powers.
SW_AN = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SW_AN1 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_SMALL_GAMMA = [-2.273, 0.459]
SW_SMALL_MU = [0.5440, -0.39978, 0.025054, -6.714e-4]
SW_SMALL_SIGMA = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_LARGE_MU = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_LARGE_SIGMA = [-0.4803, -0.082676, 0.0030302]


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro(df: DataFrame, value: str, chunk: int = 100_000) -> DataFrame:
    """Shapiro-Wilk W and p (Royston 1995 approximation, AS R94 rules).

    Order statistics come from the ranked value table: each distinct value x
    with count t occupies sorted positions cum+1 .. cum+t.  Those runs are cut
    into chunks of at most ``chunk`` positions, spread round-robin over the
    cluster and exploded, so even a value repeated a billion times is expanded
    by many tasks.  m_i is the AS 241 normal quantile evaluated as a Column.
    The p-value is calibrated for 3 <= n <= 5000.
    """
    require_numeric(df, [value])
    x = dbl(value)
    base = df.where(x.isNotNull()).select(x.alias(TMP + "x"))
    mom = base.agg(F.count(F.lit(1)).alias("n"), F.var_pop(TMP + "x").alias("vp"),
                   F.min(TMP + "x").alias("lo"), F.max(TMP + "x").alias("hi")).first()
    n = mom["n"]
    if n < 3:
        raise ValueError("Shapiro-Wilk needs at least 3 values")
    ssq = mom["vp"] * n
    if mom["hi"] == mom["lo"] or ssq <= 0:
        return _frame(df.sparkSession, dict(n=n, w_statistic=1.0, p_value=1.0, significant=False),
                      "n long, w_statistic double, p_value double, significant boolean")
    rv = ordered.ranked_values(base, TMP + "x")
    P = df.sparkSession.sparkContext.defaultParallelism
    runs = rv.select(TMP + "x", "cum_before", "cnt",
                     F.explode(F.sequence(F.lit(0).cast("long"),
                                          F.floor((F.col("cnt") - 1) / chunk).cast("long"))).alias("ch"))
    runs = runs.repartition(max(P, 1))
    lo = F.col("cum_before") + F.col("ch") * chunk + 1
    hi = F.least(F.col("cum_before") + F.col("cnt"), lo + (chunk - 1))
    pos = runs.select(TMP + "x", F.explode(F.sequence(lo, hi)).alias("i"))
    fn = float(n)
    m = ndtri((F.col("i").cast("double") - 0.375) / (fn + 0.25))
    mn = dist.norm_ppf((n - 0.375) / (n + 0.25))
    mn1 = dist.norm_ppf((n - 1 - 0.375) / (n + 0.25))
    agg = pos.agg(
        F.sum(m * m).alias("S"),
        F.sum(F.when((F.col("i") > 2) & (F.col("i") < n - 1), m * F.col(TMP + "x"))).alias("mid"),
        F.max(F.when(F.col("i") == 1, F.col(TMP + "x"))).alias("x1"),
        F.max(F.when(F.col("i") == 2, F.col(TMP + "x"))).alias("x2"),
        F.max(F.when(F.col("i") == n - 1, F.col(TMP + "x"))).alias("xn1"),
        F.max(F.when(F.col("i") == n, F.col(TMP + "x"))).alias("xn")).first()
    w = _shapiro_w(n, agg["S"], agg["mid"] or 0.0, agg["x1"], agg["x2"], agg["xn1"], agg["xn"],
                   mn, mn1, ssq)
    p = shapiro_p(w, n)
    return _frame(df.sparkSession, dict(n=n, w_statistic=w, p_value=p, significant=p < ALPHA),
                  "n long, w_statistic double, p_value double, significant boolean")


def _shapiro_w(n, S, mid, x1, x2, xn1, xn, mn, mn1, ssq):
    if n == 3:
        a = math.sqrt(0.5)
        return min(1.0, (a * (xn - x1)) ** 2 / ssq)
    u = 1.0 / math.sqrt(n)
    an = mn / math.sqrt(S) + _poly(SW_AN, u)
    if n > 5:
        an1 = mn1 / math.sqrt(S) + _poly(SW_AN1, u)
        phi = (S - 2 * mn ** 2 - 2 * mn1 ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
        num = an * (xn - x1) + an1 * (xn1 - x2) + mid / math.sqrt(phi)
    else:
        phi = (S - 2 * mn ** 2) / (1 - 2 * an ** 2)
        # interior positions 2..n-1 all use m_i / sqrt(phi); positions 2 and n-1
        # are outside ``mid`` (which covers 3..n-2), add them back
        num = an * (xn - x1) + (mid + mn1 * (xn1 - x2)) / math.sqrt(phi)
    return min(1.0, num * num / ssq)


def shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, min(1.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    y = math.log1p(-w) if w < 1 else float("-inf")
    if math.isinf(y):
        return 1.0
    if n <= 11:
        gamma = _poly(SW_SMALL_GAMMA, n)
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        mu = _poly(SW_SMALL_MU, n)
        sigma = math.exp(_poly(SW_SMALL_SIGMA, n))
    else:
        ln = math.log(n)
        mu = _poly(SW_LARGE_MU, ln)
        sigma = math.exp(_poly(SW_LARGE_SIGMA, ln))
    return dist.norm_sf((y - mu) / sigma)
