"""Closed-form tests (G1-G6, G10): one aggregate job over the data, then
driver arithmetic on a result whose size is bounded by the number of groups.
Every test returns a one-row (or one-row-per-source) DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsmith.functions import dist
from statsmith.functions.columns import TMP, dbl, present, require_columns, require_numeric
from statsmith.operators.groups import crosstab
from statsmith.session import stored

ALPHA = 0.05


def _frame(spark: SparkSession, row: dict, schema: str) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(row[n] for n in names)], schema)


def _fnan(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)


def _ratio(effect: float, spread: float) -> float:
    """effect / spread; without spread an effect is infinite (p = 0), and no
    effect is undefined."""
    if spread and spread > 0:
        return effect / spread
    return math.copysign(math.inf, effect) if spread == 0 and effect else float("nan")


def _two_group_moments(df: DataFrame, group: str, value: str):
    require_columns(df, [group])
    require_numeric(df, [value])
    x = dbl(value)
    rows = (df.where(present(df, group) & x.isNotNull())
              .groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"),
                                  F.var_samp(x).alias("v"))
              .orderBy(group).limit(3).collect())
    if len(rows) != 2:
        raise ValueError(f"{group} must have exactly 2 levels (found {len(rows)}+)")
    return rows


def ttest_ind(df: DataFrame, group: str, value: str) -> DataFrame:
    """G1: pooled-variance two-sample t test, two-sided.  Group 1 is the
    smaller level (the reference takes the first level seen in row order).
    Without variance inside the groups t is infinite with p = 0 if the means
    differ, and NULL if they agree."""
    g1, g2 = _two_group_moments(df, group, value)
    n1, n2 = g1["n"], g2["n"]
    dfree = n1 + n2 - 2
    sp2 = ((n1 - 1) * (g1["v"] or 0.0) + (n2 - 1) * (g2["v"] or 0.0)) / dfree if dfree > 0 else float("nan")
    se = math.sqrt(sp2 * (1.0 / n1 + 1.0 / n2)) if dfree > 0 else float("nan")
    t = _ratio(g1["m"] - g2["m"], se)
    p = 0.0 if math.isinf(t) else dist.t_sf_two_sided(t, dfree)
    return _frame(df.sparkSession, dict(
        group1=str(g1[group]), group2=str(g2[group]), n1=n1, n2=n2, mean1=g1["m"], mean2=g2["m"],
        t_statistic=_fnan(t), df=float(dfree), p_value=_fnan(p),
        significant=(p < ALPHA) if not math.isnan(p) else None),
        "group1 string, group2 string, n1 long, n2 long, mean1 double, mean2 double, "
        "t_statistic double, df double, p_value double, significant boolean")


def ttest_rel(df: DataFrame, group: str, value: str, pair_key: str) -> DataFrame:
    """Paired t test.  Rows are paired through ``pair_key`` (the reference
    pairs by row position, which a distributed frame does not have); each key
    must hold at most one row per group; keys missing either value are left
    out.  d = value(group 1) - value(group 2), group 1 = smaller level."""
    require_columns(df, [group, pair_key])
    require_numeric(df, [value])
    levels = [r[0] for r in df.where(present(df, group)).select(group).distinct()
              .orderBy(group).limit(3).collect()]
    if len(levels) != 2:
        raise ValueError(f"{group} must have exactly 2 levels")
    l1, l2 = levels
    x = dbl(value)
    pairs = df.groupBy(pair_key).agg(
        F.count(F.when(F.col(group) == F.lit(l1), 1)).alias(TMP + "c1"),
        F.count(F.when(F.col(group) == F.lit(l2), 1)).alias(TMP + "c2"),
        F.max(F.when(F.col(group) == F.lit(l1), x)).alias(TMP + "a"),
        F.max(F.when(F.col(group) == F.lit(l2), x)).alias(TMP + "b"))
    d = F.col(TMP + "a") - F.col(TMP + "b")
    r = pairs.agg(F.max(F.greatest(TMP + "c1", TMP + "c2")).alias("dup"),
                  F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    if r["dup"] is not None and r["dup"] > 1:
        raise ValueError(f"{pair_key} is not unique within a group")
    n, m, s = r["n"], r["m"], r["s"]
    t = _ratio(m, s / math.sqrt(n)) if n and n > 1 else float("nan")
    p = 0.0 if math.isinf(t) else dist.t_sf_two_sided(t, n - 1) if n and n > 1 else float("nan")
    return _frame(df.sparkSession, dict(
        group1=str(l1), group2=str(l2), n_pairs=n, mean_diff=_fnan(m), t_statistic=_fnan(t),
        df=float(n - 1) if n else None, p_value=_fnan(p),
        significant=(p < ALPHA) if not math.isnan(p) else None),
        "group1 string, group2 string, n_pairs long, mean_diff double, t_statistic double, "
        "df double, p_value double, significant boolean")


def anova_oneway(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA.  Per-group (n, mean, var) in one aggregate; SSB and
    SSW from a second aggregate over that per-group frame (never collected,
    so any number of groups works)."""
    require_columns(df, [group])
    require_numeric(df, [value])
    x = dbl(value)
    gs = (df.where(present(df, group) & x.isNotNull())
            .groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"),
                                F.var_samp(x).alias("v"), F.sum(x).alias("s")))
    gs = stored(gs)    # one row per group, read twice below
    tot = gs.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum("s").alias("S")).first()
    k, N = tot["k"], tot["N"]
    if k is None or k < 2:
        raise ValueError("one-way ANOVA needs at least 2 groups")
    M = tot["S"] / N
    ss = gs.agg(F.sum(F.col("n") * (F.col("m") - F.lit(M)) ** 2).alias("ssb"),
                F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw")).first()
    ssb, ssw = ss["ssb"], ss["ssw"]
    d1, d2 = k - 1, N - k
    f = _ratio(ssb / d1, ssw / d2) if d2 > 0 else float("nan")
    p = 0.0 if math.isinf(f) else dist.f_sf(f, d1, d2) if not math.isnan(f) else float("nan")
    return _frame(df.sparkSession, dict(
        k=k, n=N, ss_between=ssb, ss_within=ssw, df_between=float(d1), df_within=float(d2),
        f_statistic=_fnan(f), p_value=_fnan(p), significant=(p < ALPHA) if not math.isnan(p) else None),
        "k long, n long, ss_between double, ss_within double, df_between double, df_within double, "
        "f_statistic double, p_value double, significant boolean")


def anova_twoway_table(df: DataFrame, f1: str, f2: str, value: str) -> DataFrame:
    """G4 sums of squares as a DataFrame: ``source, sum_sq, df, mean_sq, f``.

    One ``cube(f1, f2)`` pass gives every margin.  SS_A, SS_B and SS_AB follow
    the sequential (balanced-design) decomposition of the reference: SS_AB sums
    n_ab (m_ab - m_a - m_b + M)^2 over non-empty cells and SS_E is the
    remainder of SS_T; df_E = N - a*b even when cells are empty.  MS = 0 when
    df = 0; F = 0 when MS_E <= 0.
    """
    require_columns(df, [f1, f2])
    require_numeric(df, [value])
    x = dbl(value)
    clean = df.where(present(df, f1) & present(df, f2) & x.isNotNull())
    gid = TMP + "gid"
    cube = stored(clean.cube(f1, f2).agg(F.count(x).alias("n"), F.avg(x).alias("m"),
                                         F.var_pop(x).alias("vp"), F.grouping_id().alias(gid)))
    # margins: bounded by the number of cells
    grand = cube.where(F.col(gid) == 3).first()
    if grand is None:
        raise ValueError("two-way ANOVA needs complete rows")
    N, M, sst = grand["n"], grand["m"], grand["vp"] * grand["n"]
    Ml = F.lit(M)
    ma = cube.where(F.col(gid) == 1).select(f1, F.col("n").alias("na"), F.col("m").alias("ma"))
    mb = cube.where(F.col(gid) == 2).select(f2, F.col("n").alias("nb"), F.col("m").alias("mb"))
    cells = cube.where(F.col(gid) == 0).select(f1, f2, F.col("n").alias("nab"), F.col("m").alias("mab"))
    ra = ma.agg(F.sum(F.col("na") * (F.col("ma") - Ml) ** 2), F.count(F.lit(1))).first()
    rb = mb.agg(F.sum(F.col("nb") * (F.col("mb") - Ml) ** 2), F.count(F.lit(1))).first()
    rab = (cells.join(ma, f1).join(mb, f2)
                .agg(F.sum(F.col("nab") * (F.col("mab") - F.col("ma") - F.col("mb") + Ml) ** 2)).first())
    ss_a, a, ss_b, b, ss_ab = ra[0], ra[1], rb[0], rb[1], rab[0] or 0.0
    ss_e = sst - ss_a - ss_b - ss_ab
    df_a, df_b = float(a - 1), float(b - 1)
    df_ab, df_e = df_a * df_b, float(N - a * b)

    def ms(ssc, d):
        return ssc / d if d > 0 else 0.0

    mse = ms(ss_e, df_e)

    def fst(ssc, d):
        return ms(ssc, d) / mse if mse > 0 else 0.0

    rows = [(f1, ss_a, df_a, ms(ss_a, df_a), fst(ss_a, df_a)),
            (f2, ss_b, df_b, ms(ss_b, df_b), fst(ss_b, df_b)),
            (f"{f1}:{f2}", ss_ab, df_ab, ms(ss_ab, df_ab), fst(ss_ab, df_ab)),
            ("Residual", ss_e, df_e, mse, None)]
    return df.sparkSession.createDataFrame(
        rows, "source string, sum_sq double, df double, mean_sq double, f double")


def anova_twoway(df: DataFrame, f1: str, f2: str, value: str) -> DataFrame:
    """The ANOVA table with p-values (p = 1 when a df is not positive)."""
    rows = anova_twoway_table(df, f1, f2, value).collect()   # four rows
    res = rows[3]
    out = []
    for r in rows:
        if r["source"] == "Residual":
            p = None
        elif r["df"] <= 0 or res["df"] <= 0:
            p = 1.0
        else:
            p = dist.f_sf(r["f"], r["df"], res["df"]) if r["f"] > 0 else 1.0
        out.append((r["source"], r["sum_sq"], r["df"], r["mean_sq"], r["f"], p,
                    None if p is None else p < ALPHA))
    return df.sparkSession.createDataFrame(
        out, "source string, sum_sq double, df double, mean_sq double, f double, "
             "p_value double, significant boolean")


def chi_square_detail(df: DataFrame, a: str, b: str) -> DataFrame:
    """G5/G6 detail: ``a, b, observed, expected, contribution`` per cell
    (zero cells included).  Yates' correction (|O - E| reduced by
    min(0.5, |O - E|)) applies when the table has one degree of freedom."""
    cells = stored(crosstab(df, a, b))   # r x c cells, read three times
    shape = cells.agg(F.sum("count").alias("N"), F.count_distinct(a).alias("r"),
                      F.count_distinct(b).alias("c")).first()
    N, dof = shape["N"], (shape["r"] - 1) * (shape["c"] - 1)
    rt = cells.groupBy(a).agg(F.sum("count").alias("rt"))
    ct = cells.groupBy(b).agg(F.sum("count").alias("ct"))
    j = cells.join(rt, a).join(ct, b)
    e = F.col("rt") * F.col("ct") / F.lit(N)
    diff = F.abs(F.col("count") - e)
    adj = diff - F.least(F.lit(0.5), diff) if dof == 1 else diff
    contrib = F.lit(0.0) if dof == 0 else adj * adj / e
    return j.select(a, b, F.col("count").alias("observed"), e.alias("expected"),
                    contrib.alias("contribution"), F.lit(dof).cast("long").alias("dof"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square test of independence (one row).  From the
    observed cells alone: chi2 = N (sum O^2 / (R C) - 1); a table with one
    degree of freedom (four cells) goes through the detail for its correction."""
    require_columns(df, [a, b])
    nn = df.where(present(df, a) & present(df, b))
    x, y = TMP + "a", TMP + "b"
    cells = stored(nn.groupBy(F.col(f"`{a}`").alias(x), F.col(f"`{b}`").alias(y)).agg(F.count(F.lit(1)).alias("o")))
    rt, ct = (cells.groupBy(c).agg(F.sum("o").alias(t)) for c, t in ((x, "rt"), (y, "ct")))
    part = F.sum(F.col("o").cast("double") * F.col("o") / F.col("rt") / F.col("ct"))
    r = cells.join(rt, x).join(ct, y).agg(
        F.sum("o").alias("n"), part.alias("s"),
        ((F.count_distinct(x) - 1) * (F.count_distinct(y) - 1)).alias("dof")).first()
    dof = r["dof"] if r["n"] else 0
    if dof == 1:
        chi2 = chi_square_detail(df, a, b).agg(F.sum("contribution")).first()[0]
    else:
        chi2 = max(0.0, r["n"] * (r["s"] - 1.0)) if dof else 0.0
    p = 1.0 if not dof else dist.chi2_sf(chi2, dof)
    return _frame(df.sparkSession, dict(
        chi2=float(chi2 or 0.0), dof=int(dof or 0), n=r["n"], p_value=p,
        yates=bool(dof == 1), significant=p < ALPHA),
        "chi2 double, dof long, n long, p_value double, yates boolean, significant boolean")


def cronbach_alpha(df: DataFrame, cols: list[str]) -> DataFrame:
    """alpha = k/(k-1) (1 - sum var_i / var(sum)), listwise, ddof 1."""
    require_numeric(df, cols)
    if len(cols) < 2:
        raise ValueError("Cronbach's alpha needs at least 2 variables")
    c = df.na.drop(subset=cols)
    total = sum((dbl(x) for x in cols[1:]), dbl(cols[0]))
    r = c.agg(F.count(F.lit(1)).alias("n"), *[F.var_samp(dbl(x)).alias(f"v{i}") for i, x in enumerate(cols)],
              F.var_samp(total).alias("vt")).first()
    k = len(cols)
    sv = sum(r[f"v{i}"] or 0.0 for i in range(k))
    alpha = (k / (k - 1)) * (1 - sv / r["vt"]) if r["vt"] else float("nan")
    return _frame(df.sparkSession, dict(n_items=k, n=r["n"], alpha=_fnan(alpha),
                                        interpretation=alpha_band(alpha)),
                  "n_items long, n long, alpha double, interpretation string")


# Interpretation bands for Cronbach's alpha (lower bound, label).
ALPHA_BANDS = [(0.9, "Excellent"), (0.8, "Good"), (0.7, "Acceptable"), (0.6, "Questionable"),
               (0.5, "Poor")]


def alpha_band(a: float) -> str:
    if a is None or math.isnan(a):
        return "Unacceptable"
    for lo, name in ALPHA_BANDS:
        if a >= lo:
            return name
    return "Unacceptable"
