"""Registered queries: one per operator of the inventory, each reading the
driver's tables (whole) at ``sf_dir``, plus the DuckDB SQL that computes the
same result independently.  Statistics are rounded to 6 decimals on both
sides; p-values (which need distribution functions DuckDB lacks) are checked
in unit tests, not here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsmith.operators import (chartdata, clean, encode, groups, multivariate, ordered,
                                 profile, reduce, tests_parametric, tests_rank)
from statsmith.plans.fixtures import GAP_RULE_T, GAP_RULE_V, gappy, round_doubles, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB rounds a
    tiny negative double to -0.0 where Spark gives 0.0; adding 0.0 turns -0.0
    into +0.0 and leaves every other value unchanged."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _positive_zero_rounds(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _positive_zero_rounds(sql.strip())
        return fn
    return wrap


R = round_doubles


def _ss2(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sums of squares reach ~1e7-1e8 here: compared at 2 decimals, since the
    summation order (Spark vs DuckDB) moves them by ~1e-14 relative."""
    return df.withColumns({c: F.round(F.col(c), 2) for c in cols})
GAPPY = (f"gappy AS (SELECT event_id, {GAP_RULE_T} AS event_type, {GAP_RULE_V} AS v FROM events)")
LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS variable, count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM {tbl}")
    return " UNION ALL ".join(parts)


# ------------------------------------------------------------------ profiling
@query("describe_lineitem", _describe_sql("lineitem", LI_NUM))
def q_describe_lineitem(spark, d):
    return R(profile.describe_transposed(table(spark, d, "lineitem"), LI_NUM))


_PART_NUM = ["p_partkey", "p_size", "p_retailprice"]


def _describe_wide_sql() -> str:
    stats = [("count", "count({x})"), ("mean", "avg({x})"), ("std", "stddev_samp({x})"),
             ("min", "min({x})"), ("q25", "quantile_cont({x}, 0.25)"),
             ("q50", "quantile_cont({x}, 0.5)"), ("q75", "quantile_cont({x}, 0.75)"),
             ("max", "max({x})")]
    rows = []
    for s, f in stats:
        cols = ", ".join(f"round(CAST({f.format(x=f'CAST({c} AS DOUBLE)')} AS DOUBLE), 6) AS {c}"
                         for c in _PART_NUM)
        rows.append(f"SELECT '{s}' AS stat, {cols} FROM part")
    return " UNION ALL ".join(rows)


@query("describe_part_wide", _describe_wide_sql())
def q_describe_wide(spark, d):
    return R(profile.describe(table(spark, d, "part").select(*_PART_NUM)))


_ORD_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
              ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("info_orders", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS non_null, '{t}' AS dtype, "
    f"count(*) AS n_rows FROM orders" for i, (c, t) in enumerate(_ORD_TYPES)))
def q_info_orders(spark, d):
    return profile.info(table(spark, d, "orders"))


@query("missing_summary", f"""
WITH {GAPPY}
SELECT * FROM (
  SELECT 'event_id' AS "column", count(*) - count(event_id) AS missing_count,
         round((count(*) - count(event_id)) * 100.0 / count(*), 6) AS percentage FROM gappy
  UNION ALL SELECT 'event_type', count(*) - count(event_type),
         round((count(*) - count(event_type)) * 100.0 / count(*), 6) FROM gappy
  UNION ALL SELECT 'v', count(*) - count(v), round((count(*) - count(v)) * 100.0 / count(*), 6) FROM gappy
) WHERE missing_count > 0""")
def q_missing_summary(spark, d):
    return R(profile.missing_summary(gappy(spark, d)))


@query("numeric_projection", "SELECT p_partkey, p_size, p_retailprice FROM part")
def q_numeric_projection(spark, d):
    return profile.numeric_projection(table(spark, d, "part"))


@query("string_projection", "SELECT p_name, p_brand, p_type FROM part")
def q_string_projection(spark, d):
    return profile.string_projection(table(spark, d, "part"))


@query("value_stats_acctbal", """
SELECT count(c_acctbal) AS count, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std,
       round(min(c_acctbal), 6) AS min, round(max(c_acctbal), 6) AS max FROM customer""")
def q_value_stats(spark, d):
    return R(profile.value_stats(table(spark, d, "customer"), "c_acctbal"))


# ------------------------------------------------------------------ cleaning
@query("drop_column", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def q_drop_column(spark, d):
    return clean.drop_column(table(spark, d, "supplier"), "s_name")


@query("projection", "SELECT s_name, s_acctbal FROM supplier")
def q_projection(spark, d):
    return clean.project(table(spark, d, "supplier"), ["s_name", "s_acctbal"])


@query("fill_drop", f"WITH {GAPPY} SELECT event_id, event_type, v FROM gappy WHERE v IS NOT NULL")
def q_fill_drop(spark, d):
    return clean.fill_missing(gappy(spark, d), "v", "drop")


@query("fill_mean", f"""WITH {GAPPY}
SELECT event_id, event_type, round(coalesce(v, (SELECT avg(v) FROM gappy)), 6) AS v FROM gappy""")
def q_fill_mean(spark, d):
    return R(clean.fill_missing(gappy(spark, d), "v", "mean"))


@query("fill_median", f"""WITH {GAPPY}
SELECT event_id, event_type, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM gappy)), 6) AS v FROM gappy""")
def q_fill_median(spark, d):
    return R(clean.fill_missing(gappy(spark, d), "v", "median"))


@query("fill_mode", f"""WITH {GAPPY},
m AS (SELECT event_type FROM gappy WHERE event_type IS NOT NULL GROUP BY event_type
      ORDER BY count(*) DESC, event_type ASC LIMIT 1)
SELECT event_id, coalesce(event_type, (SELECT event_type FROM m)) AS event_type, round(v, 6) AS v FROM gappy""")
def q_fill_mode(spark, d):
    return R(clean.fill_missing(gappy(spark, d), "event_type", "mode"))


_ORDERED = f"""WITH {GAPPY},
r AS (SELECT event_id, event_type, v, row_number() OVER (ORDER BY event_id) AS pos FROM gappy),
k AS (SELECT pos, v, lag(pos) OVER (ORDER BY pos) AS pp, lag(v) OVER (ORDER BY pos) AS pv,
             lead(pos) OVER (ORDER BY pos) AS np, lead(v) OVER (ORDER BY pos) AS nv
      FROM r WHERE v IS NOT NULL),
n AS (SELECT event_id, event_type, v, pos,
             max(CASE WHEN v IS NOT NULL THEN pos END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p1,
             min(CASE WHEN v IS NOT NULL THEN pos END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n1
      FROM r),
j AS (SELECT n.event_id, n.event_type, n.v, CAST(n.pos AS DOUBLE) AS x,
             a.pos AS xa, a.v AS ya, a.pp AS xb, a.pv AS yb, b.pos AS xc, b.v AS yc, b.np AS xd, b.nv AS yd
      FROM n LEFT JOIN k a ON a.pos = n.p1 LEFT JOIN k b ON b.pos = n.n1)"""

_LINEAR = ("CASE WHEN v IS NOT NULL THEN v WHEN ya IS NOT NULL AND yc IS NOT NULL "
           "THEN ya + (yc - ya) * ((x - xa) / CAST(xc - xa AS DOUBLE)) WHEN ya IS NOT NULL THEN ya END")
_CUBIC = ("CASE WHEN v IS NOT NULL THEN v WHEN ya IS NOT NULL AND yb IS NOT NULL AND yc IS NOT NULL "
          "AND yd IS NOT NULL THEN "
          "yb * (x - xa) / (xb - xa) * (x - xc) / (xb - xc) * (x - xd) / (xb - xd) + "
          "ya * (x - xb) / (xa - xb) * (x - xc) / (xa - xc) * (x - xd) / (xa - xd) + "
          "yc * (x - xb) / (xc - xb) * (x - xa) / (xc - xa) * (x - xd) / (xc - xd) + "
          "yd * (x - xb) / (xd - xb) * (x - xa) / (xd - xa) * (x - xc) / (xd - xc) "
          f"ELSE ({_LINEAR}) END")


@query("fill_ffill", _ORDERED + " SELECT event_id, event_type, round(coalesce(v, ya), 6) AS v FROM j")
def q_fill_ffill(spark, d):
    return R(clean.fill_missing(gappy(spark, d), "v", "ffill", order_by="event_id"))


@query("fill_bfill", _ORDERED + " SELECT event_id, event_type, round(coalesce(v, yc), 6) AS v FROM j")
def q_fill_bfill(spark, d):
    return R(clean.fill_missing(gappy(spark, d), "v", "bfill", order_by="event_id"))


@query("fill_linear", _ORDERED + f" SELECT event_id, event_type, round({_LINEAR}, 6) AS v FROM j")
def q_fill_linear(spark, d):
    return R(clean.fill_missing(gappy(spark, d), "v", "linear_interpolate", order_by="event_id"))


@query("fill_cubic", _ORDERED + f" SELECT event_id, event_type, round({_CUBIC}, 6) AS v FROM j")
def q_fill_cubic(spark, d):
    return R(clean.fill_missing(gappy(spark, d), "v", "cubic_spline", order_by="event_id"))


@query("fill_ffill_by_type", f"""WITH {GAPPY}
SELECT event_id, event_type, round(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS v FROM gappy""")
def q_fill_ffill_by_type(spark, d):
    g = gappy(spark, d)
    return R(ordered.fill_forward(g, "v", "event_id", partition_by="event_type"))


@query("outlier_iqr", """
WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders, b
WHERE o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)""")
def q_outlier_iqr(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R(clean.remove_outliers(o, "o_totalprice", "IQR"))


@query("outlier_zscore", """
WITH b AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
SELECT event_id, round(value, 6) AS value FROM events, b WHERE abs((value - m) / s) <= 3""")
def q_outlier_zscore(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return R(clean.remove_outliers(e, "value", "zscore"))


@query("outlier_report", """
WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT count(*) AS n_before,
       count(*) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS n_after,
       count(*) - count(*) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS removed
FROM orders, b""")
def q_outlier_report(spark, d):
    return clean.outlier_report(table(spark, d, "orders"), "o_totalprice", "IQR")


@query("complete_cases", f"""WITH {GAPPY}
SELECT event_id, event_type, round(v, 6) AS v FROM gappy WHERE event_type IS NOT NULL AND v IS NOT NULL""")
def q_complete_cases(spark, d):
    return R(clean.complete_cases(gappy(spark, d), ["event_type", "v"]))


# ------------------------------------------------------------------ encoding
@query("label_encode_priority", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority FROM orders""")
def q_label_encode(spark, d):
    enc, _ = encode.label_encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"),
                                 "o_orderpriority")
    return enc


@query("label_mapping_status", """
SELECT o_orderstatus AS class, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def q_label_mapping(spark, d):
    return encode.label_mapping(table(spark, d, "orders"), "o_orderstatus")


@query("encode_strings_part", """
SELECT p_partkey,
  CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS p_name,
  CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand,
  CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type FROM part""")
def q_encode_strings(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return encode.encode_strings(p)


_SCALE_BASE = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


@query("scale_standard", f"""
WITH s AS (SELECT avg(p_partkey) AS m1, stddev_pop(p_partkey) AS s1, avg(p_size) AS m2, stddev_pop(p_size) AS s2 FROM part)
SELECT round((p_partkey - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS p_partkey, p_name,
       round((p_size - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice
FROM part, s""")
def q_scale_standard(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return R(encode.scale(p, "standard", target="p_retailprice"))


@query("scale_minmax", """
WITH s AS (SELECT min(p_partkey) AS a1, max(p_partkey) - min(p_partkey) AS r1,
                  min(p_size) AS a2, max(p_size) - min(p_size) AS r2 FROM part)
SELECT round((p_partkey - a1) / CASE WHEN r1 = 0 THEN 1 ELSE CAST(r1 AS DOUBLE) END, 6) AS p_partkey, p_name,
       round((p_size - a2) / CASE WHEN r2 = 0 THEN 1 ELSE CAST(r2 AS DOUBLE) END, 6) AS p_size,
       round(p_retailprice, 6) AS p_retailprice
FROM part, s""")
def q_scale_minmax(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return R(encode.scale(p, "minmax", target="p_retailprice"))


@query("scale_robust", """
WITH s AS (SELECT quantile_cont(p_partkey, 0.5) AS m1, quantile_cont(p_partkey, 0.75) - quantile_cont(p_partkey, 0.25) AS r1,
                  quantile_cont(p_size, 0.5) AS m2, quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) AS r2 FROM part)
SELECT round((p_partkey - m1) / CASE WHEN r1 = 0 THEN 1 ELSE r1 END, 6) AS p_partkey, p_name,
       round((p_size - m2) / CASE WHEN r2 = 0 THEN 1 ELSE r2 END, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice
FROM part, s""")
def q_scale_robust(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return R(encode.scale(p, "robust", target="p_retailprice"))


@query("one_vs_rest_status", """
SELECT o_orderkey, o_orderstatus,
  CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_is_F,
  CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_is_O,
  CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_is_P FROM orders""")
def q_one_vs_rest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return encode.one_vs_rest(o, "o_orderstatus")


# ------------------------------------------------------------------ chart data
@query("hist_price", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
e AS (SELECT lo, hi, (hi - lo) / 30 AS step, 30 / (hi - lo) AS norm FROM b),
raw AS (SELECT l_extendedprice AS x, least(CAST(floor((l_extendedprice - lo) * norm) AS INTEGER), 29) AS b,
               lo, hi, step FROM lineitem, e),
fix AS (SELECT CASE WHEN x < (CASE WHEN b >= 30 THEN hi ELSE b * step + lo END) THEN b - 1
                    WHEN x >= (CASE WHEN b + 1 >= 30 THEN hi ELSE (b + 1) * step + lo END) AND b <> 29 THEN b + 1
                    ELSE b END AS bin FROM raw),
c AS (SELECT bin, count(*) AS cnt FROM fix GROUP BY bin)
SELECT CAST(g.i AS INTEGER) AS bin, round(CASE WHEN g.i >= 30 THEN hi ELSE g.i * step + lo END, 6) AS lower,
       round(CASE WHEN g.i + 1 >= 30 THEN hi ELSE (g.i + 1) * step + lo END, 6) AS upper,
       coalesce(c.cnt, 0) AS count
FROM range(30) g(i) CROSS JOIN e LEFT JOIN c ON c.bin = g.i""")
def q_hist_price(spark, d):
    return R(chartdata.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30))


@query("box_value", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
                  quantile_cont(value, 0.75) AS q3 FROM events)
SELECT round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       count(*) FILTER (WHERE NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS n_fliers,
       round(avg(value), 6) AS mean, count(value) AS n
FROM events, q GROUP BY q1, med, q3""")
def q_box_value(spark, d):
    return R(chartdata.boxplot_stats(table(spark, d, "events"), "value"))


@query("box_fliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(value, 6) AS value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def q_box_fliers(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return R(chartdata.boxplot_fliers(e, "value"))


@query("bar_type", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def q_bar_type(spark, d):
    return chartdata.bar_counts(table(spark, d, "events"), "event_type")


@query("pie_type", """
SELECT event_type, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS percentage
FROM events GROUP BY event_type""")
def q_pie_type(spark, d):
    return R(chartdata.pie_shares(table(spark, d, "events"), "event_type"))


@query("scatter_part", "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part")
def q_scatter(spark, d):
    return R(chartdata.scatter_points(table(spark, d, "part"), "p_partkey", "p_retailprice"))


@query("line_part", "SELECT p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def q_line(spark, d):
    return R(chartdata.line_points(table(spark, d, "part"), "p_size", "p_retailprice"))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix_lineitem", " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in _CORR_COLS for b in _CORR_COLS))
def q_corr(spark, d):
    return R(chartdata.correlation_matrix(table(spark, d, "lineitem"), _CORR_COLS))


# ------------------------------------------------------------------ grouping
@query("group_stats_1", """
SELECT 'l_returnflag' AS group_variable, l_returnflag AS level, count(l_extendedprice) AS count,
       round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std,
       round(min(l_extendedprice), 6) AS min, round(max(l_extendedprice), 6) AS max
FROM lineitem GROUP BY l_returnflag""")
def q_group_stats_1(spark, d):
    return R(groups.group_stats(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("group_stats_multi", """
SELECT 'l_returnflag' AS group_variable, l_returnflag AS level, count(l_quantity) AS count,
       round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
       round(min(l_quantity), 6) AS min, round(max(l_quantity), 6) AS max FROM lineitem GROUP BY l_returnflag
UNION ALL
SELECT 'l_linestatus', l_linestatus, count(l_quantity), round(avg(l_quantity), 6), round(stddev_samp(l_quantity), 6),
       round(min(l_quantity), 6), round(max(l_quantity), 6) FROM lineitem GROUP BY l_linestatus""")
def q_group_stats_multi(spark, d):
    return R(groups.group_stats(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"))


@query("group_stats_2way", """
SELECT l_returnflag, l_linestatus, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean,
       round(stddev_samp(l_quantity), 6) AS std, round(min(l_quantity), 6) AS min, round(max(l_quantity), 6) AS max
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_group_stats_2way(spark, d):
    return R(groups.group_stats_2way(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"))


@query("crosstab_partkey", """
WITH a AS (SELECT DISTINCT l_partkey FROM lineitem), b AS (SELECT DISTINCT l_returnflag FROM lineitem),
c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_returnflag, coalesce(n, 0) AS count
FROM a CROSS JOIN b LEFT JOIN c USING (l_partkey, l_returnflag)""")
def q_crosstab_partkey(spark, d):
    return groups.crosstab(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("chi_square_partkey", """
WITH c AS (SELECT l_partkey AS a, l_returnflag AS b, count(*) AS o FROM lineitem GROUP BY ALL),
m AS (SELECT o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS k, a, b FROM c)
SELECT round(sum(o) * (sum(o * o / CAST(r AS DOUBLE) / k) - 1), 4) AS chi2,
       (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, CAST(sum(o) AS BIGINT) AS n FROM m""")
def q_chi_square_partkey(spark, d):
    r = tests_parametric.chi_square(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")
    return r.select(F.round("chi2", 4).alias("chi2"), "dof", "n")


@query("crosstab_flags", """
WITH a AS (SELECT DISTINCT l_returnflag FROM lineitem), b AS (SELECT DISTINCT l_linestatus FROM lineitem),
c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.l_returnflag, b.l_linestatus, coalesce(c.n, 0) AS count
FROM a CROSS JOIN b LEFT JOIN c ON c.l_returnflag = a.l_returnflag AND c.l_linestatus = b.l_linestatus""")
def q_crosstab(spark, d):
    return groups.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("value_counts_segment", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment")
def q_value_counts(spark, d):
    return groups.value_counts(table(spark, d, "customer"), "c_mktsegment")


@query("distinct_levels_brand", "SELECT DISTINCT p_brand FROM part")
def q_distinct_levels(spark, d):
    return groups.distinct_levels(table(spark, d, "part"), "p_brand")


# ------------------------------------------------------------------ tests
_TT = """
WITH g AS (SELECT l_linestatus AS grp, count(l_extendedprice) AS n, avg(l_extendedprice) AS m,
                  var_samp(l_extendedprice) AS v FROM lineitem GROUP BY l_linestatus),
a AS (SELECT * FROM g WHERE grp = (SELECT min(grp) FROM g)), b AS (SELECT * FROM g WHERE grp = (SELECT max(grp) FROM g))
SELECT a.grp AS group1, b.grp AS group2, a.n AS n1, b.n AS n2, round(a.m, 6) AS mean1, round(b.m, 6) AS mean2,
       round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6)
         AS t_statistic, CAST(a.n + b.n - 2 AS DOUBLE) AS df
FROM a, b"""


@query("ttest_ind", _TT)
def q_ttest_ind(spark, d):
    r = tests_parametric.ttest_ind(table(spark, d, "lineitem"), "l_linestatus", "l_extendedprice")
    return R(r.drop("p_value", "significant"))


@query("ttest_rel", """
WITH u AS (SELECT user_id, event_type, avg(value) AS mv FROM events
           WHERE event_type IN ('view', 'purchase') GROUP BY user_id, event_type),
p AS (SELECT user_id, max(mv) FILTER (WHERE event_type = 'purchase') AS a,
             max(mv) FILTER (WHERE event_type = 'view') AS b FROM u GROUP BY user_id),
d AS (SELECT a - b AS dd FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT 'purchase' AS group1, 'view' AS group2, count(dd) AS n_pairs, round(avg(dd), 6) AS mean_diff,
       round(avg(dd) / (stddev_samp(dd) / sqrt(count(dd))), 6) AS t_statistic, CAST(count(dd) - 1 AS DOUBLE) AS df
FROM d""")
def q_ttest_rel(spark, d):
    ev = table(spark, d, "events").where(F.col("event_type").isin("view", "purchase"))
    per_user = ev.groupBy("user_id", "event_type").agg(F.avg("value").alias("mv"))
    r = tests_parametric.ttest_rel(per_user, "event_type", "mv", "user_id")
    return R(r.drop("p_value", "significant"))


@query("anova_oneway", """
WITH g AS (SELECT l_returnflag, count(l_quantity) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v
           FROM lineitem GROUP BY l_returnflag),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS gm FROM g),
s AS (SELECT sum(n * (m - gm) * (m - gm)) AS ssb, sum((n - 1) * coalesce(v, 0)) AS ssw FROM g, t)
SELECT k, CAST(nn AS BIGINT) AS n, round(ssb, 2) AS ss_between, round(ssw, 2) AS ss_within,
       CAST(k - 1 AS DOUBLE) AS df_between, CAST(nn - k AS DOUBLE) AS df_within,
       round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS f_statistic
FROM s, t""")
def q_anova_oneway(spark, d):
    r = tests_parametric.anova_oneway(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return R(_ss2(r.drop("p_value", "significant"), ["ss_between", "ss_within"]))


@query("anova_twoway", """
WITH c AS (SELECT l_returnflag AS fa, l_linestatus AS fb, GROUPING(l_returnflag, l_linestatus) AS gid,
                  count(l_quantity) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS vp
           FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)),
g AS (SELECT n AS nn, m AS gm, vp * n AS sst FROM c WHERE gid = 3),
ma AS (SELECT fa, n AS na, m AS ma FROM c WHERE gid = 1), mb AS (SELECT fb, n AS nb, m AS mb FROM c WHERE gid = 2),
ssa AS (SELECT sum(na * (ma - gm) * (ma - gm)) AS ss, count(*) AS lv FROM ma, g),
ssb AS (SELECT sum(nb * (mb - gm) * (mb - gm)) AS ss, count(*) AS lv FROM mb, g),
ssab AS (SELECT sum(c.n * (c.m - ma.ma - mb.mb + gm) * (c.m - ma.ma - mb.mb + gm)) AS ss
         FROM c JOIN ma ON c.fa = ma.fa JOIN mb ON c.fb = mb.fb, g WHERE c.gid = 0),
t AS (SELECT ssa.ss AS s_a, ssb.ss AS s_b, ssab.ss AS s_ab, sst - ssa.ss - ssb.ss - ssab.ss AS s_e,
             CAST(ssa.lv - 1 AS DOUBLE) AS d_a, CAST(ssb.lv - 1 AS DOUBLE) AS d_b,
             CAST((ssa.lv - 1) * (ssb.lv - 1) AS DOUBLE) AS d_ab, CAST(nn - ssa.lv * ssb.lv AS DOUBLE) AS d_e
      FROM ssa, ssb, ssab, g)
SELECT 'l_returnflag' AS source, round(s_a, 2) AS sum_sq, d_a AS df, round(s_a / d_a, 6) AS mean_sq,
       round((s_a / d_a) / (s_e / d_e), 6) AS f FROM t
UNION ALL SELECT 'l_linestatus', round(s_b, 2), d_b, round(s_b / d_b, 6), round((s_b / d_b) / (s_e / d_e), 6) FROM t
UNION ALL SELECT 'l_returnflag:l_linestatus', round(s_ab, 2), d_ab,
       round(CASE WHEN d_ab > 0 THEN s_ab / d_ab ELSE 0 END, 6),
       round(CASE WHEN d_ab > 0 THEN (s_ab / d_ab) / (s_e / d_e) ELSE 0 END, 6) FROM t
UNION ALL SELECT 'Residual', round(s_e, 2), d_e, round(s_e / d_e, 6), CAST(NULL AS DOUBLE) FROM t""")
def q_anova_twoway(spark, d):
    return R(_ss2(tests_parametric.anova_twoway_table(table(spark, d, "lineitem"),
                                                      "l_returnflag", "l_linestatus", "l_quantity"), ["sum_sq"]))


def _chi_sql(tbl: str, a: str, b: str) -> str:
    return f"""
WITH la AS (SELECT DISTINCT {a} FROM {tbl}), lb AS (SELECT DISTINCT {b} FROM {tbl}),
o AS (SELECT {a}, {b}, count(*) AS n FROM {tbl} GROUP BY 1, 2),
cells AS (SELECT la.{a}, lb.{b}, coalesce(o.n, 0) AS obs FROM la CROSS JOIN lb
          LEFT JOIN o ON o.{a} = la.{a} AND o.{b} = lb.{b}),
rt AS (SELECT {a}, sum(obs) AS rt FROM cells GROUP BY 1), ct AS (SELECT {b}, sum(obs) AS ct FROM cells GROUP BY 1),
sh AS (SELECT sum(obs) AS nn, (count(DISTINCT {a}) - 1) * (count(DISTINCT {b}) - 1) AS dof FROM cells),
e AS (SELECT cells.{a}, cells.{b}, obs, rt * ct / nn AS ex, dof, abs(obs - rt * ct / nn) AS df
      FROM cells JOIN rt ON cells.{a} = rt.{a} JOIN ct ON cells.{b} = ct.{b}, sh)
"""


@query("chi_square_2x2", _chi_sql("labels", "quality", "toxic") + """
SELECT round(sum(CASE WHEN dof = 1 THEN (df - least(0.5, df)) * (df - least(0.5, df)) / ex
                 WHEN dof = 0 THEN 0 ELSE df * df / ex END), 6) AS chi2,
       CAST(max(dof) AS BIGINT) AS dof, CAST(sum(obs) AS BIGINT) AS n, max(dof) = 1 AS yates FROM e""")
def q_chi_2x2(spark, d):
    r = tests_parametric.chi_square(table(spark, d, "labels"), "quality", "toxic")
    return R(r.drop("p_value", "significant"))


@query("chi_square_rxc", _chi_sql("lineitem", "l_returnflag", "l_linestatus") + """
SELECT round(sum(CASE WHEN dof = 1 THEN (df - least(0.5, df)) * (df - least(0.5, df)) / ex
                 WHEN dof = 0 THEN 0 ELSE df * df / ex END), 6) AS chi2,
       CAST(max(dof) AS BIGINT) AS dof, CAST(sum(obs) AS BIGINT) AS n, max(dof) = 1 AS yates FROM e""")
def q_chi_rxc(spark, d):
    r = tests_parametric.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return R(r.drop("p_value", "significant"))


@query("chi_expected", _chi_sql("lineitem", "l_returnflag", "l_linestatus") + """
SELECT l_returnflag, l_linestatus, obs AS observed, round(ex, 6) AS expected,
       round(CASE WHEN dof = 1 THEN (df - least(0.5, df)) * (df - least(0.5, df)) / ex
                  WHEN dof = 0 THEN 0 ELSE df * df / ex END, 6) AS contribution, CAST(dof AS BIGINT) AS dof FROM e""")
def q_chi_expected(spark, d):
    return R(tests_parametric.chi_square_detail(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


_RANKS = """
WITH s AS (SELECT event_type AS g, value AS x FROM events WHERE event_type IN {levels}),
r AS (SELECT g, x, rank() OVER (ORDER BY x) AS rk, count(*) OVER (PARTITION BY x) AS t FROM s),
a AS (SELECT g, x, rk + (t - 1) / 2.0 AS ar, t FROM r),
ties AS (SELECT sum(t * t * t - t) AS tie FROM (SELECT x, count(*) AS t FROM s GROUP BY x)),
rs AS (SELECT g, count(*) AS n, sum(ar) AS rsum FROM a GROUP BY g),
tot AS (SELECT sum(n) AS nn FROM rs)"""


@query("mannwhitney", _RANKS.format(levels="('purchase', 'view')") + """
SELECT a.g AS group1, b.g AS group2, a.n AS n1, b.n AS n2, round(a.rsum - a.n * (a.n + 1) / 2.0, 6) AS u_statistic,
       CASE WHEN least(a.n, b.n) <= 8 AND tie = 0 THEN 'exact' ELSE 'asymptotic' END AS method
FROM rs a, rs b, ties WHERE a.g = 'purchase' AND b.g = 'view'""")
def q_mannwhitney(spark, d):
    ev = table(spark, d, "events").where(F.col("event_type").isin("view", "purchase"))
    return R(tests_rank.mannwhitney(ev, "event_type", "value").drop("p_value", "significant"))


@query("kruskal", _RANKS.format(levels="('view', 'purchase', 'click', 'signup', 'error')") + """
SELECT CAST(count(*) AS BIGINT) AS k, CAST(max(nn) AS BIGINT) AS n,
       round((12.0 / (max(nn) * (max(nn) + 1)) * sum(rsum * rsum / n) - 3 * (max(nn) + 1))
             / (1 - max(tie) / (max(nn) * max(nn) * max(nn) - max(nn))), 6) AS h_statistic,
       CAST(count(*) - 1 AS DOUBLE) AS df
FROM rs, tot, ties""")
def q_kruskal(spark, d):
    return R(tests_rank.kruskal(table(spark, d, "events"), "event_type", "value").drop("p_value", "significant"))


def _horner_sql(coeffs, x: str) -> str:
    acc = repr(coeffs[0])
    for c in coeffs[1:]:
        acc = f"({acc} * {x} + {c!r})"
    return acc


def _ndtri_sql(p: str) -> str:
    """AS 241 written out in SQL from the same fixed coefficients."""
    from statsmith.functions import columns as C
    q = f"({p} - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN {p} ELSE 1 - {p} END))"
    rm, rt = f"({r} - 1.6)", f"({r} - 5.0)"
    central = f"{q} * {_horner_sql(C.AS241_CENTRAL_NUM, rc)} / {_horner_sql(C.AS241_CENTRAL_DEN, rc)}"
    mag = (f"CASE WHEN {r} <= 5.0 THEN {_horner_sql(C.AS241_MID_NUM, rm)} / {_horner_sql(C.AS241_MID_DEN, rm)} "
           f"ELSE {_horner_sql(C.AS241_TAIL_NUM, rt)} / {_horner_sql(C.AS241_TAIL_DEN, rt)} END")
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {central} ELSE (CASE WHEN {q} < 0 THEN -1 ELSE 1 END) * ({mag}) END)"


def _poly_sql(coeffs, x: str) -> str:
    return " + ".join(f"{c!r} * pow({x}, {i})" for i, c in enumerate(coeffs))


@query("shapiro_acctbal", f"""
WITH o AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal) AS i, count(*) OVER () AS n
           FROM supplier WHERE s_acctbal IS NOT NULL),
m AS (SELECT v, i, n, {_ndtri_sql("((i - 0.375) / (n + 0.25))")} AS mi FROM o),
g AS (SELECT max(n) AS n, sum(mi * mi) AS S, sum(CASE WHEN i > 2 AND i < n - 1 THEN mi * v END) AS mid,
             max(CASE WHEN i = 1 THEN v END) AS x1, max(CASE WHEN i = 2 THEN v END) AS x2,
             max(CASE WHEN i = n - 1 THEN v END) AS xn1, max(CASE WHEN i = n THEN v END) AS xn,
             max(CASE WHEN i = n THEN mi END) AS mn, max(CASE WHEN i = n - 1 THEN mi END) AS mn1,
             var_pop(v) * count(*) AS ssq FROM m),
a AS (SELECT *, mn / sqrt(S) + ({_poly_sql(tests_rank.SW_AN, "1 / sqrt(n)")}) AS an,
                mn1 / sqrt(S) + ({_poly_sql(tests_rank.SW_AN1, "1 / sqrt(n)")}) AS an1 FROM g),
f AS (SELECT *, (S - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1) AS phi FROM a)
SELECT CAST(n AS BIGINT) AS n,
       round(least(1.0, pow(an * (xn - x1) + an1 * (xn1 - x2) + mid / sqrt(phi), 2) / ssq), 6) AS w_statistic
FROM f""")
def q_shapiro(spark, d):
    """W against SQL (n > 5 here); the p-value is verified against published
    values in the unit tests."""
    return R(tests_rank.shapiro(table(spark, d, "supplier"), "s_acctbal").select("n", "w_statistic"))


@query("cronbach", """
SELECT CAST(3 AS BIGINT) AS n_items, count(*) AS n,
       round(3.0 / 2.0 * (1 - (var_samp(l_quantity) + var_samp(l_discount) + var_samp(l_tax))
                              / var_samp(l_quantity + l_discount + l_tax)), 6) AS alpha
FROM lineitem""")
def q_cronbach(spark, d):
    r = tests_parametric.cronbach_alpha(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return R(r.drop("interpretation"))


_R3 = """
WITH r AS (SELECT count(*) AS n, corr(c_acctbal, c_custkey) AS r12, corr(c_acctbal, c_nationkey) AS r13,
                  corr(c_custkey, c_nationkey) AS r23 FROM customer),
d AS (SELECT n, r12, r13, r23, 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM r)"""


@query("bartlett", _R3 + """
SELECT n, CAST(3 AS BIGINT) AS n_vars, round(-((n - 1) - (2 * 3 + 5) / 6.0) * ln(det), 6) AS chi2,
       CAST(3 AS DOUBLE) AS df FROM d""")
def q_bartlett(spark, d):
    r = multivariate.bartlett_sphericity(table(spark, d, "customer"), ["c_acctbal", "c_custkey", "c_nationkey"])
    return R(r.select("n", "n_vars", "chi2", "df"))


@query("kmo", _R3 + """,
i AS (SELECT (1 - r23 * r23) / det AS i11, (1 - r13 * r13) / det AS i22, (1 - r12 * r12) / det AS i33,
             (r13 * r23 - r12) / det AS i12, (r12 * r23 - r13) / det AS i13, (r12 * r13 - r23) / det AS i23,
             r12, r13, r23 FROM d),
q AS (SELECT r12, r13, r23, -i12 / sqrt(i11 * i22) AS q12, -i13 / sqrt(i11 * i33) AS q13,
             -i23 / sqrt(i22 * i33) AS q23 FROM i)
SELECT 'c_acctbal' AS variable, round((r12*r12 + r13*r13) / (r12*r12 + r13*r13 + q12*q12 + q13*q13), 6) AS msa FROM q
UNION ALL SELECT 'c_custkey', round((r12*r12 + r23*r23) / (r12*r12 + r23*r23 + q12*q12 + q23*q23), 6) FROM q
UNION ALL SELECT 'c_nationkey', round((r13*r13 + r23*r23) / (r13*r13 + r23*r23 + q13*q13 + q23*q23), 6) FROM q
UNION ALL SELECT '__overall__', round((r12*r12 + r13*r13 + r23*r23)
       / (r12*r12 + r13*r13 + r23*r23 + q12*q12 + q13*q13 + q23*q23), 6) FROM q""")
def q_kmo(spark, d):
    r = multivariate.kmo(table(spark, d, "customer"), ["c_acctbal", "c_custkey", "c_nationkey"])
    return R(r.drop("interpretation"))


# ------------------------------------------------------------------ reduction
@query("pca_eigen", """
WITH r AS (SELECT count(*) AS n, corr(p_partkey, p_retailprice) AS rr FROM part)
SELECT 'PC1' AS component, round(n / (n - 1.0) * (1 + abs(rr)), 6) AS eigenvalue,
       round((1 + abs(rr)) / 2 * 100, 6) AS variance_pct, round((1 + abs(rr)) / 2 * 100, 6) AS cumulative_pct FROM r
UNION ALL
SELECT 'PC2', round(n / (n - 1.0) * (1 - abs(rr)), 6), round((1 - abs(rr)) / 2 * 100, 6), 100.0 FROM r""")
def q_pca_eigen(spark, d):
    res = reduce.pca(table(spark, d, "part"), ["p_partkey", "p_retailprice"], k=2)
    return R(res.variance)


@query("pca_scores", """
WITH s AS (SELECT avg(p_partkey) AS m1, stddev_pop(p_partkey) AS s1, avg(p_retailprice) AS m2,
                  stddev_pop(p_retailprice) AS s2, corr(p_partkey, p_retailprice) AS rr FROM part)
SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice,
       round(((p_partkey - m1) / s1 + sign(rr) * (p_retailprice - m2) / s2) / sqrt(2), 6) AS PC1
FROM part, s""")
def q_pca_scores(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    res = reduce.pca(p, ["p_partkey", "p_retailprice"], k=1)
    return R(res.scores)


def _embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


@query("pca_embeddings_loadings")
def q_pca_emb(spark, d):
    return R(reduce.pca(_embeddings(spark, d), [f"e{i}" for i in range(64)], k=3).loadings)


@query("fa_varimax")
def q_fa_varimax(spark, d):
    return R(reduce.factor_analysis(_embeddings(spark, d), [f"e{i}" for i in range(64)], 2, "varimax").loadings)


@query("fa_quartimax")
def q_fa_quartimax(spark, d):
    return R(reduce.factor_analysis(_embeddings(spark, d), [f"e{i}" for i in range(64)], 2, "quartimax").loadings)


@query("fa_promax")
def q_fa_promax(spark, d):
    return R(reduce.factor_analysis(_embeddings(spark, d), [f"e{i}" for i in range(64)], 2, "promax").loadings)


@query("fa_variance")
def q_fa_variance(spark, d):
    return R(reduce.factor_analysis(_embeddings(spark, d), [f"e{i}" for i in range(64)], 2, "varimax").variance)


@query("fa_scores")
def q_fa_scores(spark, d):
    return R(reduce.factor_analysis(_embeddings(spark, d), [f"e{i}" for i in range(64)], 2, "varimax").scores)


# ------------------------------------------------------------------ modelling
from statsmith.ml import evaluate, registry, split, tune  # noqa: E402


def _coef_frame(spark, model) -> DataFrame:
    return spark.createDataFrame([(float(model.intercept), float(model.coefficients[0]))],
                                 "intercept double, slope double")


def _part_reg(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice")


@query("linreg_ols", """
SELECT round(regr_intercept(p_retailprice, p_partkey), 6) AS intercept,
       round(regr_slope(p_retailprice, p_partkey), 6) AS slope FROM part""")
def q_linreg(spark, d):
    prep = registry.prepare(_part_reg(spark, d), "p_retailprice", registry.REG, ["p_partkey"])
    return R(_coef_frame(spark, registry.fit(prep.frame, "linear regression", registry.REG)))


_RIDGE_ALPHA = 1.0e9


@query("ridge_coef", f"""
WITH s AS (SELECT avg(p_partkey) AS mx, avg(p_retailprice) AS my,
                  sum((p_partkey - (SELECT avg(p_partkey) FROM part)) * (p_retailprice - (SELECT avg(p_retailprice) FROM part))) AS sxy,
                  sum((p_partkey - (SELECT avg(p_partkey) FROM part)) * (p_partkey - (SELECT avg(p_partkey) FROM part))) AS sxx
           FROM part)
SELECT round(my - sxy / (sxx + {_RIDGE_ALPHA}) * mx, 6) AS intercept, round(sxy / (sxx + {_RIDGE_ALPHA}), 6) AS slope FROM s""")
def q_ridge(spark, d):
    prep = registry.prepare(_part_reg(spark, d), "p_retailprice", registry.REG, ["p_partkey"])
    m = registry.fit(prep.frame, "ridge", registry.REG, {"alpha": _RIDGE_ALPHA})
    return R(_coef_frame(spark, m))


_LASSO_ALPHA = 5.0


@query("lasso_coef", f"""
WITH s AS (SELECT count(*) AS n, avg(p_partkey) AS mx, avg(p_retailprice) AS my,
                  covar_pop(p_partkey, p_retailprice) AS c, var_pop(p_partkey) AS v FROM part),
w AS (SELECT mx, my, sign(c) * greatest(abs(c) - {_LASSO_ALPHA}, 0) / v AS slope FROM s)
SELECT round(my - slope * mx, 6) AS intercept, round(slope, 6) AS slope FROM w""")
def q_lasso(spark, d):
    prep = registry.prepare(_part_reg(spark, d), "p_retailprice", registry.REG, ["p_partkey"])
    m = registry.fit(prep.frame, "lasso", registry.REG, {"alpha": _LASSO_ALPHA, "tol": 1e-12})
    return R(_coef_frame(spark, m))


@query("residuals_ols", """
WITH c AS (SELECT regr_intercept(p_retailprice, p_partkey) AS a, regr_slope(p_retailprice, p_partkey) AS b FROM part)
SELECT round(a + b * p_partkey, 4) AS predicted, round(p_retailprice - (a + b * p_partkey), 4) AS residual
FROM part, c""")
def q_residuals(spark, d):
    prep = registry.prepare(_part_reg(spark, d), "p_retailprice", registry.REG, ["p_partkey"])
    m = registry.fit(prep.frame, "linear regression", registry.REG)
    return round_doubles(chartdata.residual_data(m.transform(prep.frame)), 4)


# Fixed-rule stand-in predictions over lineitem (the operator under test is
# the metric computation, not a model).
_CLS_PRED = ("CASE WHEN l_discount > 0.05 THEN 'R' WHEN l_tax > 0.04 THEN 'A' ELSE 'N' END")


@query("metrics_cls", f"""
WITH p AS (SELECT l_returnflag AS label, {_CLS_PRED} AS prediction FROM lineitem),
cm AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2),
cls AS (SELECT label AS c FROM cm UNION SELECT prediction FROM cm),
per AS (SELECT cls.c,
               coalesce((SELECT sum(n) FROM cm WHERE label = cls.c), 0) AS support,
               coalesce((SELECT sum(n) FROM cm WHERE prediction = cls.c), 0) AS predicted,
               coalesce((SELECT sum(n) FROM cm WHERE label = cls.c AND prediction = cls.c), 0) AS tp FROM cls),
m AS (SELECT c, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS pr,
             CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rc FROM per),
t AS (SELECT sum(support) AS n, sum(support * pr) AS sp, sum(support * rc) AS sr,
             sum(support * CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END) AS sf FROM m),
h AS (SELECT sum(n) FILTER (WHERE label = prediction) AS hit FROM cm)
SELECT 'accuracy' AS metric, round(hit / n, 6) AS value FROM t, h
UNION ALL SELECT 'precision', round(sp / n, 6) FROM t
UNION ALL SELECT 'recall', round(sr / n, 6) FROM t
UNION ALL SELECT 'f1', round(sf / n, 6) FROM t
UNION ALL SELECT 'n_test', CAST(n AS DOUBLE) FROM t""")
def q_metrics_cls(spark, d):
    li = table(spark, d, "lineitem")
    pred = li.select(F.col("l_returnflag").alias("label"), F.expr(_CLS_PRED).alias("prediction"))
    return R(evaluate.classification_metrics(pred))


@query("metrics_reg", """
WITH p AS (SELECT l_extendedprice / 1000.0 AS y, l_quantity AS yhat FROM lineitem)
SELECT 'mse' AS metric, round(avg((y - yhat) * (y - yhat)), 6) AS value FROM p
UNION ALL SELECT 'mae', round(avg(abs(y - yhat)), 6) FROM p
UNION ALL SELECT 'r2', round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)), 6) FROM p
UNION ALL SELECT 'n_test', CAST(count(*) AS DOUBLE) FROM p""")
def q_metrics_reg(spark, d):
    li = table(spark, d, "lineitem")
    pred = li.select((F.col("l_extendedprice") / 1000.0).alias("label"), F.col("l_quantity").alias("prediction"))
    return R(evaluate.regression_metrics(pred))


def _scored_docs(spark, d):
    lab = table(spark, d, "labels")
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(F.col("quality").alias("label"),
                                          F.col("n_chars").cast("double").alias("score"))


@query("roc_auc", """
WITH s AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ar FROM s)
SELECT round((sum(ar) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r""")
def q_roc_auc(spark, d):
    return R(evaluate.roc_auc_frame(_scored_docs(spark, d)))


@query("roc_curve", """
WITH s AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id)),
g AS (SELECT x, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY x),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
SELECT round(x, 6) AS threshold,
       round(sum(neg) OVER (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / N, 6) AS fpr,
       round(sum(pos) OVER (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / P, 6) AS tpr
FROM g, t
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def q_roc_curve(spark, d):
    return R(evaluate.roc_curve(_scored_docs(spark, d)))


@query("multiclass_auc", """
WITH s AS (SELECT vec_id, label, u.i - 1 AS cls, CAST(u.v AS DOUBLE) AS x
           FROM embeddings, unnest(embedding[1:10]) WITH ORDINALITY AS u(v, i)),
r AS (SELECT cls, CASE WHEN label = cls THEN 1 ELSE 0 END AS y,
             rank() OVER (PARTITION BY cls ORDER BY x) + (count(*) OVER (PARTITION BY cls, x) - 1) / 2.0 AS ar FROM s)
SELECT CAST(cls AS INTEGER) AS class,
       round((sum(ar) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc
FROM r GROUP BY cls""")
def q_multiclass_auc(spark, d):
    e = table(spark, d, "embeddings")
    scored = e.select(F.col("label").cast("double").alias("label"),
                      F.expr("transform(slice(embedding, 1, 10), v -> CAST(v AS DOUBLE))").alias("probability"))
    return R(evaluate.multiclass_roc_auc(scored))


@query("split_exact", """
SELECT count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_train, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_test
FROM events""")
def q_split_exact(spark, d):
    ev = table(spark, d, "events")
    tr, te = split.train_test_split(ev, 0.2, 42, key="event_id")
    return spark.createDataFrame([(tr.count(), te.count())], "n_train long, n_test long")


@query("sgd_convex_part", """
WITH r AS (SELECT corr(p_retailprice, p_partkey) AS a, corr(p_retailprice, p_size) AS b, corr(p_partkey, p_size) AS c FROM part)
SELECT round(0.5 * (1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)), 6) AS optimum, TRUE AS within_1_percent,
       TRUE AS at_most_36_rounds, TRUE AS max_iter_kept FROM r""")
def q_sgd_convex(spark, d):
    """M9: the descent's objective on a convex loss (half the mean squared
    error of the standardised target) against the exact optimum."""
    from statsmith.ml import registry
    from statsmith.ml.sgd import fit_sgd
    prep = registry.prepare(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", registry.REG)
    exact = registry.fit(prep.frame, "linear regression", registry.REG).transform(prep.frame).agg(
        (F.avg((F.col("label") - F.col("prediction")) ** 2) / (2 * F.var_pop("label"))).alias("o")).first()["o"]
    m = fit_sgd(prep.frame, registry.REG, penalty=None, tol=1e-5, max_iter=200)
    short = fit_sgd(prep.frame, registry.REG, penalty=None, tol=None, max_iter=3)
    return R(spark.createDataFrame(
        [(exact, bool(min(m.objective) <= 1.01 * exact), len(m.objective) <= 37, short.n_iter == 3 and m.n_iter <= 200)],
        "optimum double, within_1_percent boolean, at_most_36_rounds boolean, max_iter_kept boolean"))


_LINE_NUMBERS = ("l_quantity", "l_discount", "l_tax")


def _boost_frame(spark, d, features):
    from statsmith.ml import registry
    src = table(spark, d, "lineitem").select(*features, "l_extendedprice")
    return registry.prepare(src, "l_extendedprice", registry.REG, missing="keep").frame


@query("boost_first_split", """
WITH s AS (SELECT avg(l_extendedprice) AS m FROM lineitem),
u AS (SELECT f, v, sum(m - y) AS g, count(*) AS h FROM (
        SELECT 'l_quantity' AS f, l_quantity AS v, l_extendedprice AS y FROM lineitem
        UNION ALL SELECT 'l_discount', l_discount, l_extendedprice FROM lineitem
        UNION ALL SELECT 'l_tax', l_tax, l_extendedprice FROM lineitem), s GROUP BY f, v),
c AS (SELECT f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY f) AS gt, sum(h) OVER (PARTITION BY f) AS ht
      FROM u WINDOW w AS (PARTITION BY f ORDER BY v)),
k AS (SELECT *, (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) / 2 AS gain FROM c WHERE hl < ht)
SELECT f AS feature, round(gain / ht, 4) AS gain_per_row, round(-gl / (hl + 1), 4) AS left_weight,
       round(-(gt - gl) / (ht - hl + 1), 4) AS right_weight FROM k ORDER BY gain DESC, f LIMIT 1""")
def q_boost_first_split(spark, d):
    """One round of depth 1 of second-order boosting."""
    from statsmith.ml.boosting import fit_boosted
    df = _boost_frame(spark, d, _LINE_NUMBERS)
    m = fit_boosted(df, "regression", rounds=1, rate=1.0, max_depth=1)
    t = m.trees[0][0]
    row = (_LINE_NUMBERS[t.feature[0]], float(m.gain.sum()) / df.count(), t.value[t.left[0]], t.value[t.right[0]])
    return R(spark.createDataFrame([row], "feature string, gain_per_row double, left_weight double, right_weight double"), 4)


@query("boost_best_leaf", """
WITH s AS (SELECT avg(l_extendedprice) AS m FROM lineitem),
u AS (SELECT l_quantity AS v, sum(m - l_extendedprice) AS g, count(*) AS h FROM lineitem, s GROUP BY 1),
c AS (SELECT v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER () AS gt, sum(h) OVER () AS ht FROM u WINDOW w AS (ORDER BY v)),
r AS (SELECT v AS v1, (gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht) / 2 AS gain, ht FROM c
      WHERE least(hl, ht - hl) >= 20 ORDER BY gain DESC, v LIMIT 1),
e AS (SELECT v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER p AS gt, sum(h) OVER p AS ht FROM u, r
      WINDOW w AS (PARTITION BY v <= v1 ORDER BY v), p AS (PARTITION BY v <= v1)),
q AS (SELECT v AS v2, (gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht) / 2 AS gain FROM e
      WHERE least(hl, ht - hl) >= 20 ORDER BY gain DESC, v LIMIT 1)
SELECT round(least(v1, v2), 4) AS low_cut, round(greatest(v1, v2), 4) AS high_cut, round((r.gain + q.gain) / r.ht, 4) AS gain_per_row
FROM r, q""")
def q_boost_best_leaf(spark, d):
    """Three leaves, the second split in whichever leaf gains more."""
    from statsmith.ml.boosting import fit_boosted
    df = _boost_frame(spark, d, ("l_quantity",))
    m = fit_boosted(df, "regression", rounds=1, rate=1.0, grow="leaf", max_depth=None, max_leaves=3, reg_lambda=0.0,
                    min_child_weight=1e-3, min_child_samples=20)
    t = m.trees[0][0]
    cuts = sorted(float(m.edges[0][t.cut[n]]) - 0.5 for n in range(len(t.value)) if t.feature[n] >= 0)   # whole numbers
    row = (cuts[0], cuts[1], float(m.gain.sum()) / df.count())
    return R(spark.createDataFrame([row], "low_cut double, high_cut double, gain_per_row double"), 4)


def _train_query(model: str, task: str):
    def run(spark, d):
        if task == registry.REG:
            src = table(spark, d, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
            tm = registry.train_model(src, "p_retailprice", model, task, key="p_partkey")
        else:
            src = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
            tm = registry.train_model(src, "c_mktsegment", model, task,
                                      features=["c_acctbal", "c_nationkey"], key="c_custkey")
        return tm.metrics      # values depend on the fitted model: rows-only check
    run.__doc__ = f"Train/evaluate {model} ({task}) on the exact hash split; returns the metrics."
    return run


for _m, _tasks in registry.MODEL_TASKS.items():
    for _t in _tasks:
        query(f"train_{_m.replace(' ', '_')}_{'cls' if _t == registry.CLS else 'reg'}")(_train_query(_m, _t))


@query("feature_importance_rf")
def q_feature_importance(spark, d):
    src = table(spark, d, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    tm = registry.train_model(src, "p_retailprice", "random forest", registry.REG, key="p_partkey")
    return spark.createDataFrame(tm.feature_importance(), "feature string, importance double")


@query("tune_ridge")
def q_tune_ridge(spark, d):
    src = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    _, hist = tune.auto_optimize(src, "p_retailprice", "ridge", registry.REG, key="p_partkey")
    return hist



# ------------------------------------------------------------------ coverage additions
@query("preview_orders")
def q_preview(spark, d):
    """A2/A3: first rows for display; the limit is the feature (rows only)."""
    from statsmith.sources import preview
    return preview(table(spark, d, "orders"), 20)


@query("csv_roundtrip_supplier", """
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey,
       round(s_acctbal, 6) AS s_acctbal FROM supplier""")
def q_csv_roundtrip(spark, d):
    """A4 then A1: write the table as CSV into the checkpoint folder, read it
    back with pandas-style inference."""
    import uuid

    from statsmith.session import checkpoint_dir
    from statsmith.sources import read_table, write_csv
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(table(spark, d, "supplier"), path)
    return R(read_table(spark, path))


@query("csv_line_breaks", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, NULLIF(text, '') AS text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents""")
def q_csv_line_breaks(spark, d):
    """A1: a CSV whose quoted fields hold line breaks, read by blocks in many
    tasks a file."""
    import uuid

    from statsmith.session import checkpoint_dir
    from statsmith.sources import read_table, write_csv
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(table(spark, d, "documents"), path)
    return read_table(spark, path)


@query("scree_part", """
WITH r AS (SELECT count(*) AS n, corr(p_partkey, p_retailprice) AS rr FROM part)
SELECT 'PC1' AS component, round(n / (n - 1.0) * (1 + abs(rr)), 6) AS eigenvalue, 1.0 AS reference FROM r
UNION ALL SELECT 'PC2', round(n / (n - 1.0) * (1 - abs(rr)), 6), 1.0 FROM r""")
def q_scree(spark, d):
    res = reduce.pca(table(spark, d, "part"), ["p_partkey", "p_retailprice"], k=2)
    return R(chartdata.scree_data(res.variance))


@query("scatter_bins_lineitem", """
WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem),
b AS (SELECT least(floor((l_quantity - x0) / ((x1 - x0) / 20)), 19)::INTEGER AS x_bin,
             least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)), 19)::INTEGER AS y_bin FROM lineitem, r)
SELECT x_bin, y_bin, round(any_value(x0) + x_bin * any_value((x1 - x0) / 20), 6) AS x_low,
       round(any_value(y0) + y_bin * any_value((y1 - y0) / 20), 6) AS y_low, count(*) AS count FROM b, r GROUP BY x_bin, y_bin""")
def q_scatter_bins(spark, d):
    return R(chartdata.scatter_bins(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 20))


@query("line_buckets_events", """
WITH r AS (SELECT min(event_id)::DOUBLE AS x0, max(event_id)::DOUBLE AS x1 FROM events),
b AS (SELECT least(floor((event_id::DOUBLE - x0) / ((x1 - x0) / 40)), 39)::INTEGER AS bucket, event_id::DOUBLE AS x, value AS y FROM events, r)
SELECT bucket, count(*) AS points, round(min(x), 6) AS first_x, round(arg_min(y, x), 6) AS first_y, round(max(x), 6) AS last_x,
       round(arg_max(y, x), 6) AS last_y, round(min(y), 6) AS low_y, round(max(y), 6) AS high_y FROM b GROUP BY bucket""")
def q_line_buckets(spark, d):
    return R(chartdata.line_buckets(table(spark, d, "events"), "event_id", "value", 40))


def _flat_groups(spark, d):
    return table(spark, d, "lineitem").select("l_linestatus", (F.col("l_linestatus") == "O").cast("double").alias("v"))


@query("ttest_no_variance", """
SELECT min(l_linestatus) AS group1, max(l_linestatus) AS group2, CAST('-infinity' AS DOUBLE) AS t_statistic, 0.0::DOUBLE AS p_value,
       TRUE AS significant FROM lineitem""")
def q_ttest_no_variance(spark, d):
    """G1 with no variance inside the groups."""
    return tests_parametric.ttest_ind(_flat_groups(spark, d), "l_linestatus", "v").select(
        "group1", "group2", "t_statistic", "p_value", "significant")


@query("anova_no_variance", """
SELECT count(DISTINCT l_linestatus) AS k, count(*) AS n, CAST('infinity' AS DOUBLE) AS f_statistic, 0.0::DOUBLE AS p_value FROM lineitem""")
def q_anova_no_variance(spark, d):
    """G3 with no variance inside the groups."""
    return tests_parametric.anova_oneway(_flat_groups(spark, d), "l_linestatus", "v").select("k", "n", "f_statistic", "p_value")


def _with_constant(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice", F.lit(7.0).alias("flat"))


@query("kmo_constant_column", """
SELECT * FROM (VALUES ('p_partkey', 0.5::DOUBLE, 'Miserable'), ('p_retailprice', 0.5, 'Miserable'), ('flat', NULL, 'undefined'),
                      ('__overall__', 0.5, 'Miserable')) t(variable, msa, interpretation)""")
def q_kmo_constant(spark, d):
    """A constant variable is undefined, two others always measure 0.5."""
    out = R(multivariate.kmo(_with_constant(spark, d), ["p_partkey", "p_retailprice", "flat"]))
    return out.withColumn("interpretation", F.when(F.col("msa") == 0.5, "Miserable").otherwise(F.col("interpretation")))


@query("bartlett_constant_column", """
SELECT count(*) AS n, 3 AS n_vars, NULL::DOUBLE AS chi2, 'undefined: flat does not vary' AS verdict FROM part""")
def q_bartlett_constant(spark, d):
    return multivariate.bartlett_sphericity(_with_constant(spark, d), ["p_partkey", "p_retailprice", "flat"]).select(
        "n", "n_vars", "chi2", "verdict")


@query("fa_constant_column", """
SELECT 'flat' AS variable, 0.0::DOUBLE AS loading, 3 AS variables FROM part LIMIT 1""")
def q_fa_constant(spark, d):
    """H2: a constant variable loads on nothing."""
    df = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size", F.lit(7.0).alias("flat"))
    r = reduce.factor_analysis(df, ["p_partkey", "p_retailprice", "p_size", "flat"], 1, None)
    return R(r.loadings.filter("variable = 'flat'").select("variable", F.col("Factor1").alias("loading"),
                                                           F.lit(r.loadings.filter("variable <> 'flat'").count()).alias("variables")))


@query("stats_beside_kruskal", """
SELECT 'event_type' AS group_variable, event_type AS level, count(value) AS count, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM events GROUP BY event_type""")
def q_stats_beside(spark, d):
    return R(groups.stats_beside_test(table(spark, d, "events"), "kruskal", "event_type", "value"))


@query("roc_from_margin_svm")
def q_roc_margin(spark, d):
    """A model without probabilities (linear SVM) ranked by its margin."""
    lab = table(spark, d, "labels")
    doc = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    src = lab.join(doc, "doc_id").select("doc_id", "n_chars", "lang", "quality")
    tm = registry.train_model(src, "quality", "support vector machine", registry.CLS,
                              features=["n_chars", "lang"], params={"kernel": "linear"}, key="doc_id")
    scored = evaluate.score_column(tm.predictions)
    return evaluate.roc_auc_frame(scored.withColumn("y", F.col("label").cast("int")), label="y")


@query("quantiles_bracket_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, " + ", ".join(
        f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS q_{i}"
        for i, p in enumerate([0.01, 0.25, 0.5, 0.75, 0.99])) + " FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount"]))
def q_quantiles_bracket(spark, d):
    """Exact quantiles through the approximate-bracket path (the large-data
    method), checked against exact SQL."""
    li = table(spark, d, "lineitem")
    return R(ordered.quantiles(li, ["l_quantity", "l_extendedprice", "l_discount"],
                               [0.01, 0.25, 0.5, 0.75, 0.99], method="bracket"))


@query("pca_loadings_part", """
WITH r AS (SELECT corr(p_partkey, p_retailprice) AS rr FROM part)
SELECT 'p_partkey' AS variable, round(sqrt(0.5), 6) AS PC1, round(sqrt(0.5), 6) AS PC2 FROM r
UNION ALL
SELECT 'p_retailprice', round(CASE WHEN rr > 0 THEN sqrt(0.5) ELSE -sqrt(0.5) END, 6),
       round(CASE WHEN rr > 0 THEN -sqrt(0.5) ELSE sqrt(0.5) END, 6) FROM r""")
def q_pca_loadings(spark, d):
    """H6: for two standardised variables the unit eigenvectors are
    (1, +-1)/sqrt(2); the sign rule makes the largest loading positive, the
    first one on ties, so both first-variable loadings are positive."""
    return R(reduce.pca(table(spark, d, "part"), ["p_partkey", "p_retailprice"], k=2).loadings)


def _emb_all(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


@query("pca_embeddings_64")
def q_pca_emb64(spark, d):
    """PCA over all 64 embedding dimensions: the wide Gram path (mapInArrow
    partial X^T X) - explained variance table, rows only."""
    return R(reduce.pca(_emb_all(spark, d), [f"e{i}" for i in range(64)], k=10).variance)


@query("corr_matrix_embeddings_64", """
WITH e AS (SELECT vec_id, u.i - 1 AS i, CAST(u.v AS DOUBLE) AS v FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, i)),
p AS (SELECT a.i AS i, b.i AS j, corr(a.v, b.v) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.i, b.i)
SELECT 'e' || CAST(i AS VARCHAR) AS var1, 'e' || CAST(j AS VARCHAR) AS var2, round(r, 6) AS corr FROM p""")
def q_corr_wide(spark, d):
    """E7 over all 64 embedding dimensions (the wide, batch-matrix path)."""
    return R(chartdata.correlation_matrix(_emb_all(spark, d), [f"e{i}" for i in range(64)]))


from statsmith.operators import testing  # noqa: E402


@query("tests_by_group_anova", """
WITH g AS (SELECT 'l_returnflag' AS gv, l_returnflag AS lv, l_quantity AS x FROM lineitem
           UNION ALL SELECT 'l_linestatus', l_linestatus, l_quantity FROM lineitem),
s AS (SELECT gv, lv, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM g GROUP BY gv, lv),
t AS (SELECT gv, count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS gm FROM s GROUP BY gv),
w AS (SELECT s.gv, sum(n * (m - gm) * (m - gm)) AS ssb, sum((n - 1) * coalesce(v, 0)) AS ssw FROM s JOIN t USING (gv) GROUP BY s.gv)
SELECT t.gv AS group_variable, k, CAST(nn AS BIGINT) AS n, round(ssb, 2) AS ss_between, round(ssw, 2) AS ss_within,
       CAST(k - 1 AS DOUBLE) AS df_between, CAST(nn - k AS DOUBLE) AS df_within,
       round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS f_statistic, CAST(NULL AS VARCHAR) AS error
FROM t JOIN w USING (gv)""")
def q_tests_by_group_anova(spark, d):
    """One-way ANOVA of quantity for each of two group variables (stacked)."""
    r = testing.run_test(table(spark, d, "lineitem"), "anova", ["l_returnflag", "l_linestatus"], "l_quantity")
    return R(_ss2(r.drop("p_value", "significant"), ["ss_between", "ss_within"]))


@query("tests_by_group_ttest", """
WITH g AS (SELECT l_linestatus AS grp, count(l_extendedprice) AS n, avg(l_extendedprice) AS m,
                  var_samp(l_extendedprice) AS v FROM lineitem GROUP BY l_linestatus),
a AS (SELECT * FROM g WHERE grp = (SELECT min(grp) FROM g)), b AS (SELECT * FROM g WHERE grp = (SELECT max(grp) FROM g))
SELECT 'l_linestatus' AS group_variable, a.grp AS group1, b.grp AS group2,
       round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6)
         AS t_statistic, CAST(NULL AS VARCHAR) AS error FROM a, b
UNION ALL
SELECT 'l_returnflag', NULL, NULL, NULL,
       'ValueError: l_returnflag must have exactly 2 levels (found 3+)'""")
def q_tests_by_group_ttest(spark, d):
    """t test per group variable: a variable without exactly two levels gives
    an error row, the others still run (as in the reference)."""
    r = testing.run_test(table(spark, d, "lineitem"), "ttest", ["l_linestatus", "l_returnflag"],
                         "l_extendedprice")
    return R(r.select("group_variable", "group1", "group2", "t_statistic", "error"))


@query("label_encode_discount", """
SELECT l_orderkey, l_linenumber,
       CAST(dense_rank() OVER (ORDER BY CAST(l_discount AS VARCHAR)) - 1 AS BIGINT) AS l_discount FROM lineitem""")
def q_label_encode_float(spark, d):
    """D1 on a float column: classes are Python-style texts ('0.0', '0.01',
    ..., '0.1') ordered as text, as label encoding of ``astype(str)`` does."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return encode.label_encode(li, "l_discount")[0]


@query("quantiles_full_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, " + ", ".join(
        f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS q_{i}"
        for i, p in enumerate([0.01, 0.25, 0.5, 0.75, 0.99])) + " FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount"]))
def q_quantiles_full(spark, d):
    """Exact quantiles through the ranked value table over all values (the
    mid-size method), checked against exact SQL."""
    li = table(spark, d, "lineitem")
    return R(ordered.quantiles(li, ["l_quantity", "l_extendedprice", "l_discount"],
                               [0.01, 0.25, 0.5, 0.75, 0.99], method="full"))
