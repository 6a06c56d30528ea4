"""Ordered operators without single-task windows.

A Spark window with ``orderBy`` but no (or a skewed) ``partitionBy`` pulls all
rows of a group into one task.  Everything order-dependent in the library
(exact quantiles, average ranks, cumulative ROC counts, forward/backward fill,
interpolation) goes through the two tools in this module instead:

* ``ranked_values`` - the *value table*: ``groupBy(keys, value)`` with
  map-side partial aggregation shrinks ties (a value holding a third of all
  rows becomes one row per map task), then a range-partitioned prefix sum gives
  every distinct value its cumulative count inside its key.
* ``neighbours`` - row-level lookups of the previous/next known values and the
  global row position, computed per range partition and stitched together
  through a frame with one row per (key, partition).

The value table uses ``repartitionByRange`` + ``spark_partition_id`` and is
stored; the row lookups number their ranges by an expression and store nothing.
Per-partition totals or carries form a frame whose size is bounded by partitions x keys, a window
over that small frame gives offsets, and a join brings them back.  A key that
holds a third of the rows simply spans many range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statsmith.functions.columns import TMP, dbl, present, require_columns, require_numeric, value
from statsmith.session import shuffle_partitions, stored

_PID = TMP + "pid"
_UNB = Window.unboundedPreceding
_UNF = Window.unboundedFollowing


def _parts(df: DataFrame, num_partitions: int | None) -> int:
    return num_partitions or shuffle_partitions(df.sparkSession)


def _materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once through a reliable ``checkpoint()`` (the folder named
    by ``spark.checkpoint.dir``) and return the stored copy."""
    return stored(df)


def _range_tagged(df: DataFrame, sort_cols: list[str], P: int) -> DataFrame:
    """Range-partition by ``sort_cols`` and tag each row with its partition.

    Two plans that each range-partition the same input sample their
    boundaries independently, so partition ids are only comparable between
    the per-partition summary and the rows when both read one stored copy:
    callers materialise the tagged frame (``_materialize``) before branching,
    which also cuts lineage so a lost executor never re-derives other ids.
    """
    return df.repartitionByRange(P, *sort_cols).withColumn(_PID, F.spark_partition_id())


def _range_number(df: DataFrame, cols: list[str], P: int) -> Column:
    """Number of the range that a row's ``cols`` fall into, as a plain
    expression over split points that one job over these columns alone finds
    (the least row of each of ``P`` range partitions).  It gives the same
    number in every plan and after the loss of executors, so nothing has to be
    stored for it; how good the split points are only shifts the balance."""
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)])
    least = (df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)]).repartitionByRange(P, *[f"k{i}" for i in range(len(cols))])
             .groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*[f"k{i}" for i in range(len(cols))])).alias("m")))
    splits = [r["m"] for r in least.orderBy("p").collect()][1:]               # P rows
    types = [df.schema[c].dataType for c in cols]

    def literal(m):
        return F.struct(*[F.lit(v if not hasattr(v, "isoformat") else str(v)).cast(t).alias(f"k{i}")
                          for i, (v, t) in enumerate(zip(m, types, strict=True))])

    def search(lo, hi):                            # splits[lo:hi] are undecided: log2(P) comparisons a row
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= literal(splits[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(splits))


def _join_small(big: DataFrame, small: DataFrame, on: list[str], bounded: bool) -> DataFrame:
    """Join the per-(key, partition) frame back.  It is broadcast explicitly only
    when its size is bounded by the partition count (no keys); otherwise the
    adaptive planner decides from its measured size at run time."""
    renamed = small.select(*[F.col(c).alias(TMP + "j_" + c) if c in on else F.col(c)
                             for c in small.columns])
    cond = None
    for c in on:      # null-safe: a NULL partition key is a key like any other
        e = big[c].eqNullSafe(renamed[TMP + "j_" + c])
        cond = e if cond is None else cond & e
    j = big.join(F.broadcast(renamed) if bounded else renamed, on=cond, how="inner")
    return j.drop(*[TMP + "j_" + c for c in on])


# ---------------------------------------------------------------- value table
def ranked_values(df: DataFrame, value: str, keys: list[str] | tuple = (),
                  weights: dict[str, Column] | None = None,
                  num_partitions: int | None = None) -> DataFrame:
    """Distinct ``(keys, value)`` with counts and cumulative counts.

    Returns ``keys..., value, cnt, cum_before, total`` where ``cum_before`` is
    the number of non-NULL rows of the same key with a smaller value and
    ``total`` the key's non-NULL row count.  Each extra weight ``w`` (a Column
    summed per value) adds ``w`` and ``cum_w`` columns the same way.  NULL
    values are skipped.
    """
    keys = list(keys)
    weights = weights or {}
    P = _parts(df, num_partitions)
    vt = (df.where(present(df, value))
            .groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("cnt"),
                 *[F.sum(c).alias(n) for n, c in weights.items()]))
    wnames = ["cnt"] + list(weights)
    r = _materialize(_range_tagged(vt, [*keys, value], P))
    tot = r.groupBy(*keys, _PID).agg(*[F.sum(w).alias(TMP + "t_" + w) for w in wnames])
    wk = Window.partitionBy(*keys).orderBy(_PID)
    off = tot.select(
        *keys, _PID,
        *[F.coalesce(F.sum(TMP + "t_" + w).over(wk.rowsBetween(_UNB, -1)), F.lit(0))
           .alias(TMP + "o_" + w) for w in wnames],
        F.sum(TMP + "t_cnt").over(wk.rowsBetween(_UNB, _UNF)).alias("total"))
    j = _join_small(r, off, [*keys, _PID], bounded=not keys)
    within = Window.partitionBy(*keys, _PID).orderBy(value).rowsBetween(_UNB, -1)
    cum_names = {"cnt": "cum_before"}
    return j.select(
        *keys, value, *wnames,
        *[(F.col(TMP + "o_" + w) + F.coalesce(F.sum(w).over(within), F.lit(0)))
          .alias(cum_names.get(w, "cum_" + w)) for w in wnames],
        "total")


def _unpivot(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """Long form ``keys..., variable, value`` (value cast to double)."""
    items = F.array(*[F.struct(F.lit(c).alias("variable"), dbl(c).alias("value")) for c in cols])
    return df.select(*keys, F.inline(items))


BRACKET_ACCURACY = 100_000
# Below this many (row, column) values one full value-table shuffle is cheaper
# than the extra passes of the bracket method.
FULL_PATH_MAX_VALUES = 20_000_000
# Spark's exact ``percentile`` aggregate (one job) keeps a value map per group
# in its final task: used while every group has at most AGG_PATH_MAX_ROWS rows
# (a group never exceeds the row count) and all groups together at most
# AGG_PATH_MAX_VALUES values (several groups may share a reducer).
AGG_PATH_MAX_ROWS = 2_000_000
AGG_PATH_MAX_VALUES = 2_000_000


def _interp(lo: Column, hi: Column, fr: Column) -> Column:
    return lo + (hi - lo) * fr


def quantiles(df: DataFrame, cols: list[str], probs: list[float], keys: list[str] = (),
              num_partitions: int | None = None, method: str = "auto") -> DataFrame:
    """Exact quantiles with linear interpolation (the pandas / ``percentile`` /
    ``quantile_cont`` definition) for several columns in one job.

    Output: ``keys..., variable, q_0, q_1, ...`` (one column per prob, in order).
    h = (n - 1) p; result = x[floor h] + (x[ceil h] - x[floor h]) (h - floor h).

    ``method="bracket"`` first brackets every target rank with
    ``percentile_approx`` (rank error <= n / accuracy; the bracket is widened
    to twice that), counts the rows below each bracket and ranks only the rows
    inside it, so the exact step touches ~4 n / accuracy rows per quantile
    instead of the whole column.  Every bracket is verified to contain its
    target ranks; if any does not, the result comes from ``method="full"``
    (the ranked value table over all rows).  ``method="auto"`` uses the full
    path while rows x columns <= ``FULL_PATH_MAX_VALUES`` and brackets above;
    below ``AGG_PATH_MAX_ROWS`` rows / ``AGG_PATH_MAX_VALUES`` values it uses
    Spark's exact ``percentile`` aggregate (``method="aggregate"``), whose
    per-group value maps are then small.
    """
    require_numeric(df, cols)
    keys = list(keys)
    long = _unpivot(df, cols, keys).where(F.col("value").isNotNull())
    gk = [*keys, "variable"]
    if method == "auto":
        rows = df.count()
        total = rows * len(cols)
        method = ("aggregate" if rows <= AGG_PATH_MAX_ROWS and total <= AGG_PATH_MAX_VALUES else
                  "full" if total <= FULL_PATH_MAX_VALUES else "bracket")
    if method == "aggregate":
        pct = F.percentile("value", F.array(*[F.lit(float(p)) for p in probs])).alias(TMP + "p")
        agg = long.groupBy(*gk).agg(pct)
        return agg.select(*gk, *[F.col(TMP + "p")[i].alias(f"q_{i}") for i in range(len(probs))])
    if method == "full":
        return _quantiles_full(long, gk, probs, num_partitions)
    A = BRACKET_ACCURACY
    d = 2.0 / A
    ext = []
    for p in probs:
        ext += [max(0.0, p - d), min(1.0, p + d)]
    approx = (long.groupBy(*gk)
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.percentile_approx("value", F.array(*[F.lit(float(e)) for e in ext]), A).alias("b"))
                  )
    approx = stored(approx)            # one row per (key, column)
    # rows inside any bracket, tagged with the quantile(s) they can serve
    j = long.join(F.broadcast(approx) if not keys else approx, gk)
    tags = F.array(*[F.when((F.col("value") >= F.col("b")[2 * i]) & (F.col("value") <= F.col("b")[2 * i + 1]),
                            F.lit(i)) for i in range(len(probs))])
    below = j.groupBy(*gk).agg(*[F.count(F.when(F.col("value") < F.col("b")[2 * i], 1)).alias(f"below{i}")
                                 for i in range(len(probs))],
                               *[F.count(F.when((F.col("value") >= F.col("b")[2 * i]) &
                                                (F.col("value") <= F.col("b")[2 * i + 1]), 1)).alias(f"inb{i}")
                                 for i in range(len(probs))])
    inside = (j.select(*gk, "value", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("qi")))
    rv = ranked_values(inside, "value", [*gk, "qi"], num_partitions=num_partitions)
    meta = approx.select(*gk, "n").join(below, gk)
    r = rv.join(meta, gk)
    h = {i: (F.col("n") - 1).cast("double") * F.lit(float(p)) for i, p in enumerate(probs)}
    aggs, checks = [], []
    for i in range(len(probs)):
        lo_t = F.floor(h[i]) - F.col(f"below{i}")
        hi_t = F.ceil(h[i]) - F.col(f"below{i}")
        mine = F.col("qi") == i
        inside_k = lambda k: mine & (F.col("cum_before") <= k) & (k < F.col("cum_before") + F.col("cnt"))
        aggs += [F.max(F.when(inside_k(lo_t), F.col("value"))).alias(f"{TMP}lo{i}"),
                 F.max(F.when(inside_k(hi_t), F.col("value"))).alias(f"{TMP}hi{i}"),
                 F.max(h[i] - F.floor(h[i])).alias(f"{TMP}fr{i}")]
    res = stored(meta.join(r.groupBy(*gk).agg(*aggs), gk, "left"))  # one row per group
    found = _all([F.col(f"{TMP}lo{i}").isNotNull() & F.col(f"{TMP}hi{i}").isNotNull()
                  for i in range(len(probs))])
    ok = res.agg(F.count(F.lit(1)).alias("groups"), F.count(F.when(found, 1)).alias("good")).first()
    if ok["groups"] != ok["good"]:
        return _quantiles_full(long, gk, probs, num_partitions)
    return res.select(*gk, *[_interp(F.col(f"{TMP}lo{i}"), F.col(f"{TMP}hi{i}"), F.col(f"{TMP}fr{i}"))
                             .alias(f"q_{i}") for i in range(len(probs))])


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _quantiles_full(long: DataFrame, gk: list[str], probs: list[float],
                    num_partitions: int | None) -> DataFrame:
    rv = ranked_values(long, "value", gk, num_partitions=num_partitions)
    pos = []
    for i, p in enumerate(probs):
        h = (F.col("total") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        inside = lambda k: (F.col("cum_before") <= k) & (k < F.col("cum_before") + F.col("cnt"))
        pos += [F.max(F.when(inside(lo), F.col("value"))).alias(f"{TMP}lo{i}"),
                F.max(F.when(inside(hi), F.col("value"))).alias(f"{TMP}hi{i}"),
                F.max(h - lo).alias(f"{TMP}fr{i}")]
    agg = rv.groupBy(*gk).agg(*pos)
    return agg.select(*gk, *[_interp(F.col(f"{TMP}lo{i}"), F.col(f"{TMP}hi{i}"), F.col(f"{TMP}fr{i}"))
                             .alias(f"q_{i}") for i in range(len(probs))])


def order_statistic(df: DataFrame, col: str, k: int, n: int | None = None,
                    method: str = "auto") -> tuple[object, int, int]:
    """The value at 0-based rank ``k`` among the non-NULL values of ``col``,
    with its tie count and the number of values below it: (value, cnt,
    cum_before).  Large inputs use the approximate bracket (approximate
    percentile around k/n, exact counting below it, exact ranking of the rows
    inside it); small ones rank the whole value table."""
    x = df.where(present(df, col)).select(F.col(col).alias("value"))
    n = x.count() if n is None else n
    if not 0 <= k < n:
        raise ValueError("rank out of range")
    if method == "auto":
        method = "full" if n <= FULL_PATH_MAX_VALUES else "bracket"
    if method == "bracket":
        d = 2.0 / BRACKET_ACCURACY
        p = k / max(n - 1, 1)
        lo_p, hi_p = max(0.0, p - d), min(1.0, p + d)
        a_lo, a_hi = x.agg(F.percentile_approx("value", F.array(F.lit(lo_p), F.lit(hi_p)),
                                               BRACKET_ACCURACY)).first()[0]
        inb = (F.col("value") >= F.lit(a_lo)) & (F.col("value") <= F.lit(a_hi))
        below = x.agg(F.count(F.when(F.col("value") < F.lit(a_lo), 1))).first()[0]
        if below <= k:
            rv = ranked_values(x.where(inb), "value")
            hit = rv.where((F.col("cum_before") <= k - below) &
                           (F.col("cum_before") + F.col("cnt") > k - below)).first()
            if hit is not None:
                return hit["value"], hit["cnt"], below + hit["cum_before"]
    rv = ranked_values(x, "value")
    hit = rv.where((F.col("cum_before") <= k) & (F.col("cum_before") + F.col("cnt") > k)).first()
    return hit["value"], hit["cnt"], hit["cum_before"]


def quantile_values(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Driver-side scalars: exact quantiles of one column (a one-row result)."""
    row = quantiles(df, [col], probs).first()
    return [None] * len(probs) if row is None else [row[f"q_{i}"] for i in range(len(probs))]


def average_ranks(df: DataFrame, value: str, keys: list[str] = (),
                  num_partitions: int | None = None) -> DataFrame:
    """Value table with the average (mid) rank of each distinct value:
    ``keys..., value, cnt, cum_before, total, avg_rank`` (ranks start at 1)."""
    rv = ranked_values(df, value, keys, num_partitions=num_partitions)
    return rv.withColumn("avg_rank", F.col("cum_before") + (F.col("cnt") + 1) / 2.0)


# ------------------------------------------------------------- row neighbours
def _k(pos: Column, val: Column) -> Column:
    return F.struct(pos.alias("p"), val.alias("v"))


def neighbours(df: DataFrame, col: str, order_by: list[str] | str,
               partition_by: list[str] | str = (), num_partitions: int | None = None,
               sides: tuple = ("prev", "next")) -> DataFrame:
    """Nothing is stored: the ranges are a plain expression of the order key, the
    summary of the ranges reads the key, the order and the value only, and the
    rows are shuffled once.

    Add, for every row, its global 1-based position ``__sm_pos`` inside its
    partition key and structs ``(p, v)`` for the previous two and next two
    rows holding a non-NULL ``col`` (``__sm_p1, __sm_p2, __sm_n1, __sm_n2``).

    Rows are ordered by ``order_by`` (make it unique: ties have no defined
    order).  Work per range partition, plus a carry frame with one row per
    (key, partition).  ``sides`` limits the lookups to "prev" or "next" (the
    other side's columns are NULL), saving the corresponding window sort.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    require_columns(df, [col, *order_by, *keys])
    P = _parts(df, num_partitions)
    # a few ranges for each task, so that hashing them over the tasks evens out
    r = df.withColumn(_PID, _range_number(df, [*keys, *order_by], P if num_partitions else 4 * P))
    w = Window.partitionBy(*keys, _PID).orderBy(*order_by)
    # "next known" lookups run over the reversed order with a growing frame:
    # Spark evaluates (UNBOUNDED PRECEDING, -1) incrementally, whereas a
    # (1 FOLLOWING, UNBOUNDED FOLLOWING) frame is re-aggregated for every row
    wr = Window.partitionBy(*keys, _PID).orderBy(*[F.col(c).desc() for c in order_by])
    rn, k, kp, kn = (TMP + "rn", TMP + "k", TMP + "kp", TMP + "kn")
    r = r.withColumn(rn, F.row_number().over(w))
    r = r.withColumn(k, F.when(present(df, col), _k(F.col(rn), F.col(col))))
    kt = r.schema[k].dataType
    none_k = F.lit(None).cast(kt)
    r = (r.withColumn(kp, F.last(k, True).over(w.rowsBetween(_UNB, -1)) if "prev" in sides else none_k)
          .withColumn(kn, F.last(k, True).over(wr.rowsBetween(_UNB, -1)) if "next" in sides else none_k))
    pair_prev = F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("a"), F.col(kp).alias("b")))
    pair_next = F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("a"), F.col(kn).alias("b")))
    none_pair = F.lit(None).cast(T.StructType([T.StructField("a", kt), T.StructField("b", kt)]))
    r = (r.withColumn(TMP + "lp", F.last(pair_prev, True).over(w.rowsBetween(_UNB, -1))
                      if "prev" in sides else none_pair)
          .withColumn(TMP + "ln", F.last(pair_next, True).over(wr.rowsBetween(_UNB, -1))
                      if "next" in sides else none_pair)
          .withColumn(TMP + "np", F.count(F.lit(1)).over(Window.partitionBy(*keys, _PID))))
    # The partition's last two known rows are read off its last row (itself
    # and its previous known, or the last pair before it); the first two off
    # its first row.  So the summary needs only 2 rows per partition.
    is_last, is_first = F.col(rn) == F.col(TMP + "np"), F.col(rn) == 1
    r = (r.withColumn(TMP + "e_last", F.when(is_last, F.coalesce(pair_prev, F.col(TMP + "lp"))))
          .withColumn(TMP + "e_first", F.when(is_first, F.coalesce(pair_next, F.col(TMP + "ln")))))
    # One row per (key, partition): size, last two and first two known rows,
    # aggregated from the (at most) two edge rows of each partition.
    meta = (r.where(is_last | is_first).groupBy(*keys, _PID)
             .agg(F.max(TMP + "np").alias(TMP + "n"),
                  F.first(TMP + "e_last", True).alias(TMP + "last2"),
                  F.first(TMP + "e_first", True).alias(TMP + "first2")))
    wk = Window.partitionBy(*keys).orderBy(_PID)
    wkr = Window.partitionBy(*keys).orderBy(F.col(_PID).desc())
    off = F.coalesce(F.sum(TMP + "n").over(wk.rowsBetween(_UNB, -1)), F.lit(0))
    meta = meta.withColumn(TMP + "off", off)

    def glob(s: str) -> Column:  # local (p, v) -> global positions
        c = F.col(s)
        return F.when(c.isNotNull(), _k(c["p"] + F.col(TMP + "off"), c["v"]))

    meta = meta.select(*keys, _PID, TMP + "off",
                       glob(TMP + "last2.a").alias("la"), glob(TMP + "last2.b").alias("lb"),
                       glob(TMP + "first2.a").alias("fa"), glob(TMP + "first2.b").alias("fb"))
    meta = (meta.withColumn("c1", F.last("la", True).over(wk.rowsBetween(_UNB, -1)))
                .withColumn("d1", F.last("fa", True).over(wkr.rowsBetween(_UNB, -1))))
    up_to = F.when(F.col("la").isNotNull(),
                   F.struct(F.col("la").alias("a"), F.coalesce("lb", "c1").alias("b")))
    from_ = F.when(F.col("fa").isNotNull(),
                   F.struct(F.col("fa").alias("a"), F.coalesce("fb", "d1").alias("b")))
    meta = meta.select(*keys, _PID, TMP + "off",
                       F.last(up_to, True).over(wk.rowsBetween(_UNB, -1)).alias(TMP + "cp"),
                       F.last(from_, True).over(wkr.rowsBetween(_UNB, -1)).alias(TMP + "cn"))

    j = _join_small(r, meta, [*keys, _PID], bounded=not keys)
    offc = F.col(TMP + "off")

    def g(c: Column) -> Column:
        return F.when(c.isNotNull(), _k(c["p"] + offc, c["v"]))

    lp, ln, cp, cn = (F.col(TMP + "lp"), F.col(TMP + "ln"), F.col(TMP + "cp"), F.col(TMP + "cn"))
    p1 = F.coalesce(g(lp["a"]), cp["a"])
    p2 = F.when(lp.isNotNull(), F.coalesce(g(lp["b"]), cp["a"])).otherwise(cp["b"])
    n1 = F.coalesce(g(ln["a"]), cn["a"])
    n2 = F.when(ln.isNotNull(), F.coalesce(g(ln["b"]), cn["a"])).otherwise(cn["b"])
    base = [c for c in df.columns]
    return j.select(*base, (F.col(rn) + offc).alias(TMP + "pos"),
                    p1.alias(TMP + "p1"), p2.alias(TMP + "p2"),
                    n1.alias(TMP + "n1"), n2.alias(TMP + "n2"))


def _finish(nb: DataFrame, col: str, expr: Column, cols: list[str]) -> DataFrame:
    return nb.select(*[expr.alias(col) if c == col else F.col(c) for c in cols])


def fill_forward(df: DataFrame, col: str, order_by, partition_by=(), num_partitions=None) -> DataFrame:
    """Last known value in row order (leading gaps stay NULL)."""
    nb = neighbours(df, col, order_by, partition_by, num_partitions, sides=("prev",))
    return _finish(nb, col, F.coalesce(value(df, col), F.col(TMP + "p1.v")), df.columns)


def fill_backward(df: DataFrame, col: str, order_by, partition_by=(), num_partitions=None) -> DataFrame:
    """Next known value in row order (trailing gaps stay NULL)."""
    nb = neighbours(df, col, order_by, partition_by, num_partitions, sides=("next",))
    return _finish(nb, col, F.coalesce(value(df, col), F.col(TMP + "n1.v")), df.columns)


def _linear(pos: Column, a: Column, b: Column) -> Column:
    frac = (pos - a["p"]).cast("double") / (b["p"] - a["p"]).cast("double")
    return a["v"] + (b["v"] - a["v"]) * frac


def _linear_fill() -> Column:
    pos, p1, n1 = F.col(TMP + "pos"), F.col(TMP + "p1"), F.col(TMP + "n1")
    return (F.when(p1.isNotNull() & n1.isNotNull(), _linear(pos, p1, n1))
             .when(p1.isNotNull(), p1["v"]))


def interpolate_linear(df: DataFrame, col: str, order_by, partition_by=(), num_partitions=None) -> DataFrame:
    """Linear in row position with equal spacing; leading gaps stay NULL,
    trailing gaps take the last known value."""
    require_numeric(df, [col])
    nb = neighbours(df, col, order_by, partition_by, num_partitions)
    v = dbl(col)
    return _finish(nb, col, F.coalesce(v, _linear_fill()), df.columns)


def interpolate_cubic(df: DataFrame, col: str, order_by, partition_by=(), num_partitions=None) -> DataFrame:
    """C9 (re-aimed): local cubic through the two known points on each side of a
    gap (four-point Lagrange polynomial in row position).  Gaps with fewer
    than two known neighbours on either side fall back to the linear rule.

    This is not the global smoothing spline a single-machine library fits; a
    local cubic needs only the four neighbours and so runs per partition.
    """
    require_numeric(df, [col])
    nb = neighbours(df, col, order_by, partition_by, num_partitions)
    pos = F.col(TMP + "pos").cast("double")
    pts = [F.col(TMP + n) for n in ("p2", "p1", "n1", "n2")]
    terms = []
    for j, pj in enumerate(pts):
        t = pj["v"]
        for m, pm in enumerate(pts):
            if m != j:
                t = t * (pos - pm["p"]) / (pj["p"] - pm["p"]).cast("double")
        terms.append(t)
    lag = terms[0] + terms[1] + terms[2] + terms[3]
    all4 = pts[0].isNotNull() & pts[1].isNotNull() & pts[2].isNotNull() & pts[3].isNotNull()
    fill = F.when(all4, lag).otherwise(_linear_fill())
    return _finish(nb, col, F.coalesce(dbl(col), fill), df.columns)
