"""Exact, repeatable train/test split.

Rows are ordered by ``xxhash64(key, seed)``; the test part is the
ceil(n * test_size) rows with the smallest hashes.  The threshold hash is an exact order statistic (``ordered.order_statistic``:
approximate bracket, exact ranking inside it), so no task sorts all rows, and
the result does not depend on how the frame is partitioned.  When
several rows share the threshold hash (duplicate keys), exactly the missing
number of them is taken by per-partition quotas.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statsmith.functions.columns import TMP, require_columns
from statsmith.operators import ordered
from statsmith.session import stored

_H = TMP + "h"


def _take_exact(tie: DataFrame, need: int) -> tuple[DataFrame, DataFrame]:
    """Split ``tie`` into exactly ``need`` rows and the rest, spreading the
    work over partitions (quota per partition from a prefix of counts)."""
    pid = TMP + "tp"
    P = tie.sparkSession.sparkContext.defaultParallelism
    tagged = stored(tie.repartition(max(P, 1)).withColumn(pid, F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in tagged.groupBy(pid).count().collect())  # <= P rows
    quota, left = {}, need
    for p, c in counts:
        quota[p] = min(c, left)
        left -= quota[p]
    qexpr = F.lit(0)
    for p, q in quota.items():
        qexpr = F.when(F.col(pid) == p, F.lit(q)).otherwise(qexpr)
    rn = F.row_number().over(Window.partitionBy(pid).orderBy(F.xxhash64(*[c for c in tie.columns])))
    t = tagged.withColumn(TMP + "rn", rn).withColumn(TMP + "in", F.col(TMP + "rn") <= qexpr)
    cols = [c for c in tie.columns]
    return t.where(F.col(TMP + "in")).select(cols), t.where(~F.col(TMP + "in")).select(cols)


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                     key: str | list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Return (train, test) with exactly ceil(n * test_size) test rows."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    require_columns(df, keys)
    h = df.withColumn(_H, F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(seed)))
    n = df.count()
    k = math.ceil(n * test_size)
    if k == 0:
        return df, df.where(F.lit(False))
    # the k-th smallest hash (0-based rank k - 1), exact, without sorting all rows
    thr, cnt, before = ordered.order_statistic(h.select(_H), _H, k - 1, n)
    need = k - before
    cols = df.columns
    below = h.where(F.col(_H) < thr).select(cols)
    above = h.where(F.col(_H) > thr).select(cols)
    tie = h.where(F.col(_H) == thr).select(cols)
    if need == cnt:
        return above, below.unionByName(tie)
    tie_test, tie_train = _take_exact(tie, need)
    return above.unionByName(tie_train), below.unionByName(tie_test)


def hash_folds(df: DataFrame, k: int = 3, seed: int = 42, key: str | list[str] | None = None,
               name: str = "fold") -> DataFrame:
    """I18 helper: fold id 0..k-1 per row from a hash of ``key`` (repeatable,
    partition-independent; for a classifier the classes spread evenly in
    expectation)."""
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    return df.withColumn(name, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keys], F.lit(seed + 1)),
                                      F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, label: str, k: int = 3, seed: int = 42,
                     key: str | list[str] | None = None, name: str = "fold") -> DataFrame:
    """I18 for classifiers: fold id 0..k-1 with every class spread evenly
    (per-class fold sizes differ by at most one, like stratified k-fold).

    Rows are ordered inside their class by a hash of ``key``; the position in
    that order (from the ranked value table keyed by class, so a class holding
    a third of the rows spans many range partitions) modulo k is the fold.
    Rows sharing a key hash share a fold."""
    keys = [key] if isinstance(key, str) else list(key or [c for c in df.columns if c != label])
    h = TMP + "fh"
    hashed = df.withColumn(h, F.xxhash64(*[F.col(f"`{c}`") for c in keys], F.lit(seed + 2)))
    rv = ordered.ranked_values(hashed.select(label, h), h, [label])
    folds = rv.select(label, h, F.pmod(F.col("cum_before"), F.lit(k)).cast("int").alias(name))
    return hashed.join(folds, [label, h]).drop(h)
