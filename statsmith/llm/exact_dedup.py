"""Exact deduplication by a 128-bit content hash with a byte comparison.

Documents are grouped by the MD5 (128 bits) of the normalised text.  The first
grouping key is (hash, text): Spark's hash aggregation finds a group by its
hash and then compares the key bytes, so two different texts with one hash are
never one group.  It runs partially before the shuffle, so a text with any
number of copies leaves each map task once.  The decision goes back to the
rows over (hash, SHA-256), the address of a group; an address that held two
different texts would raise instead of merging them.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.llm.common import id_text


def lower_ascii(c):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest", normalise=lambda c: c) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` says which id of a group stays ("smallest" or "largest").
    Null text counts as empty, and all empty texts are one group.  A row
    repeated with the same id and text counts in ``group_size`` each time and
    both copies carry the same decision.  A null id stays only where no row of
    its group has an id.  An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    pick = F.min if keep == "smallest" else F.max
    docs = id_text(df, id_col, text_col).select("doc_id", normalise(F.col("text")).alias("body"))
    hashed = docs.select("doc_id", "body", F.unhex(F.md5("body")).alias("h"), F.sha2("body", 256).alias("text_sha256"))
    same = hashed.groupBy("h", "body").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
                                           F.first("text_sha256").alias("text_sha256"))
    groups = same.groupBy("h", "text_sha256").agg(
        F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("texts"))
    groups = groups.select(
        "h", "text_sha256", "keep_id",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("long"))
        .otherwise(F.col("group_size")).alias("group_size"))
    rows = hashed.select("doc_id", "h", "text_sha256")
    return rows.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
