"""Quality selection by importance resampling.

Two generative models over hashed n-grams (words and word pairs of the
lower-cased text, ``SLOTS`` buckets): one of the target text, labelled good,
and one of the raw text, all documents.  A document's importance weight is the
ratio of its probabilities under the two.  Resampling without replacement by
the Gumbel trick: add Gumbel noise to the log-weight and keep the k largest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.llm.common import id_text, quoted, stored_table
from statsmith.llm.probminhash import word_hashes
from statsmith.llm.token_ids import steps

SLOTS = 1 << 14                       # hashed n-grams
EQUAL_ROWS = 10_000                   # equal rows of a block
U = np.uint64


def ngram_slots(texts: list[str]):
    """(document, slot) of every word and word pair of whole texts."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = word_hashes()([w for ws in words for w in ws])
    doc = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    two = h[pair] * U(0x9E3779B97F4A7C15) + h[pair + 1] if len(pair) else h[:0]
    two = (two ^ (two >> U(32))) * U(0xD6E8FEB86659FD93)
    slot = np.concatenate([h, two]) >> U(50)
    return np.concatenate([doc, doc[pair]]), slot.astype(np.int64)


def slot_counts(docs: DataFrame) -> DataFrame:
    """``slot, raw, target``: counts over all rows of ``doc_id, text, good``;
    a task sends at most one row per slot."""

    def run(batches):
        total = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            texts, good = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), bool)
            for lo, hi in steps(texts):
                doc, slot = ngram_slots(texts[lo:hi])
                total[0] += np.bincount(slot, minlength=SLOTS)
                total[1] += np.bincount(slot[good[lo:hi][doc]], minlength=SLOTS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])],
                                         names=["slot", "raw", "target"])

    each = docs.mapInArrow(run, "slot long, raw long, target long")
    return each.groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts, smooth: float = 1.0) -> np.ndarray:
    """Log of target over raw probability per slot, with additive smoothing."""
    raw, target = np.zeros(SLOTS), np.zeros(SLOTS)
    for r in counts:
        raw[r["slot"]], target[r["slot"]] = r["raw"], r["target"]
    ratio = (target + smooth) / (target.sum() + smooth * SLOTS) / ((raw + smooth) / (raw.sum() + smooth * SLOTS))
    return np.log(ratio)


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, text_hash, n_grams, log_weight`` of each whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(ratios)            # SLOTS numbers

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in steps(texts):
                doc, slot = ngram_slots(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(np.bincount(doc, minlength=hi - lo)),
                     pa.array(np.bincount(doc, held.value[slot], hi - lo))], names=["doc_id", "text_hash", "n_grams", "log_weight"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, f"doc_id {kind}, text_hash long, n_grams long, log_weight double")


def drawn(weights: DataFrame, seed: int) -> DataFrame:
    """The rows with ``draw``, a hash of id, text, seed and a number among equal
    rows, and ``sample_key``, the log-weight with the Gumbel noise of the draw.
    Equal rows are counted (map-side combined) and laid out again from their
    number in blocks, so a text that holds a third of all rows is spread."""
    same = weights.groupBy("doc_id", "text_hash", "n_grams", "log_weight").count()
    last = ((F.col("count") - 1) / EQUAL_ROWS).cast("long")
    blocks = same.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("doc_id", "text_hash", "block")
    first = F.col("block") * EQUAL_ROWS
    rows = blocks.withColumn("number", F.explode(F.sequence(first, F.least(F.col("count"), first + EQUAL_ROWS) - 1)))
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text_hash", "number", F.lit(seed)))
    uniform = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) * 2.0 ** -53
    return rows.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("sample_key"), "draw")


def kth_largest(df: DataFrame, key: str, tie: str, k: int):
    """(key, tie) of the k-th row by ``key`` falling, ``tie`` rising: ever
    finer histograms, then the rows of one narrow bin.  No global sort."""
    rows, rank = df, k
    while True:
        r = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        low, high, n = r[0], r[1], r[2]
        if n <= 2000 or low == high:
            break
        width = (high - low) / 1000
        bins = rows.groupBy(F.floor((F.lit(high) - F.col(key)) / F.lit(width)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("bin").collect()
        for b in bins:
            if rank <= b["n"]:
                break
            rank -= b["n"]
        if b["n"] == n:
            break
        rows = rows.filter((F.col(key) >= b["low"]) & (F.col(key) <= b["high"]))
    if low == high and n > 2000:                      # equal keys: narrow by the tie column instead
        return low, rows.agg(F.expr(f"percentile_disc({rank / n}) WITHIN GROUP (ORDER BY {tie})")).first()[0]
    last = rows.orderBy(F.desc(key), F.asc(tie)).limit(rank).collect()[-1]
    return last[key], last[tie]


def resample(df: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17,
             max_labels: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_grams, log_weight, sample_key,
    kept``.

    ``labels`` has ``doc_id, quality, toxic``; the target model is fitted on at
    most ``max_labels`` labelled documents that are good and not toxic (chosen
    by id hash), the raw model on all documents.  ``share`` of the rows are
    kept; by default the share of good rows among the labels.  Null
    and empty texts have weight 0 (log) and no n-grams, and are never sampled.
    Every row has noise of its own, drawn from its id, its text and a number
    among equal rows; a null id is an id like any other; equal keys fall to the
    smaller draw.  So exactly the asked number of rows is kept.  An empty table
    gives an empty result; without labels all rows with words are kept.
    """
    by = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known, fine = by.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    target = by.filter("quality = 1 AND toxic = 0").orderBy(F.xxhash64("doc_id")).limit(max_labels).select(
        quoted("doc_id"), F.lit(True).alias("good"))
    docs = id_text(df, id_col, text_col)
    marked = docs.join(F.broadcast(target), "doc_id", "left").select(      # at most max_labels ids
        "doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    ratios = log_ratios(slot_counts(marked).collect())                   # at most SLOTS rows
    scored = stored_table(drawn(log_weights(docs, ratios), seed), "weights")
    rows = scored.filter("n_grams > 0")
    n, words = scored.count(), rows.count()
    share = (fine / known if known else 1.0) if share is None else share
    k = min(words, round(share * n))
    if k == 0:
        kept = F.lit(False)
    else:
        key, tie = kth_largest(rows, "sample_key", "draw", k)
        kept = (F.col("n_grams") > 0) & ((F.col("sample_key") > key) | ((F.col("sample_key") == key) & (F.col("draw") <= tie)))
    return scored.withColumn("kept", kept).drop("draw")
