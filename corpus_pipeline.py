"""A corpus from documents to packed training sequences.

``STAGES`` are applied in order.  Each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written as Parquet and reread as the next stage's
``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsmith.llm import exact_dedup, language_crf, packing, probminhash, suffix_dedup
from statsmith.llm.common import fresh_dir
from statsmith.llm.queries import WORD_FILE

MIN_SCORE = 0.5                       # a language must hold most of a document's words


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the kept ids (a null id is an id here)."""
    ids = kept.select(F.col("doc_id").alias("kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in which no language holds a
    mean posterior of ``MIN_SCORE``; repeated rows stay or go together, an
    empty table stays empty.  Rows are filtered in place, without a shuffle."""
    return language_crf.keep_identified(docs, language_crf.learn(docs), MIN_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for A-Z case:
    the one with the smallest id; a repeated row once."""
    found = exact_dedup.exact_dedup(docs, keep="smallest", normalise=exact_dedup.lower_ascii).filter("kept")
    kept = found.select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("sha", F.sha2(exact_dedup.lower_ascii(text), 256))
    rows = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["kept_id"]) & (keyed["sha"] == kept["kept_sha"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "sha"]).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one that the operator
    marks as kept, with all rows of its id (a null id is an id); an empty
    table stays empty.  Only ids travel to the rows."""
    return _only(docs, probminhash.near_duplicates(docs, threshold=0.8).filter("kept"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that an earlier document
    holds; documents of which nothing is left go.  A repeated row stays once; an
    empty table stays empty.  The other columns travel with the text, which is
    shuffled once."""
    other = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = suffix_dedup.remove_repeats(docs, width=50, texts=True, distinct=True, carry=other).filter(F.trim("kept_text") != "")
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    made |= {c: F.col(f"carried_{i}") for i, c in enumerate(other)}
    return found.select([made[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents in sequences of 2048; repeated rows are
    packed as often as they come, an empty table gives no pieces."""
    return packing.pack(docs, WORD_FILE, length=2048)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", passages),
          ("packing", packed)]

#: Learning, signatures and packing have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared
    folder that the session names in ``spark.checkpoint.dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
