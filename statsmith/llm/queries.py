"""Registered queries of this subpackage: each applies one operator, with its
production parameters, to a whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsmith.llm import (
    arrow_sequences,
    byte_bpe,
    collocations,
    exact_dedup,
    importance,
    language_crf,
    lexical_search,
    packing,
    probminhash,
    quality_rules,
    sentencepiece_bpe,
    suffix_dedup,
    warc,
)
from statsmith.llm.common import fresh_dir

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), width=50)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "rejected_by")


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_crf.identify(docs, language_crf.learn(docs))
    return found.select("doc_id", language_crf.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest", normalise=exact_dedup.lower_ascii)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    files = warc.write_archives(warc.plan_records(pages, min_bytes=0), fresh_dir(spark, "warc"))
    paths = [r["path"] for r in files.select("path").collect()]        # one row per file
    return warc.resolve(warc.read_archives(spark, paths))


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(documents(spark, sf_dir), threshold=0.8)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), WORD_FILE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op9_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = arrow_sequences.write_sequences(documents(spark, sf_dir), WORD_FILE, fresh_dir(spark, "sequences"))
    return arrow_sequences.read_documents(spark, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(documents(spark, sf_dir), PIECE_FILE, digests=True)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(documents(spark, sf_dir), BYTE_FILE)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return lexical_search.search(documents(spark, sf_dir), items, k=50)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_importance": op2_importance,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_crf": op4_language_crf,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_probminhash": op7_probminhash,
    "op8_packing": op8_packing,
    "op9_arrow_sequences": op9_arrow_sequences,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_collocations": op11_collocations,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
