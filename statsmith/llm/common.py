"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsmith.session import checkpoint_dir


def quoted(name: str):
    """Column by literal name (names may hold dots, blanks or backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(df: DataFrame, id_col: str, text_col: str, id_name: str = "doc_id") -> DataFrame:
    """Only the id and the whole text, under fixed names; null text is empty."""
    return df.select(quoted(id_col).alias(id_name), F.coalesce(quoted(text_col), F.lit("")).alias("text"))


def fresh_dir(spark: SparkSession, what: str) -> str:
    """Path (not yet made) of a new folder in the shared folder that the
    session names in ``spark.checkpoint.dir``."""
    return posixpath.join(checkpoint_dir(spark), "statsmith-llm", f"{what}-{uuid.uuid4().hex}")


def stored_table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it: cuts the
    lineage, is computed once, and survives the loss of executors."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str, rows: int):
    """Jobs started inside send at most about ``size`` bytes to a Python worker
    at once (never less than a row) and read Parquet in batches of ``rows``; the
    session's own bounds come back after.  For rows of many kB, of which the
    usual thousands are too much memory."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def open_fs(uri: str):
    """(file system, path) for a folder URI or plain absolute path; used
    inside tasks for file formats that Spark itself does not write."""
    return pafs.FileSystem.from_uri(uri)
