"""CSV records of large files, line breaks inside quoted fields included.

A file is read in the blocks that Spark deals out, many tasks a file.  Whether
a block starts inside a quoted field depends on all that stands before it, but
only through the parity of the quotes: every block reports the parity of its
quotes, a running sum over the blocks (a row each) tells in which state each
one starts, and then every block cuts its lines into records by itself.  A
record that runs over a block's end leaves a piece in each block it touches;
pieces carry the block in which their record starts and are put together by
it, a group per broken record.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, value``: the lines in file order within each block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches):
    """(file, block, lines) in order; a block may come in several runs."""
    for b in batches:
        files, blocks = b.column(0).to_pylist(), b.column(1).to_numpy()
        change = [i for i in range(1, b.num_rows) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
        for lo, hi in zip([0, *change], [*change, b.num_rows], strict=True):
            if hi > lo:
                yield files[lo], int(blocks[lo]), b.column(2).slice(lo, hi - lo)


def _states(lines: pa.Array, state: int) -> np.ndarray:
    """1 after each line that ends inside a quoted field, given the state before."""
    return (np.cumsum(pc.count_substring(lines, QUOTE).to_numpy()) + state) & 1


def block_summary(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, odd, turns``: whether a block holds an odd number of
    quotes, and whether a line before its last one ends in the other state
    than the block starts in."""

    def run(batches):
        at, odd, turns = None, 0, False
        for file, block, lines in _runs(batches):
            if at != (file, block):
                if at:
                    yield row(*at, odd, turns)
                at, odd, turns = (file, block), 0, False
            s = _states(lines, odd)
            turns = turns or bool(odd) or bool(s[:-1].any())
            odd = int(s[-1])
        if at:
            yield row(*at, odd, turns)

    def row(file, block, odd, turns):
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([odd], pa.int32()),
                                           pa.array([turns])], names=["file", "block", "odd", "turns"])

    return _lines(spark, path).mapInArrow(run, "file string, block long, odd int, turns boolean")


def block_states(summary: DataFrame) -> DataFrame:
    """``file, block, open, owner``: for each block that starts inside a quoted
    field, the block in which that field's record starts."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = summary.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    begins = (F.col("open") == 0) | F.col("turns")                     # a record starts in the block
    tail = begins & ((F.col("open") + F.col("odd")) % 2 == 1)          # and the last one runs over its end
    s = s.withColumn("tail", F.when(tail, F.col("block")))
    return s.withColumn("owner", F.last("tail", ignorenulls=True).over(before)).filter("open = 1").select("file", "block", "owner")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, record``: every record's text, with the block and
    the line in it where the record starts.  Blank records are left out."""
    owners = {(r["file"], r["block"]): r["owner"] for r in block_states(block_summary(spark, path)).collect()}
    held = spark.sparkContext.broadcast(owners)                        # a number for each block of the files, at most

    def run(batches):
        owner_of = held.value
        at, state, n, parts, begin = None, 0, 0, [], None
        for file, block, lines in _runs(batches):
            if at != (file, block):
                if parts:
                    yield rows(*at, [(*begin, False, "\n".join(parts))])
                at, n, parts = (file, block), 0, []
                state = int(at in owner_of)
                begin = (owner_of[at], -1) if state else None
            s = _states(lines, state)
            text = lines.to_pylist()
            out, start = [], 0
            for end in np.flatnonzero(s == 0).tolist():
                if parts or begin is not None:                         # goes on from before these lines
                    parts += text[start:end + 1]
                    out.append((*begin, begin[1] >= 0, "\n".join(parts)))
                    parts, begin = [], None
                else:
                    out.append((block, n + start, True, text[start] if end == start else "\n".join(text[start:end + 1])))
                start = end + 1
            if start < len(text):
                begin = begin or (block, n + start)
                parts += text[start:]
            state, n = int(s[-1]), n + len(text)
            if out:
                yield rows(file, block, out)
        if parts:
            yield rows(*at, [(*begin, False, "\n".join(parts))])

    def rows(file, block, found):
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * len(found)), pa.array([block] * len(found), pa.int64()),
             pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
             pa.array([x[2] for x in found]), pa.array([x[3] for x in found], pa.string())],
            names=["file", "piece", "block", "line", "whole", "record"])

    found = _lines(spark, path).mapInArrow(
        run, "file string, piece long, block long, line long, whole boolean, record string")
    whole = found.filter("whole").select("file", "block", "line", "record")
    broken = found.filter("NOT whole").groupBy("file", "block").agg(
        F.sort_array(F.collect_list(F.struct("piece", "line", "record"))).alias("p"))     # the pieces of one record
    broken = broken.select("file", "block", F.array_max("p.line").alias("line"), F.array_join("p.record", "\n").alias("record"))
    return whole.unionByName(broken).filter(F.trim(F.regexp_replace("record", "\r$", "")) != "")


def read_csv_blocks(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; the first record of each file is its header."""
    found = records(spark, path)
    first = (F.col("block") == 0) & (F.col("line") == 0)
    head = found.filter(first).orderBy("file").limit(1).collect()                        # one row
    if not head:
        raise ValueError("no header")
    names = next(csv.reader([head[0]["record"].removeprefix("﻿").removesuffix("\r")]))
    names = [x or f"_c{i}" for i, x in enumerate(names)]
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    text = F.regexp_replace("record", "\r$", "")
    parsed = found.filter(~first).select(F.from_csv(text, schema, {"escape": QUOTE, "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(x) for i, x in enumerate(names)])
