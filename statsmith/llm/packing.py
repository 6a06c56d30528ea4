"""Bounded-space online packing of documents into training sequences.

Each partition keeps a fixed number of open windows.  A document's full
windows are sequences of their own; its rest goes to the open window that it
fills best.  When none fits and no more may be opened, the fullest window is
filled with the first ids of the rest and emitted, and the remainder is placed
again.  Windows still open at the end of a partition are merged, many
partitions to a task, into full sequences; what is left of a merge is cut into
lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.llm.common import id_text, small_batches, stored_table
from statsmith.llm.token_ids import steps, word_ids

PIECE = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
MERGED = 1 << 62                      # sequence ids of merged leftovers start here
MERGE_PARTITIONS = 64                 # partitions whose leftovers one task merges
BATCH, BATCH_ROWS = "4m", 1024        # bytes of texts sent to a Python worker at once, rows read at once


class Packer:
    """Packs one partition; full sequences go to ``rows`` as they close."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.windows, self.next_id = length, windows, first_id
        self.open: list[list] = []                # [used, [(doc, start, ids, doc_tokens), ...]]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), total, self.next_id, offset, ids.tobytes()))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, at, size = len(ids), 0, self.length
        while total - at >= size:
            self.emit([(doc, at, ids[at:at + size], total)])
            at += size
        while at < total:
            at = self.place(doc, at, ids, total)

    def place(self, doc, at: int, ids: np.ndarray, total: int) -> int:
        """Place ids from ``at`` on; returns the first id not yet placed."""
        rest = total - at
        best = max((w for w in self.open if w[0] + rest <= self.length), key=lambda w: w[0], default=None)
        if best is None:
            if len(self.open) < self.windows:
                self.open.append(best := [0, []])
            else:
                best = max(self.open, key=lambda w: w[0])
        n = min(rest, self.length - best[0])
        best[0] += n
        best[1].append((doc, at, ids[at:at + n], total))
        if best[0] == self.length:
            self.emit(best[1])
            self.open = [w for w in self.open if w is not best]
        return at + n


def merge_windows(pieces, length: int, first_id: int) -> list[tuple]:
    """Pieces of leftover windows, in order, as full sequences; the last ids
    as sequences whose lengths are falling powers of two."""
    total = sum(len(p[2]) for p in pieces)
    sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length(), -1, -1) if total % length >> b & 1]
    out, k, used = Packer(length, 0, first_id), 0, 0
    current: list[tuple] = []
    for doc, start, ids, tokens in pieces:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, sizes[k] - used)
            current.append((doc, start + at, ids[at:at + n], tokens))
            at, used = at + n, used + n
            if used == sizes[k]:
                out.emit(current)
                current, k, used = [], k + 1, 0
    return out.rows


def _batch(rows: list[tuple], id_type: pa.DataType, extra: tuple = ()) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * (7 + len(extra))
    kinds = [id_type] + [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * len(extra)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", *extra]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def pack(df: DataFrame, tokenizer_file: str, length: int = 2048, windows: int = 32, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id,
    offset, ids`` (little-endian unsigned 32-bit bytes).

    ``length`` must be a power of two.  Null and empty text are documents of
    the end id alone.  Rows that share an id are documents of their own.  An
    empty table gives an empty result.  No sequence needs padding: each holds
    ``length`` ids or, at the end of a merge, a smaller power of two.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    docs = id_text(df, id_col, text_col)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    piece = PIECE.format(id=id_kind)

    def place(batches):
        coder = word_ids(tokenizer_file)
        part = TaskContext.get().partitionId()
        packer = Packer(length, windows, part << 32)
        end = np.array([end_id], "<u4").tobytes()
        id_type = pa.int64()
        for b in batches:
            id_type = b.column(0).type
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in steps(texts):
                for d, raw in zip(ids[lo:hi], coder(texts[lo:hi]), strict=True):
                    packer.add(d, np.frombuffer(raw + end, "<u4"))
                yield _batch([(*r, None, None, None) for r in packer.rows], id_type, ("part", "window", "nth"))
                packer.rows = []
        left = [(doc, start, len(ids), total, None, None, ids.tobytes(), part, w, i)
                for w, (_, pieces) in enumerate(packer.open) for i, (doc, start, ids, total) in enumerate(pieces)]
        if left:
            yield _batch(left, id_type, ("part", "window", "nth"))

    with small_batches(df.sparkSession, BATCH, BATCH_ROWS):
        placed = stored_table(docs.mapInArrow(place, piece + ", part long, window long, nth long"), "pieces")

    def merge(key, table):
        table = table.sort_by([("part", "ascending"), ("window", "ascending"), ("nth", "ascending")])
        pieces = [(d, s, np.frombuffer(i, "<u4"), t) for d, s, i, t in zip(
            *(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)]
        rows = merge_windows(pieces, length, MERGED + (key[0].as_py() << 32))
        return pa.Table.from_batches([_batch(rows, table.schema.field("doc_id").type)])

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    leftover = placed.filter(F.col("sequence_id").isNull()).withColumn(
        "dealt", F.floor(F.col("part") / MERGE_PARTITIONS))
    merged = leftover.groupBy("dealt").applyInArrow(merge, piece)
    return placed.filter(F.col("sequence_id").isNotNull()).select(names).unionByName(merged)
