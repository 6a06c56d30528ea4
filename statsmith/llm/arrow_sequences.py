"""Token ids of a corpus as Arrow random-access files of equal-length sequences.

Documents are range-partitioned and sorted by id; each partition writes one
file of record batches with two fixed-size-list columns that can be mapped
into memory and indexed without a copy: ``ids`` (the smallest unsigned type
that holds the vocabulary) and ``mask`` (true for a token, false for the
padding behind the last one).  ``ends`` marks, in a third fixed-size list, the
end id that closes a document - its value alone cannot, for a text may hold
the same id - and ``docs`` lists the ids of the documents that end in the
sequence.  A file is written under a name of the attempt and then renamed, so
a repeated or speculative task leaves the same file.
"""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsmith.llm.common import id_text, open_fs, stored_table
from statsmith.llm.token_ids import steps, word_ids

MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def file_schema(length: int, vocabulary: int) -> pa.Schema:
    small = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(small, length)), ("mask", pa.list_(pa.bool_(), length)),
                      ("ends", pa.list_(pa.bool_(), length)), ("docs", pa.list_(pa.int64()))])


class _SequenceFile:
    """Cuts a stream of documents into sequences and writes them in batches."""

    def __init__(self, sink, schema: pa.Schema, length: int, rows: int):
        self.schema, self.length, self.room = schema, length, rows * length
        self.out = pa.ipc.new_file(sink, schema)
        self.parts: list[np.ndarray] = []
        self.held = self.n_docs = self.n_tokens = 0
        self.ends: list[tuple[int, int | None]] = []      # (position among the held ids, document)

    def add(self, doc, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        self.ends.append((self.held - 1, doc))
        if self.held >= self.room:
            self._flush(self.held // self.length * self.length)

    def _flush(self, n: int) -> None:
        """Write the first ``n`` held ids, padded to whole sequences."""
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        now, later = flat[:n], flat[n:]
        rows = -(-n // self.length)
        ids = np.zeros(rows * self.length, self.schema.field("ids").type.value_type.to_pandas_dtype())
        ids[:n] = now
        done = [e for e in self.ends if e[0] < n]
        ends = np.zeros(rows * self.length, bool)
        ends[[p for p, _ in done]] = True
        cuts = np.searchsorted([p for p, _ in done], np.arange(rows + 1) * self.length)
        docs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array([d for _, d in done], pa.int64()))
        fixed = lambda a, t: pa.FixedSizeListArray.from_arrays(pa.array(a, t), self.length)
        whole = pa.RecordBatch.from_arrays(
            [fixed(ids, self.schema.field("ids").type.value_type), fixed(np.arange(len(ids)) < n, pa.bool_()),
             fixed(ends, pa.bool_()), docs], schema=self.schema)
        step = self.room // self.length
        for i in range(0, rows, step):
            self.out.write_batch(whole.slice(i, step))
        self.parts, self.held = ([later] if len(later) else []), len(later)
        self.ends = [(p - n, d) for p, d in self.ends[len(done):]]

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        self.out.close()


def write_sequences(df: DataFrame, tokenizer_file: str, folder: str, length: int = 2048, end_id: int = 1,
                    rows_per_batch: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and return the stored manifest, one row per file:
    ``shard, path, n_docs, n_tokens`` (shards in ascending id order).

    Null and empty text give the end id alone.  Rows that share an id are
    documents of their own, ordered by text.  A null id sorts first.  An empty
    table gives an empty manifest and no file.  ``folder`` is a URI or path
    that driver and executors share.
    """
    docs = id_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        coder = word_ids(tokenizer_file)
        schema = file_schema(length, coder.tok.get_vocab_size())
        shard = TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        draft = posixpath.join(base, f".draft-{shard}-{uuid.uuid4().hex}")
        name = f"part-{shard:06d}.arrow"
        sink = fs.open_output_stream(draft)
        out = _SequenceFile(sink, schema, length, rows_per_batch)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in steps(texts):
                for d, raw in zip(ids[lo:hi], coder(texts[lo:hi]), strict=True):
                    out.add(d, np.frombuffer(raw + end, "<u4"))
        out.close()
        sink.close()
        if not out.n_docs:
            fs.delete_file(draft)
            return
        fs.move(draft, posixpath.join(base, name))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([posixpath.join(folder, name)]),
             pa.array([out.n_docs], pa.int64()), pa.array([out.n_tokens], pa.int64())],
            names=["shard", "path", "n_docs", "n_tokens"])

    return stored_table(docs.mapInArrow(write, MANIFEST), "manifest")


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids``
    (``ids``: little-endian unsigned 32-bit bytes; ``start``: ids of all
    documents before it).  The driver holds one manifest row per file."""
    files, start = [], 0
    for r in manifest.orderBy("shard").collect():
        files.append((r["path"], start))
        start += r["n_tokens"]

    def read(batches):
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    yield from _documents(pa.ipc.open_file(f), first)

    listed = spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _documents(file, position: int):
    """Record batches of documents of one file; a document that goes on in the
    next batch is carried over."""
    carry = []
    for k in range(file.num_record_batches):
        rb = file.get_batch(k)
        n = int(np.count_nonzero(_flat(rb, "mask")))
        ids, ends = _flat(rb, "ids")[:n], np.flatnonzero(_flat(rb, "ends")[:n])
        rows, begin = ([], [], [], []), 0
        for doc, e in zip(rb.column("docs").flatten().to_pylist(), ends.tolist(), strict=True):
            whole = np.concatenate([*carry, ids[begin:e + 1]]).astype("<u4")
            carry, begin = [], e + 1
            for column, v in zip(rows, (doc, position, len(whole), whole.tobytes()), strict=True):
                column.append(v)
            position += len(whole)
        if begin < n:
            carry.append(ids[begin:].copy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()),
             pa.array(rows[3], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def _flat(rb, name: str) -> np.ndarray:
    return rb.column(name).flatten().to_numpy(zero_copy_only=False)
