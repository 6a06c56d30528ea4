"""WARC archives with segmented records: writing, reading, reassembly.

The writer makes one record per input row: ``response`` with the payload behind an
HTTP head in chunked transfer framing, or ``revisit`` without it where an
earlier page has the same payload.  A block above ``segment_bytes`` becomes a
first segment and ``continuation`` records, which may go on in the next file.
The reader groups segments by origin identifier, orders them by segment
number, verifies the total length and decodes the framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import urllib.parse
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsmith.llm.common import open_fs, quoted, stored_table

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")    # fixed value: UUIDs named by a URL
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"   # fixed by the format
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def record_id(name: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{name}/{number}')}>"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def frame(payload: bytes, chunk: int) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for i in range(0, len(payload), chunk):
        c = payload[i:i + chunk]
        parts += [b"%x\r\n" % len(c), c, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframe(body: bytes) -> bytes:
    """Payload of a chunked body; raises ValueError when it is cut short."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[line + 2 + n:line + 4 + n] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[line + 2:line + 2 + n])
        at = line + 4 + n


def payload_of(block: bytes) -> bytes:
    """Payload behind the HTTP head of a response block."""
    cut = block.index(b"\r\n\r\n")
    head, body = block[:cut].lower(), block[cut + 4:]
    return unframe(body) if b"transfer-encoding: chunked" in head else body


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, sha1, refers_to, name, number, refers_name``:
    one row per input row.  ``name`` stands for page id, payload and URL;
    ``number`` counts the rows that are equal in all three.  Payloads of at
    least ``min_bytes`` that are equal (length and SHA-256) refer to the
    smallest page id among them, whose rows are all responses; for a response
    ``refers_to`` is null, for a revisit the payload.  Null html is an empty
    payload.  Where no row of a payload has a page id, one of them is the
    response (the SQL calls all of them revisits, which no archive can hold)."""
    page = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(quoted(html_col), F.lit("")), "UTF-8").alias("payload"))
    page = page.withColumn("k", F.sha2("payload", 256))
    page = page.withColumn("name", F.sha2(F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "k",
                                                      F.concat(F.lit("url:"), F.col("url"))), 256))
    # the keys come from the rows themselves, so that payloads are shuffled once
    keys = page.select("name", "page_id", "k", F.octet_length("payload").alias("n")).filter(F.col("n") >= min_bytes)
    keys = keys.groupBy("name", "page_id", "k", "n").agg(F.count(F.lit(1)).alias("rows"))
    none = F.col("page_id").isNull()
    first = keys.groupBy("k", "n").agg(F.min(F.struct(none.alias("none"), "page_id", "name")).alias("first"),
                                       F.sum("rows").alias("copies"))
    later = keys.join(first.filter("copies > 1"), ["k", "n"]).filter(none | (F.col("page_id") != F.col("first.page_id")))
    later = later.select("name", F.col("first.page_id").alias("first_id"), F.col("first.name").alias("first_name"))
    rows = page.groupBy("name").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"),
                                    F.first("payload").alias("payload"), F.count(F.lit(1)).alias("rows"))
    each = rows.join(later, "name", "left").select(
        "*", F.unhex(F.sha1("payload")).alias("sha1"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("number"))
    again = F.col("first_name").isNotNull() & ((F.col("first_name") != F.col("name")) | (F.col("number") > 0))
    return each.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "sha1",
                       F.when(again, F.col("first_id")).alias("refers_to"), "name", "number",
                       F.when(again, F.col("first_name")).alias("refers_name"))


def _record(kind: str, rid: str, block: bytes, fields: dict) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": DATE, **fields, "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def records_of(page_id, url, payload, sha1: bytes, name, number, refers_name, segment_bytes: int, chunk_bytes: int):
    """Serialised records of one row of ``plan_records``."""
    rid = record_id(name, number)
    uri = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%") if url else f"urn:x-page:{page_id}"
    fields = {"WARC-Target-URI": uri, "WARC-Payload-Digest": "sha1:" + base64.b32encode(sha1).decode(),
              "X-Page-Id": page_id, "Content-Type": "application/http; msgtype=response"}
    if payload is None:
        yield _record("revisit", rid, HEAD, {**fields, "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_name, 0)})
        return
    block = HEAD + frame(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record("response", rid, block, fields)
        return
    cuts = range(0, len(block), segment_bytes)
    for n, i in enumerate(cuts, 1):
        part = block[i:i + segment_bytes]
        if n == 1:
            yield _record("response", rid, part, {**fields, "WARC-Segment-Number": 1})
        else:
            yield _record("continuation", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{name}/{number}/{n}')}>", part,
                          {"WARC-Target-URI": uri, "WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": n,
                           "WARC-Segment-Total-Length": len(block) if n == len(cuts) else None})


def write_archives(records: DataFrame, folder: str, segment_bytes: int = 16_384, chunk_bytes: int = 4_096,
                   file_bytes: int = 64 << 20) -> DataFrame:
    """Write ``plan_records`` rows as ``.warc.gz`` files (one gzip member per
    record) and return the stored list of files ``path, n_records``.  Files
    get their names by rename when complete, so a repeated task is harmless."""
    fields = ["page_id", "url", "payload", "sha1", "name", "number", "refers_name"]

    def write(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        part, done, sink, count = TaskContext.get().partitionId(), [], None, 0

        def finish():
            sink.close()
            name = f"part-{part:06d}-{len(done):05d}.warc.gz"
            fs.move(draft, posixpath.join(base, name))
            done.append((posixpath.join(folder, name), count))

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in fields), strict=True):
                for rec in records_of(*row, segment_bytes, chunk_bytes):
                    if sink is not None and sink.tell() >= file_bytes:
                        finish()
                        sink = None
                    if sink is None:
                        draft = posixpath.join(base, f".draft-{part}-{uuid.uuid4().hex}")
                        sink, count = fs.open_output_stream(draft), 0
                    sink.write(gzip.compress(rec, 1, mtime=0))
                    count += 1
        if sink is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], names=["path", "n_records"])

    return stored_table(records.select(fields).mapInArrow(write, "path string, n_records long"), "archives")


RECORD = ("record_id string, type string, page_id long, refers_record string, digest string, "
          "segment int, origin string, total long, block binary")


def _parse(stream):
    """Headers (lower-case names) and block of each record of one archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().strip()):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head["content-length"]))


def read_records(spark: SparkSession, paths: list[str], segmented: bool) -> DataFrame:
    """Raw records of the archives: the segments of segmented records, or all
    other records.  ``paths`` is one entry per file."""

    def read(batches):
        number = lambda v: None if v is None else int(v)
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for h, block in _parse(f):
                        if ("warc-segment-number" in h) != segmented:
                            continue
                        rows.append((h["warc-record-id"], h["warc-type"], number(h.get("x-page-id")),
                                     h.get("warc-refers-to"), h.get("warc-payload-digest"),
                                     number(h.get("warc-segment-number")),
                                     h.get("warc-segment-origin-id", h["warc-record-id"]),
                                     number(h.get("warc-segment-total-length")), block))
                        held += len(block)
                        if held > 8 << 20:
                            yield _raw(rows)
                            rows, held = [], 0
                if rows:
                    yield _raw(rows)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(read, RECORD)


_RAW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()),
                  ("refers_record", pa.string()), ("digest", pa.string()), ("segment", pa.int32()),
                  ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary())])


def _raw(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RAW, strict=True)],
                                      schema=_RAW)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records from segments: grouped by origin, ordered by number.  The
    block is null where a number is missing or the total length differs."""
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    # one distinct row per segment: an archive read twice gives the same record
    whole = segments.dropDuplicates(["origin", "segment"]).groupBy("origin").agg(
        parts.alias("parts"), F.max("total").alias("total"), F.max("page_id").alias("page_id"),
        F.max("digest").alias("digest"))
    whole = whole.withColumn("joined", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"])))
    good = (F.element_at("parts", -1)["segment"] == F.size("parts")) & (F.octet_length("joined") == F.col("total"))
    return whole.select(F.col("origin").alias("record_id"), F.lit("response").alias("type"), "page_id",
                        F.lit(None).cast("string").alias("refers_record"), "digest",
                        F.when(good, F.col("joined")).alias("block"))


def payloads(records: DataFrame) -> DataFrame:
    """``record_id, type, page_id, refers_record, payload, payload_bytes,
    payload_digest, valid``: the decoded payload of each response, with its
    own digest; ``valid`` is false where the block is incomplete, badly framed
    or does not match its recorded digest."""

    def decode(batches):
        for b in batches:
            rows = []
            for kind, digest, block in zip(*(b.column(c).to_pylist() for c in ("type", "digest", "block")), strict=True):
                payload = None
                if kind == "response" and block is not None:
                    try:
                        payload = payload_of(block)
                    except ValueError:
                        payload = None
                own = None if payload is None else sha1_base32(payload)
                rows.append((payload, None if payload is None else len(payload), own,
                             kind == "revisit" or (own is not None and digest in (None, "sha1:" + own))))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("record_id", "type", "page_id", "refers_record")]
                + [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.bool_()), strict=True)],
                names=["record_id", "type", "page_id", "refers_record", "payload", "payload_bytes",
                       "payload_digest", "valid"])

    return records.select("record_id", "type", "page_id", "refers_record", "digest", "block").mapInArrow(
        decode, "record_id string, type string, page_id long, refers_record string, payload binary, "
                "payload_bytes long, payload_digest string, valid boolean")


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of the archives with their payloads (see ``payloads``)."""
    names = ["record_id", "type", "page_id", "refers_record", "digest", "block"]
    single = read_records(spark, paths, segmented=False).select(names)
    joined = reassemble(read_records(spark, paths, segmented=True)).select(names)
    return payloads(single.unionByName(joined))


def resolve(read: DataFrame) -> DataFrame:
    """Per record ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``; a revisit takes bytes and digest from the response that it
    refers to (null when the archives do not hold it).  ``refers_to`` is null
    for a record without a page id, as in the SQL."""
    slim = stored_table(read.select("record_id", "type", "page_id", "refers_record", "payload_bytes",
                                    "payload_digest"), "records")
    target = slim.filter("type = 'response'").select(
        F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    return slim.join(target, "refers_record", "left").select(
        "page_id", F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("payload_digest", "d").alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(F.col("page_id").isNotNull(), F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, b, octet_length(b) AS n, min(page_id) OVER (PARTITION BY b) AS first_id,
             CAST(CAST(unhex(sha1(b)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
           + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
           + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
