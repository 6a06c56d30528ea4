"""Removal of byte strings that an earlier document already holds, with a
distributed sparse suffix array.

A 50-byte window always holds the same anchor, the leftmost ``K`` bytes of
smallest hash in it, wherever the window occurs, so suffixes are needed at
anchors only.  The job:

1. Documents are dealt into slices by a hash of their id.  Each slice sends
   the hashes of its anchors (32 bits behind those that name the range) to the
   range of the hash, and gets back a bit for each; anchors that only one
   document holds are left out from here on.
2. Of the other anchors, each slice sends the text of all windows around the
   anchor (equal ones of a slice once, with their smallest id) to buckets
   range-partitioned by the leading bytes of the anchored suffix, with
   splitters taken from a sample.  All splitters are anchor prefixes, so the
   suffixes on both sides of a bucket boundary differ within the anchor and no
   window can have an equal one beyond it.  Of an anchor that occurs more than
   ``ANCHOR_ROWS`` times, each slice sends the distinct windows instead, each
   to a bucket by a hash of all its bytes; a bucket then holds a window at
   most once a slice.
3. A bucket sorts its windows by multikey quicksort (8 bytes at a time, equal
   runs by the next 8 bytes) and compares neighbours: a run of equal windows
   has the smallest id of its documents.
4. The windows found in an earlier document go back to their slice, which
   removes the bytes that they cover.

Documents, flags and windows only travel by shuffle; the driver holds the
splitters, one per bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from statsmith.llm.common import id_text, quoted

K = 20                                # bytes of an anchor
CHUNK = 1 << 19                       # bytes of text worked on at a time (some 50 bytes of memory each)
SLICE = 4 << 20                       # bytes of text of a slice, on average
LEAD = 16                             # bytes of a suffix that splitters compare
ANCHOR_ROWS = 50_000                  # occurrences of an anchor that one bucket compares in place
SAMPLE = 100                          # one document in so many gives splitters
WINDOWS = -1                          # marks what a bucket sends back, beside the numbers of the hash ranges
U = np.uint64


def kgram_hash(b: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``K`` bytes from each position (K = 16 + 4)."""
    h = (b.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    four = None
    for step, mult in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (4, 0xD6E8FEB86659FD93),
                       (8, 0xFF51AFD7ED558CCD)):
        h = h[:-step] * U(mult) + h[step:]
        h ^= h >> U(29)
        if step == 2:
            four = h
    n = len(b) - K + 1
    h = h[:n] * U(0xC4CEB9FE1A85EC53) + four[16:16 + n]
    h ^= h >> U(32)
    h *= U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    return h


def anchors(b: np.ndarray, lengths: np.ndarray, width: int):
    """Anchors of the windows of ``width`` bytes that lie within a document.

    Returns, per anchor, its position, its hash and the first and last start
    of the windows that it is the anchor of (starts run without a gap)."""
    n = len(b)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none.astype(U), none, none
    h = kgram_hash(b)
    # smallest (32 bits of the hash, position): the leftmost smallest hash
    v = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    span, have, low = width - K + 1, 1, v
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[:len(v) - span + 1], low[span - have:len(v) - span + 1 + span - have])
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(lengths)
    ok = np.zeros(n + 1, np.int32)
    long = lengths >= width
    np.add.at(ok, (ends - lengths)[long], 1)
    np.add.at(ok, (ends - width + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(ok[:len(at)]) > 0)
    if not len(start):
        return none, none.astype(U), none, none
    at = at[start]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    pos = at[first]
    return pos, h[pos], start[first], start[last]


def multikey_sort(words: np.ndarray):
    """Order of rows of big-endian words and, in that order, the number of the
    run of equal rows that each belongs to.  Sorts by the first word; rows
    that are equal so far are sorted on by the next one."""
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    col = words[order, 0]
    new = np.r_[True, col[1:] != col[:-1]][:n]
    for w in range(1, width):
        run = np.cumsum(new) - 1
        tied = np.flatnonzero((np.bincount(run) > 1)[run])
        if not len(tied):
            break
        sub = order[tied]
        again = np.lexsort((words[sub, w], run[tied]))
        order[tied] = sub = sub[again]
        col = words[sub, w]
        new[tied[1:]] |= (col[1:] != col[:-1])
    return order, np.cumsum(new) - 1


def _words(rows: np.ndarray) -> np.ndarray:
    """Byte rows as big-endian 8-byte words (zero bytes behind the end)."""
    n, w = rows.shape
    full = np.zeros((n, -(-w // 8) * 8), np.uint8)
    full[:, :w] = rows
    return full.view(">u8").astype(U)


class Slice:
    """The documents of one slice, in id order."""

    def __init__(self, table: pa.Table, width: int):
        self.width, self.left, self.side = width, width - K, 2 * width - K
        rows = sorted(zip(table.column("doc_id").to_pylist(),
                          (t.encode() for t in table.column("text").to_pylist()), range(table.num_rows), strict=True),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        # a null id comes before all others
        self.ids = [r[0] for r in rows]
        self.rank = np.array([np.iinfo(np.int64).min if i is None else i for i in self.ids], np.int64)
        self.texts = [r[1] for r in rows]
        self.rows = [r[2] for r in rows]                         # where each was in the table
        self._anchors = {}

    def chunks(self):
        """(first document, bytes, lengths) of runs of whole documents."""
        at = 0
        while at < len(self.texts):
            end, size = at, 0
            while end < len(self.texts) and (end == at or size + len(self.texts[end]) <= CHUNK):
                size += len(self.texts[end])
                end += 1
            yield at, np.frombuffer(b"".join(self.texts[at:end]), np.uint8), \
                np.array([len(t) for t in self.texts[at:end]], np.int64)
            at = end

    def anchored(self):
        """The chunks, each with its anchors; these are found once."""
        for at, b, lengths in self.chunks():
            if at not in self._anchors:
                self._anchors[at] = anchors(b, lengths, self.width)
            yield at, b, lengths, *self._anchors[at]

    def anchor_hashes(self):
        """Distinct anchor hashes, and a byte of each: whether two ids of the
        slice have it, and twice the power of two that its occurrences reach at
        most."""
        hashes, docs = [], []
        for at, _, lengths, pos, h, _, _ in self.anchored():
            hashes.append(h)
            docs.append(self.rank[at + np.searchsorted(np.cumsum(lengths), pos, "right")])
        h, d = np.concatenate(hashes or [np.zeros(0, U)]), np.concatenate(docs or [np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][:len(h)])
        if not len(new):
            return h, np.zeros(0, np.uint8)
        several = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)
        return h[new], (several + 2 * np.ceil(np.log2(np.diff(np.r_[new, len(h)])))).astype(np.uint8)

    def marked(self, table: pa.Table, bits: int):
        """The anchor hashes that ``find_shared`` has marked, and whether they
        occur often."""
        h, _ = self.anchor_hashes()
        edge = _edges(h, bits)
        hit, often = np.zeros(len(h), bool), np.zeros(len(h), bool)
        for part, *marks in zip(*(table.column(c).to_pylist() for c in ("part", "a", "b")), strict=True):
            if part != WINDOWS:
                i, e = edge[part], edge[part + 1]
                hit[i:e], often[i:e] = (_unpacked(m, e - i) for m in marks)
        return h[hit], often[hit]

    def items(self, shared: np.ndarray, often: np.ndarray):
        """Windows around the shared anchors: ``text`` (n, side) with the
        anchor at column ``left``, zero outside the windows; offsets ``lo`` and
        ``hi`` of the first and last window start; document number; start;
        whether the anchor is one of those that occur ``often``."""
        out = []
        for at, b, lengths, pos, h, first, last in self.anchored():
            if len(shared):
                near = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
                hit = shared[near] == h
            else:
                near, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            many = often[near[hit]] if len(shared) else np.zeros(0, bool)
            pos, first, last = pos[hit], first[hit], last[hit]
            lo, hi = self.left + first - pos, self.left + last - pos
            span = np.arange(self.side)
            src = (pos - self.left)[:, None] + span
            inside = (span >= lo[:, None]) & (span < (hi + self.width)[:, None])
            text = np.where(inside, b[np.clip(src, 0, max(0, len(b) - 1))], 0).astype(np.uint8) if len(pos) else \
                np.zeros((0, self.side), np.uint8)
            doc = at + np.searchsorted(np.cumsum(lengths), pos, "right")
            own = np.cumsum(lengths) - lengths
            out.append((text, lo.astype(np.uint8), hi.astype(np.uint8), doc, first - own[doc - at], many))
        if not out:
            return (np.zeros((0, self.side), np.uint8), *(np.zeros(0, np.int64),) * 4, np.zeros(0, bool))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def distinct(self, text, lo, hi, doc):
        """Number of each item's group of equal items; per group one member
        and the smallest id."""
        n = len(doc)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.concatenate([text, lo[:, None], hi[:, None]], axis=1).astype(np.uint8)
        order, run = multikey_sort(_words(key))
        group = np.empty(n, np.int64)
        group[order] = run
        start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        return group, order[start], np.minimum.reduceat(self.rank[doc[order]], start)

    def windows(self, text, lo, hi, least, many):
        """The windows of the groups (one member each, with the smallest id)
        whose anchor occurs often: group, offset and number of each window;
        bytes, offset and smallest id of each distinct one."""
        g = np.flatnonzero(many)
        count = hi[g].astype(np.int64) - lo[g] + 1
        owner = np.repeat(np.arange(len(g)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + lo[g].astype(np.int64)[owner]
        if not len(g):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros((0, self.width), np.uint8), none, none
        view = np.lib.stride_tricks.sliding_window_view(text[g], self.width, axis=1)[owner, offset]
        order, run = multikey_sort(_words(np.concatenate([view, offset[:, None].astype(np.uint8)], axis=1)))
        number = np.empty(len(owner), np.int64)
        number[order] = run
        start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        one = order[start]
        return g[owner], offset, number, view[one], offset[one], np.minimum.reduceat(least[g[owner[order]]], start)

    def sent(self, shared, often, cuts, pieces: int):
        """What the slice sends: bucket, item number, ``text``, ``lo``, ``hi``
        and smallest id of each row.  Windows are numbered behind the groups
        and go to ``pieces`` buckets behind those of the splitters."""
        text, lo, hi, doc, _, many = self.items(shared, often)
        _, one, least = self.distinct(text, lo, hi, doc)
        text, lo, hi, many = text[one], lo[one], hi[one], many[one]
        lead = np.ascontiguousarray(text[:, self.left:self.left + LEAD]).view(f"S{LEAD}").ravel()
        bucket = np.searchsorted(cuts, lead, "right")
        _, _, _, view, offset, early = self.windows(text, lo, hi, least, many)
        alone = np.zeros((len(view), self.side), np.uint8)
        alone[np.arange(len(view))[:, None], offset[:, None] + np.arange(self.width)] = view
        h = offset.astype(U)
        for word in _words(view).T:
            h = (h ^ word) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        deal = len(cuts) + 1 + (h % U(pieces)).astype(np.int64)
        item = np.r_[np.flatnonzero(~many), len(one) + np.arange(len(view))]
        return (np.r_[bucket[~many], deal], item, np.concatenate([text[~many], alone]),
                np.r_[lo[~many], offset].astype(np.uint8), np.r_[hi[~many], offset].astype(np.uint8),
                np.r_[least[~many], early])


def _concat(kind, blobs):
    return np.concatenate([np.frombuffer(x, kind) for x in blobs]) if blobs else np.zeros(0, kind)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary())])
# part: a hash range, with two bits (a, b) for each hash of the slice in it; or WINDOWS, with items and a mask for each
_SHARED = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_ITEMS = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("item", pa.binary()), ("text", pa.binary()),
                    ("span", pa.binary()), ("first_id", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _edges(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the ``2 ** bits`` ranges starts and ends in sorted hashes."""
    return np.searchsorted((h >> U(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of each hash behind those that name its range.  Two anchors
    that agree in them count as one here; their texts are compared later."""
    return (h >> U(32 - bits)).astype(np.uint32)


def _packed(flags: np.ndarray) -> bytes:
    """Eight flags a byte; nothing if none is set."""
    return np.packbits(flags).tobytes() if flags.any() else b""


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool) if blob else np.zeros(n, bool)


def find_shared(table, most: int):
    """Of one hash range: per slice a bit for each of its hashes, whether two
    documents hold it, and one whether it occurs more than ``most`` times."""
    parts = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    h = np.concatenate(parts)
    mark = _concat(np.uint8, table.column("several").to_pylist())
    several, counts = mark & 1, np.int64(1) << (mark >> 1).astype(np.int64)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    run = np.cumsum(np.r_[True, hs[1:] != hs[:-1]][:len(hs)]) - 1
    hit = (np.bincount(run) > 1) | (np.bincount(run, weights=several[order]) > 0)
    flag, often = np.empty(len(h), bool), np.empty(len(h), bool)
    flag[order] = hit[run]
    often[order] = (np.bincount(run, weights=counts[order]) > most)[run]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return _rows(_SHARED, [(s, part, _packed(f), _packed(f & o)) for s, part, f, o in zip(
        table.column("slice").to_pylist(), table.column("bucket").to_pylist(), np.split(flag, cuts), np.split(often, cuts),
        strict=True) if f.any()])


def compare_bucket(table, width: int):
    """Of one range of suffixes: per slice and item a bit for each window start
    offset whose window a document with a smaller id holds."""
    side = 2 * width - K
    sizes = [len(x) // 4 for x in table.column("item").to_pylist()]
    text = _concat(np.uint8, table.column("text").to_pylist()).reshape(-1, side)
    span = _concat(np.uint8, table.column("span").to_pylist()).reshape(-1, 2).astype(np.int64)
    first = _concat(np.int64, table.column("first_id").to_pylist())
    # equal items of several slices: one, with the smallest id
    order, run = multikey_sort(_words(np.concatenate([text, span.astype(np.uint8)], axis=1)))
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][:len(run)])
    group = np.empty(len(first), np.int64)
    group[order] = run
    one, least = order[start], np.minimum.reduceat(first[order], start)
    lo, hi = span[one, 0], span[one, 1]
    low = np.full((len(one), width - K + 1), np.iinfo(np.int64).max)
    # equal windows have the same anchor at the same place: one offset of the window start at a time
    for offset in range(width - K + 1):
        has = np.flatnonzero((lo <= offset) & (offset <= hi))
        if not len(has):
            continue
        order, run = multikey_sort(_words(text[one[has], offset:offset + width]))
        start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        smallest = np.empty(len(has), np.int64)
        smallest[order] = np.minimum.reduceat(least[has[order]], start)[run]
        low[has, offset] = smallest
    out, at = [], 0
    for s, idx, n in zip(table.column("slice").to_pylist(), table.column("item").to_pylist(), sizes, strict=True):
        bits = low[group[at:at + n]] < first[at:at + n, None]
        some = bits.any(axis=1)
        if some.any():
            out.append((s, WINDOWS, np.frombuffer(idx, np.uint32)[some].tobytes(), np.packbits(bits[some], axis=1).tobytes()))
        at += n
    return _rows(_SHARED, out)


def remove_repeats(df: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   texts: bool = False, distinct: bool = False, slice_bytes: int = SLICE,
                   anchor_rows: int = ANCHOR_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row (with ``distinct``: per different id and text):
    ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` and, with ``texts``, ``kept_text`` (without the bytes of a
    character that was cut apart) and ``input_sha256``.  The input's columns
    named in ``carry`` come along as ``carried_0, carried_1, ...`` (with
    ``distinct``: those of one of the equal rows), so that no join has to
    shuffle the texts again.

    Removes each byte covered by a string of ``width`` bytes that starts in a
    document with a smaller id too; overlaps count, matches never cross
    documents.  Null and empty texts have no bytes.  Rows that share an id are
    one document here: they do not remove from one another.  A null id is
    smaller than any other.  ``width`` is from 28 to 100.  ``slice_bytes`` of
    text make a slice; a task holds one slice or one bucket at a time.  The
    windows of an anchor with more than ``anchor_rows`` occurrences are dealt
    over many buckets.  An empty table gives an empty result.
    """
    if not 28 <= width <= 100:
        raise ValueError("width must be from 28 to 100")
    docs = id_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    taken = [f"carried_{i}" for i in range(len(carry))]
    whole = df.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"),
                      *(quoted(c).alias(t) for c, t in zip(carry, taken, strict=True)))
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    pieces = size // slice_bytes + 1                             # slices, hash ranges and buckets
    bits = max(1, (pieces - 1).bit_length())
    sliced = whole.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)))

    def leads(batches):
        for b in batches:
            s = Slice(pa.Table.from_batches([b]), width)
            for _, x, lengths in s.chunks():
                pos = anchors(x, lengths, width)[0][::16]
                view = np.lib.stride_tricks.sliding_window_view(x, LEAD)[pos] if len(pos) else []
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in view], pa.binary())], names=["lead"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(SAMPLE)) == 0)
    found = sample.mapInArrow(leads, "lead binary")
    cuts = np.array(_splitters(found, pieces), f"S{LEAD}")

    def send_anchors(key, table):
        h, several = Slice(table, width).anchor_hashes()
        edge, short = _edges(h, bits), _short(h, bits)
        me = key[0].as_py()
        return _rows(_ANCHORS, [(j, me, short[i:e].tobytes(), several[i:e].tobytes())
                                for j, (i, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if e > i])

    def send_items(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _rows(_ITEMS, [])
        s = Slice(left, width)
        bucket, item, text, lo, hi, least = s.sent(*s.marked(right, bits), cuts, pieces)
        order = np.argsort(bucket, kind="stable")
        out, me = [], key[0].as_py()
        for j, i, e in _runs(bucket[order]):
            g = order[i:e]
            out.append((int(j), me, item[g].astype(np.uint32).tobytes(), text[g].tobytes(),
                        np.stack([lo[g], hi[g]], 1).tobytes(), least[g].tobytes()))
        return _rows(_ITEMS, out)

    result = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string())] + [("kept_text", pa.string()), ("input_sha256", pa.string())] * texts
    sparks = {pa.int64(): LongType(), pa.string(): StringType()}
    schema = StructType([StructField(n, sparks[t]) for n, t in result] + [
        StructField(t, whole.schema[t].dataType) for t in taken])

    def finish(key, left, right):
        s = Slice(left, width)
        total = np.cumsum([0] + [len(t) for t in s.texts])
        cover = np.zeros(total[-1] + 1, np.int32)
        shared, often = s.marked(right, bits) if right.num_rows else (np.zeros(0, U), np.zeros(0, bool))
        text, lo, hi, doc, start, many = s.items(shared, often)
        if len(doc):
            group, one, least = s.distinct(text, lo, hi, doc)
            owner, offset, number, view, _, lowest = s.windows(text[one], lo[one], hi[one], least, many[one])
            early = np.zeros((len(one) + len(view), width - K + 1), bool)
            for part, idx, mask in zip(*(right.column(c).to_pylist() for c in ("part", "a", "b")), strict=True):
                if part == WINDOWS:
                    idx = np.frombuffer(idx, np.uint32)
                    early[idx] = np.unpackbits(np.frombuffer(mask, np.uint8).reshape(len(idx), -1), axis=1,
                                               count=width - K + 1).astype(bool)
            # a window sent alone: another slice has it earlier, or another group of this one
            early[owner, offset] |= early[len(one) + number, offset] | (least[owner] > lowest[number])
            later = s.rank[doc] > least[group]                   # another document of the slice has it
            span = np.arange(width - K + 1)
            own = (span >= lo[:, None]) & (span <= hi[:, None])
            hits = own & (early[group] | later[:, None])
            for off in range(width - K + 1):
                hit = np.flatnonzero(hits[:, off])
                p = total[doc[hit]] + start[hit] + off - lo[hit].astype(np.int64)
                np.add.at(cover, p, 1)
                np.add.at(cover, p + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows, kept_rows, seen = [], [], set()
        for i, t in enumerate(s.texts):
            if distinct:                                         # rows of an id are in one slice
                if (same := (s.ids[i], hashlib.sha256(t).digest())) in seen:
                    continue
                seen.add(same)
            g = gone[total[i]:total[i + 1]]
            n = int(np.count_nonzero(g))
            kept = t if not n else np.frombuffer(t, np.uint8)[~g].tobytes()
            spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if n else 0
            kept_rows.append(s.rows[i])
            rows.append((s.ids[i], len(t), n, spans, hashlib.sha256(kept).hexdigest(),
                         *([kept.decode("utf-8", "ignore"), hashlib.sha256(t).hexdigest()] if texts else [])))
        out = _rows(pa.schema(result), rows)
        for t in taken:
            out = out.append_column(t, left.column(t).take(pa.array(kept_rows, pa.int64())))
        return out

    def share(table):
        return find_shared(table, anchor_rows)

    by_slice = sliced.groupBy("slice")
    hashes = by_slice.applyInArrow(send_anchors, _ddl(_ANCHORS))
    shared = hashes.groupBy("bucket").applyInArrow(share, _ddl(_SHARED))
    items = by_slice.cogroup(shared.groupBy("slice")).applyInArrow(send_items, _ddl(_ITEMS))

    def compare(table):
        return compare_bucket(table, width)

    early = items.groupBy("bucket").applyInArrow(compare, _ddl(_SHARED))
    back = shared.unionByName(early)
    return by_slice.cogroup(back.groupBy("slice")).applyInArrow(finish, schema)


def _runs(a: np.ndarray):
    """(value, start, stop) of runs of equal values."""
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][:len(a)])
    return zip(a[start], start, np.r_[start[1:], len(a)], strict=True)


def _splitters(leads: DataFrame, pieces: int) -> list[bytes]:
    """At most ``pieces - 1`` distinct cut points from the sampled leading
    bytes: a bounded random part of the sample reaches the driver."""
    some = leads.orderBy(F.xxhash64("lead", F.lit(1))).limit(64 * pieces).collect()
    lead = sorted(bytes(r["lead"]) for r in some)
    return sorted({lead[len(lead) * i // pieces] for i in range(1, pieces)}) if lead else []
