"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by piece score
(high first, then leftmost), and merges until no pair is a piece; characters
outside the vocabulary fall back to byte pieces.  Since no piece of such a
vocabulary holds a space mark after another character, merges never cross the
start of a word, so a text is cut there and every distinct segment is encoded
once.  The agendas of many segments are worked off together: one row per
segment holds the score ranks of its pairs, and a step merges the best pair of
every row.  Long segments keep their agenda in a heap.  Every distinct segment
is also encoded and decoded by the sentencepiece library when it is first met,
and so are the whole texts of the first slice of every task; a difference
raises.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statsmith.llm.common import id_text
from statsmith.llm.token_ids import steps

MARK = "▁"                       # fixed by the format: the space mark
CACHE_SEGMENTS = 600_000              # distinct segments a Python worker remembers
CACHE_LENGTH = 48                     # longer segments go through the heap, afresh
NONE = np.int32(2**31 - 1)            # rank of a pair that is no piece


def _fields(b: bytes):
    """(number, value) of the fields of a serialised protocol buffer."""
    i = 0

    def number():
        nonlocal i
        v = shift = 0
        while True:
            c = b[i]
            i, v, shift = i + 1, v | (c & 127) << shift, shift + 7
            if c < 128:
                return v

    while i < len(b):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, b[i:i + n]
        i += n


def check_model(proto: bytes) -> None:
    """Raises for a model that changes texts other than by a leading blank, or
    that has user-defined pieces."""
    spec = {}
    for k, v in _fields(proto):
        if k == 1 and dict(_fields(v)).get(3, 1) == 4:
            raise ValueError(f"user-defined piece {dict(_fields(v))[1].decode()!r}")
        if k == 3:
            spec = dict(_fields(v))
    # rules, leading blank, removal of blanks, blanks as marks
    if spec.get(2) or spec.get(6) or (spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)) != (1, 0, 1):
        raise ValueError("the model's normaliser changes texts")


class MergeModel:
    """Pieces and scores of a BPE model file, with the two directions."""

    def __init__(self, model_file: str):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib, n = self.lib, self.lib.get_piece_size()
        check_model(lib.serialized_model_proto())
        self.piece, self.rank, self.byte_id, self.id_byte = [], {}, {}, {}
        self.control = set()
        for i in range(n):
            p = lib.id_to_piece(i)
            self.piece.append(p)
            if lib.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.id_byte[i] = int(p[3:5], 16)
            elif lib.is_control(i):
                self.control.add(i)
            elif not lib.is_unknown(i):
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} crosses a word start")
                self.rank[p] = (-lib.get_score(i), i)
        if len(self.byte_id) != 256:
            raise ValueError("the model needs byte fallback")
        self.eos = lib.eos_id()
        self._pair_table()

    def _pair_table(self) -> None:
        """Sorted keys (left id, right id) with the joined piece and its rank
        (equal scores share a rank)."""
        level = {s: r for r, s in enumerate(sorted({s for s, _ in self.rank.values()}))}
        rows = sorted((self.rank[p[:k]][1] * len(self.piece) + self.rank[p[k:]][1], i, level[s])
                      for p, (s, i) in self.rank.items() for k in range(1, len(p))
                      if p[:k] in self.rank and p[k:] in self.rank)
        self.pair_key = np.array([r[0] for r in rows] + [2**62], np.int64)
        self.pair_id = np.array([r[1] for r in rows] + [0], np.int32)
        self.pair_rank = np.array([r[2] for r in rows] + [NONE], np.int32)

    def _pairs(self, left, right):
        """(rank, joined id) of symbol pairs; negative symbols never join."""
        key = left.astype(np.int64) * len(self.piece) + right
        at = np.searchsorted(self.pair_key, key)
        hit = (self.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], NONE), self.pair_id[at]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments at once."""
        out: list = [None] * len(segments)
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            if len(s) > CACHE_LENGTH:
                out[k] = self.encode_segment(s)
            else:
                by_length.setdefault(max(2, (len(s) + 3) // 4 * 4), []).append(k)
        for width, rows in by_length.items():
            for i in range(0, len(rows), 20_000):
                part = rows[i:i + 20_000]
                for k, ids in zip(part, self._encode_rows([segments[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _encode_rows(self, segments: list[str], width: int) -> list[list[int]]:
        """Segments of at most ``width`` characters.  Symbols: an id, -1 for the
        blank end of a row, -2 - c for a character c outside the vocabulary."""
        n = len(segments)
        code = np.array(segments, dtype=f"<U{width}").view(np.uint32).reshape(n, width)
        lengths = np.fromiter(map(len, segments), np.int64, n)
        chars, back = np.unique(code, return_inverse=True)
        first = np.array([self.rank[chr(c)][1] if chr(c) in self.rank else -2 - int(c) for c in chars], np.int32)
        sym = first[back].reshape(n, width)
        cols = np.arange(width)
        sym[cols[None, :] >= lengths[:, None]] = -1
        done = sym.copy()
        where = np.arange(n)
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self._pairs(sym[:, :-1], sym[:, 1:])[0]
        while len(where):
            at = rank.argmin(axis=1)                  # best rank, leftmost
            rows = np.arange(len(where))
            open_ = rank[rows, at] != NONE
            if not open_.all():
                done[where[~open_]] = sym[~open_]
                where, sym, rank, at = where[open_], sym[open_], rank[open_], at[open_]
                rows = np.arange(len(where))
                if not len(where):
                    break
            joined = self._pairs(sym[rows, at], sym[rows, at + 1])[1]
            take = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            sym = np.take_along_axis(sym, take, 1)
            sym[:, -1] = -1
            sym[rows, at] = joined
            rank = np.take_along_axis(rank, take, 1)
            rank[:, -1] = NONE
            right = np.minimum(at + 1, width - 1)
            rank[rows, at] = np.where(at + 1 < width, self._pairs(joined, sym[rows, right])[0], NONE)
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self._pairs(sym[has, at[has] - 1], joined[has])[0]
        out = []
        for r in done.tolist():
            if -1 in r:
                r = r[:r.index(-1)]
            if min(r, default=0) < -1:
                r = [i for v in r for i in ([v] if v >= 0 else [self.byte_id[b] for b in chr(-2 - v).encode("utf-8")])]
            out.append(r)
        return out

    def encode_segment(self, text: str) -> list[int]:
        """Ids of one segment (space marks already in place)."""
        rank = self.rank
        if text in rank and len(text) == 1:
            return [rank[text][1]]
        sym = list(text)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            r = rank.get(sym[i] + sym[i + 1])
            if r is not None:
                agenda.append((r[0], i, sym[i] + sym[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            j = nxt[i] if sym[i] else n
            if j >= n or sym[i] + sym[j] != joined:
                continue                                  # one side was merged away
            sym[i], sym[j] = joined, ""
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                r = rank.get(joined + sym[nxt[i]])
                if r is not None:
                    heapq.heappush(agenda, (r[0], i, joined + sym[nxt[i]]))
            if prv[i] >= 0:
                r = rank.get(sym[prv[i]] + joined)
                if r is not None:
                    heapq.heappush(agenda, (r[0], prv[i], sym[prv[i]] + joined))
        out = []
        for s in sym:
            if s:
                r = rank.get(s)
                if r is not None:
                    out.append(r[1])
                else:
                    out.extend(self.byte_id[b] for b in s.encode("utf-8"))
        return out

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids inside a document (the leading blank is kept)."""
        out, run = [], bytearray()
        for i in ids:
            b = self.id_byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                out.append(self.piece[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """Text of a whole id list; the blank put before a text is dropped."""
        text = self.decode_part(ids)
        return text[1:] if text.startswith(" ") else text


# a segment: one run of space marks with the word behind it
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def segments_of(text: str) -> list[str]:
    """The text cut before each run of space marks.  A word behind a single
    mark is named by the word alone, any other segment by its marked form."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" in words:
        return [s[1:] if s[1:2] not in ("", MARK) else s
                for s in _SEGMENT.findall(MARK + text.replace(" ", MARK))]
    return words


class BatchCoder:
    """Encodes and decodes whole texts, remembering segments across batches."""

    def __init__(self, model: MergeModel):
        self.model = model
        self.ids: dict[str, str] = {}             # segment -> ids as decimal text
        self.text: dict[str, str] = {}            # segment -> decoded text
        self.digits = list(map(str, range(len(model.piece))))
        self.plain = [p.replace(MARK, " ") for p in model.piece]

    def learn(self, fresh: list[str], verify: bool) -> None:
        """Ids and text of new segments, compared with the library's."""
        m, digits, plain = self.model, self.digits, self.plain
        last_byte = max(m.id_byte)
        marked = [s if s[0] == MARK else MARK + s for s in fresh]
        for s, ids in zip(fresh, m.encode_segments(marked), strict=True):
            self.ids[s] = " ".join([digits[i] for i in ids])
            self.text[s] = "".join([plain[i] for i in ids]) if min(ids) > last_byte else m.decode_part(ids)
        if not verify or not fresh:
            return
        # the library puts a mark in front itself, but not before an empty text: a mark alone is compared behind a word
        theirs = m.lib.encode([s[1:].replace(MARK, " ") for s in marked], num_threads=1)
        backs = m.lib.decode(theirs)
        if MARK in fresh:
            one = fresh.index(MARK)
            theirs[one], backs[one] = m.lib.encode("a ")[len(m.lib.encode("a")):], m.lib.decode(m.lib.encode("a "))[2:]
        for s, ids, back in zip(fresh, theirs, backs, strict=True):
            if self.ids[s] != " ".join([digits[i] for i in ids]) or self.text[s] != " " + back:
                raise ValueError(f"ids or text differ from the library's for {s[:80]!r}")

    def __call__(self, texts: list[str], verify: bool = True, whole: bool = False) -> list[tuple[int, str, str]]:
        """(number of ids with the end id, ids as decimal text, decoded text).
        ``verify`` compares new segments with the library, ``whole`` the texts
        as they are joined from segments."""
        parts = [segments_of(t) for t in texts]
        if len(self.ids) > CACHE_SEGMENTS:
            self.ids.clear()
            self.text.clear()
        fresh = set().union(*parts).difference(self.ids)
        self.learn(list(fresh), verify)
        ids_of, text_of, eos = self.ids, self.text, str(self.model.eos)
        out = []
        for p in parts:
            ids = " ".join([ids_of[s] for s in p] + [eos])
            text = "".join([text_of[s] for s in p])
            out.append((ids.count(" ") + 1, ids, text[1:] if text[:1] == " " else text))
        for s in fresh:
            if len(s) > CACHE_LENGTH:
                del ids_of[s], text_of[s]
        if whole:
            lib = self.model.lib
            theirs = lib.encode(texts, add_eos=True, num_threads=1)
            for t, o, ids, back in zip(texts, out, theirs, lib.decode(theirs), strict=True):
                if o[1] != " ".join(map(str, ids)) or o[2] != back:
                    raise ValueError(f"ids or text differ from the library's for {t[:80]!r}")
        return out


@functools.lru_cache(maxsize=2)
def batch_coder(model_file: str) -> BatchCoder:
    """One coder per Python worker, kept for the worker's later tasks."""
    return BatchCoder(MergeModel(model_file))


def encode_decode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                  verify_every: int = 1, digests: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids (decimal text), decoded``.

    With ``digests`` the two long columns are returned as their SHA-256 only
    (``ids_sha256``, ``decoded_sha256``).  Null and empty text give the end id
    alone and decode to empty text.  Repeated rows give repeated rows, an empty
    table an empty result.  The new segments of every ``verify_every``-th slice
    are compared with the library (1: of all slices; 0: of none).
    ``model_file`` must be readable on every executor under the same path.
    """
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches):
        coder = batch_coder(model_file)
        slices = 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in steps(texts):
                verify = verify_every > 0 and slices % verify_every == 0
                rows = coder(texts[lo:hi], verify=verify, whole=verify and slices == 0)
                slices += 1
                cols = [[r[1] for r in rows], [r[2] for r in rows]]
                if digests:
                    cols = [[hashlib.sha256(x.encode()).hexdigest() for x in c] for c in cols]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())],
                    names=["doc_id", "n_tokens", *names])

    docs = id_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, {names[0]} string, {names[1]} string")
