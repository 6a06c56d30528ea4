"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

A sequence of tokens is the encoding of its bytes exactly when every two
neighbours are compatible: played back in time, no merge joins a symbol on the
right edge of one with a symbol on the left edge of the other before both are
complete.  So a segment is encoded from left to right: an Aho-Corasick pass
over its reversed bytes finds the longest token that starts at every place;
that token is taken if it is compatible with the one before, else its longest
shorter prefix, and when none is left the last token is given back.  A prefix
of the bytes has one encoding only, so a place from which no way leads on is
never entered twice: the time is linear in the length.  Compatibility of each
pair of tokens that meets is worked out once and kept in a table.

Merges never cross the segments that the tokenizer's own splitting rule gives,
so every distinct segment is encoded once by a Python worker and remembered.
Decoding looks up each id's place in one buffer that holds the bytes of all
tokens.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.llm.common import id_text, quoted
from statsmith.llm.token_ids import steps

# fixed by the tokenizer's format: the rule that splits texts into segments
_SEGMENT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPACES = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s) ")        # a blank that follows no white space
CACHE_SEGMENTS = 500_000              # distinct segments, and chunks, a Python worker remembers
CACHE_LENGTH = 64                     # longer ones are encoded afresh
BLOCK = 1 << 20                       # characters of one text that are worked on together
BREAK = "Ā"                      # between segments; no byte has this code
NEVER = 1 << 40                       # rank of a merge that never comes


def byte_letters() -> dict[int, int]:
    """Code of the letter that stands for each byte in the vocabulary file:
    printable Latin-1 bytes stand for themselves, the others are numbered from
    256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(other)}


def check_spec(spec: dict) -> None:
    """Raises for a tokenizer file that does more than byte-level BPE."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = (spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space") and (spec["decoder"] or {}).get("type") == "ByteLevel"
             and model["type"] == "BPE" and not any(model.get(k) for k in (
                 "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("not a plain byte-level BPE tokenizer")


def blocks(text: str, size: int = BLOCK):
    """The text in blocks of about ``size`` characters, cut only before a blank
    that follows a character which is no white space: a segment starts there
    whatever stands around it."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


class ByteBpe:
    """Tokens, merges and tables of one tokenizer file."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        to_byte = {letter: b for b, letter in byte_letters().items()}
        vocab = {name.translate(to_byte): i for name, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.left, self.right, self.birth = [-1] * size, [-1] * size, [-1] * size
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            a, b = a.translate(to_byte), b.translate(to_byte)
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if self.birth[t] >= 0 or max(self.birth[x], self.birth[y]) >= r or len(a + b) < 2:
                raise ValueError(f"merge {r} comes before its parts or makes a token twice")
            self.left[t], self.right[t], self.birth[t] = x, y, r
            self.rank[x, y] = r
        names: list[bytes] = [b""] * size
        for name, i in vocab.items():
            names[i] = name.encode("latin-1")
        for name, i in self.special.items():
            names[i] = name.encode("utf-8")
        self.length = [len(b) for b in names]
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        # a token takes part if it is the encoding of its own bytes
        own = [len(name) == 1 or self.birth[i] >= 0 and self.compatible(self.left[i], self.right[i], self.birth[i])
               for name, i in vocab.items()]
        parts = {name: i for (name, i), o in zip(vocab.items(), own, strict=True) if o}
        if any(chr(b) not in parts for b in range(256)):
            raise ValueError("the vocabulary needs all bytes")
        self.shorter = [-1] * size                # the longest token that is a proper prefix
        self.finder = ahocorasick.Automaton()
        for name, i in parts.items():
            self.shorter[i] = next((parts[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in parts), -1)
            self.finder.add_word(name[::-1], i)
        self.finder.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def compatible(self, a: int, b: int, below: int = NEVER) -> bool:
        """Whether no merge of rank under ``below`` joins a symbol at the right
        edge of ``a`` with one at the left edge of ``b``.  The walk goes back
        in time, undoing the later of the two symbols' own merges."""
        until_a = until_b = NEVER                 # when the symbol is used up on its own side
        while True:
            r = self.rank.get((a, b), NEVER)
            if r < until_a and r <= until_b and r < below:      # of equal ranks the left one comes first
                return False
            if self.birth[a] > self.birth[b]:
                until_a, a = self.birth[a], self.right[a]
            elif self.birth[b] >= 0:
                until_b, b = self.birth[b], self.left[b]
            else:
                return True

    def longest_tokens(self, joined: str) -> list[int]:
        """The longest token that starts at each place of bytes given as
        Latin-1 characters (-1 at a ``BREAK``)."""
        n = len(joined)
        out = [-1] * n
        for end, token in self.finder.iter(joined[::-1]):       # the longest of an end comes first
            if out[n - 1 - end] < 0:
                out[n - 1 - end] = token
        return out

    def encode_bytes(self, longest: list[int]) -> list[int]:
        """Ids of one segment, given the longest token at each of its bytes."""
        n = len(longest)
        token = longest[0]
        if self.length[token] == n:
            return [token]
        closed = bytearray(n + 1)                 # places from which no way leads on
        out: list[int] = []
        at = 0
        while True:
            end = at + self.length[token]
            fits = not closed[end]
            if fits and out:
                pair = out[-1], token
                fits = self.pairs.get(pair)
                if fits is None:
                    fits = self.pairs[pair] = self.compatible(*pair)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                closed[at] = 1
                token = out.pop()
                at -= self.length[token]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        out, i = [], 0
        while i < len(segments):
            part, total = [], 0
            while i < len(segments) and (not part or total < BLOCK):
                part.append(segments[i].encode("utf-8").decode("latin-1"))
                total += len(part[-1])
                i += 1
            longest = self.longest_tokens(BREAK.join(part))
            at = 0
            for p in part:
                out.append(self.encode_bytes(longest[at:at + len(p)]))
                at += len(p) + 1
        return out

    def decode(self, ids) -> str:
        """Text of a whole id list; bytes that are no UTF-8 become U+FFFD."""
        return self.bytes_of(ids).decode("utf-8", "replace")

    def bytes_of(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        first, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.bytes[place].tobytes()


class BatchCoder:
    """Encodes whole texts, remembering segments and chunks across batches.

    A chunk is what stands between two blanks that each follow a character
    which is no white space.  A segment starts at such a blank whatever stands
    around it, so a chunk's ids, its blank in front included, are the same in
    every text."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        self.bpe = ByteBpe(tokenizer_file)
        self.split = Tokenizer.from_file(tokenizer_file).pre_tokenizer.pre_tokenize_str
        self.segment_ids: dict[str, list[int]] = {}
        self.ids: dict[str, bytes] = {}           # chunk -> ids, unsigned 32-bit little-endian
        self.decimal: dict[str, str] = {}
        self.digits = list(map(str, range(len(self.bpe.length))))
        self.agreed: set[str] = set()             # letters on whose kind this module and the library agree
        self.odd: set[str] = set()                # and those newer than one of the two

    def library_segments(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.split(text)]

    def meet_letters(self, texts: list[str]) -> None:
        new = set().union(*[t for t in texts if not t.isascii()]) - self.agreed - self.odd
        for c in new:
            probe = f"a{c}1{c} {c}!"
            (self.agreed if _SEGMENT.findall(probe) == self.library_segments(probe) else self.odd).add(c)

    def segments(self, text: str) -> list[str]:
        """Segments in order; strings of special tokens are segments too."""
        find = self.library_segments if self.odd and not self.odd.isdisjoint(text) else _SEGMENT.findall
        if not any(s in text for s in self.bpe.special):
            return find(text)
        out, at = [], 0
        for m in self.bpe.split_special.finditer(text):
            out += [*find(text[at:m.start()]), m[0]]
            at = m.end()
        return out + find(text[at:])

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """Segments of the first chunk, and the other chunks without the blank
        in front; a text with special tokens or odd letters is one chunk."""
        if any(s in text for s in self.bpe.special) or self.odd and not self.odd.isdisjoint(text):
            return self.segments(text), []
        first, *rest = _CUT.split(text) if _SPACES.search(text) else text.split(" ")
        return _SEGMENT.findall(first), rest

    def learn(self, fresh: list[list[str]]) -> None:
        known, special = self.segment_ids, self.bpe.special
        new = list(set().union(*fresh).difference(known))
        known.update(zip(new, self.bpe.encode_segments(new), strict=True))
        self.long = [s for s in new if len(s) > CACHE_LENGTH]
        known.update((s, [i]) for s, i in special.items() if s in known)

    def join(self, segments: list[str]) -> tuple[bytes, str]:
        ids = [i for s in segments for i in self.segment_ids[s]]
        return np.array(ids, "<u4").tobytes(), ",".join([self.digits[i] for i in ids])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as bytes, ids as decimal text) of each text or block."""
        if len(self.ids) > CACHE_SEGMENTS:
            self.ids.clear()
            self.decimal.clear()
        if len(self.segment_ids) > CACHE_SEGMENTS:
            self.segment_ids.clear()
        self.meet_letters(texts)
        parts = [self.cut(t) for t in texts]
        fresh = list(set().union(*[rest for _, rest in parts]).difference(self.ids))
        inside = [_SEGMENT.findall(" " + c) for c in fresh]
        self.learn([*[first for first, _ in parts], *inside])
        for c, found in zip(fresh, inside, strict=True):
            self.ids[c], self.decimal[c] = self.join(found)
        ids, decimal = self.ids, self.decimal
        out = []
        for first, rest in parts:
            raw, text = self.join(first)
            out.append((b"".join([raw, *[ids[c] for c in rest]]),
                        ",".join([*[text][:len(raw)], *[decimal[c] for c in rest]])))
        for c in fresh:
            if len(c) > CACHE_LENGTH:
                del ids[c], decimal[c]
        for s in self.long:
            del self.segment_ids[s]
        return out

    def blocks(self, text: str):
        """(ids as bytes, decimal text) of the text's blocks.  A special token
        that holds blanks could be cut, so then the text stays whole."""
        whole = any(" " in s for s in self.bpe.special)
        for part in [text] if whole or len(text) <= BLOCK else blocks(text):
            yield from self.encode([part])


@functools.lru_cache(maxsize=2)
def batch_coder(tokenizer_file: str) -> BatchCoder:
    """One coder per Python worker, kept for the worker's later tasks."""
    return BatchCoder(tokenizer_file)


def _each(coder: BatchCoder, texts: list[str]):
    """The encoded blocks of each text, many short texts at a time."""
    if all(len(t) <= BLOCK for t in texts):
        return [[x] for x in coder.encode(texts)]
    return (coder.blocks(t) for t in texts)


def encode(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every input row's whole text.

    Null and empty texts have no ids; repeated rows give repeated rows, an
    empty table an empty result.  ``tokenizer_file`` must be readable on every
    executor under the same path."""
    docs = id_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = batch_coder(tokenizer_file)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in steps(texts):
                rows = [np.frombuffer(b"".join([x[0] for x in t]), "<u4").astype(np.int32)
                        for t in _each(coder, texts[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of every input row's ids, special tokens included.

    Null ids give empty text, a null among the ids is left out, ids outside
    the vocabulary raise."""
    rows = df.select(quoted(id_col).alias("doc_id"),
                     F.coalesce(F.array_compact(quoted(ids_col)), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = batch_coder(tokenizer_file).bpe
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [bpe.decode(v.values.to_numpy()) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every input row:
    SHA-256 of the ids as decimal numbers joined by commas, and of the text
    that the ids decode to, in one pass.  Nulls, repeated rows and empty
    tables as for ``encode``; a very long text is worked through in blocks."""
    docs = id_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(bpe, parts):
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
        for raw, decimal in parts:
            if n and raw:
                ids_sha.update(b",")
            ids_sha.update(decimal.encode())
            # blocks and segments hold whole characters, so their bytes are UTF-8
            text_sha.update(bpe.bytes_of(np.frombuffer(raw, "<u4")))
            n += len(raw) // 4
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    def run(batches):
        coder = batch_coder(tokenizer_file)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in steps(texts):
                rows = [digest(coder.bpe, t) for t in _each(coder, texts[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
