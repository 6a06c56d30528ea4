"""Token ids of whole texts with a public tokenizer file, as little-endian
unsigned 32-bit bytes.

White space always separates the tokens of a word-level vocabulary, so each
distinct chunk between white space is encoded once and remembered, and the
chunks' ids in order are the text's ids.  A new chunk of letters with plain
punctuation behind it is looked up as its lower-cased letters and its
punctuation, each encoded by the library's own model; every other chunk goes
through the library's full encoder.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from itertools import islice

# ASCII white space only: other blanks stay inside a chunk, for the tokenizer
_CHUNK = re.compile(r"[^ \t\n\v\f\r]+")
# letters whose lower case is one letter, unchanged by composition
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-;=?-@\[-`{}~]*)")
CACHE_CHUNKS = 250_000                # distinct chunks a Python worker remembers
CACHE_LENGTH = 64                     # longer chunks are encoded afresh


def chunks(text: str) -> list[str]:
    """Runs without ASCII white space (str.split, which is faster, also cuts
    at other blanks; they separate tokens too, except for four controls)."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _CHUNK.findall(text)
    return text.split()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """``__call__`` maps a list of texts to a list of id byte strings.

    Only for tokenizers that lower-case, drop white space and split letters
    from punctuation (checked against whole texts in the tests)."""

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(tokenizer_file)
        self.model = self.tok.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # a chunk that is a lower-case word, or punctuation, has the ids of that part of any other chunk
        self.known: dict[str, bytes] = {"": b""}

    def keep(self, c: str, ids: bytes) -> None:
        """Remember a chunk; when no more may be, the newer half is forgotten
        (frequent chunks come early, so the older half is asked for more)."""
        if len(c) > CACHE_LENGTH:
            return
        if len(self.known) >= CACHE_CHUNKS:
            for old in list(islice(reversed(self.known), CACHE_CHUNKS // 2)):
                del self.known[old]
        self.known[c] = ids

    def part(self, w: str) -> bytes:
        """Ids of a chunk's lower-cased letters, or of its punctuation."""
        ids = self.known.get(w)
        if ids is None:
            form = w if w.isascii() else self.to_bytes(w)[0][0]
            ids = _packed([t.id for t in self.model.tokenize(form)])
            self.keep(w, ids)
        return ids

    def chunk(self, c: str) -> bytes:
        m = _SIMPLE.fullmatch(c)
        if m:
            return self.part(m[1].lower()) + self.part(m[2])
        return _packed(self.tok.encode(c, add_special_tokens=False).ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        out = []
        for t in texts:
            parts = chunks(t)
            try:
                out.append(b"".join([known[c] for c in parts]))
            except KeyError:
                ids = []
                for c in parts:
                    i = known.get(c)
                    if i is None:
                        i = self.chunk(c)
                        self.keep(c, i)
                    ids.append(i)
                out.append(b"".join(ids))
        return out


@functools.lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    """One encoder per Python worker, kept for the worker's later tasks."""
    return WordIds(tokenizer_file)


def steps(texts: list[str], max_rows: int = 1000, max_chars: int = 4_000_000):
    """(start, stop) slices holding a bounded number of rows and characters
    (a single longer text stands alone)."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= max_rows or chars + len(t) > max_chars):
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)
