"""The backtracking encoder against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statsmith.llm import byte_bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.batch_coder(FILE)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(FILE)


def agree(coder, tok, texts):
    want = tok.encode_batch(texts, add_special_tokens=False)
    for t, w, (raw, decimal) in zip(texts, want, coder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == w.ids, t
        assert decimal == ",".join(map(str, w.ids))
        assert coder.bpe.decode(w.ids) == tok.decode(w.ids, skip_special_tokens=False)


def test_random_texts(coder, tok):
    r = random.Random(3)
    alphabet = " \n\tabcdeést'llreve<|>é日本😀0129!!.. \x85\x1c　́aaaaa"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * n for n in range(1, 120)] + ["ab" * 60, " " * 40, "\r\n\r\n x", "x  \n y", "it's we'll 'd'"]
    texts += ["<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endof", "<|endoftext|>  <|endoftext|>"]
    # letters newer than one of the two Unicode tables
    odd = ["՘", "֋", "࢏", "౜", "₏", "꟎", " ", "a", "1", "é"]
    texts += ["".join(r.choice(odd) for _ in range(20)) for _ in range(300)]
    # tokens side by side: many places where the longest token has to be given back
    texts += ["".join(coder.bpe.decode([r.randrange(50256)]) for _ in range(20)) for _ in range(1500)]
    agree(coder, tok, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(text):
    agree(byte_bpe.batch_coder(FILE), Tokenizer.from_file(FILE) if not hasattr(test_any_text, "tok") else test_any_text.tok, [text])


test_any_text.tok = Tokenizer.from_file(FILE)


def test_neighbours_are_compatible_exactly_when_they_stay(coder, tok):
    """The table against merging the two tokens' bytes anew."""
    r = random.Random(4)
    bpe = coder.bpe
    for _ in range(3000):
        a, b = r.randrange(50256), r.randrange(50256)
        both = bpe.bytes_of([a, b]).decode("latin-1")
        letters = byte_bpe.byte_letters()
        got = [t.id for t in tok.model.tokenize("".join(chr(letters[ord(c)]) for c in both))]
        assert bpe.compatible(a, b) == (got == [a, b])


def test_longest_tokens(coder):
    r = random.Random(5)
    names = {coder.bpe.bytes_of([i]): i for i in range(50256)}
    for _ in range(50):
        raw = "".join(r.choice("theraniosg ABé") for _ in range(60)).encode()
        want = [names[max((raw[i:j] for j in range(i + 1, len(raw) + 1) if raw[i:j] in names), key=len)] for i in range(len(raw))]
        assert coder.bpe.longest_tokens(raw.decode("latin-1")) == want


def test_long_texts_in_blocks(coder, tok):
    text = "abcé 12's \n  the " * 150_000 + "x" * 30_000 + "   y"
    assert len(list(byte_bpe.blocks(text))) > 1 and "".join(byte_bpe.blocks(text, 1000)) == text
    got = [i for raw, _ in coder.blocks(text) for i in np.frombuffer(raw, "<u4").tolist()]
    assert got == tok.encode(text, add_special_tokens=False).ids
    assert list(byte_bpe.blocks("x" * 5000, 100)) == ["x" * 5000]


def test_rows(spark, tok):
    texts = [None, "", "The cat's <|endoftext|> 日本\n\n x", "The cat's <|endoftext|> 日本\n\n x", "a " * 700_000]
    df = spark.createDataFrame([(i % 3, t, -1, "?") for i, t in enumerate(texts)],
                               "doc_id long, text string, n_tokens int, ids string")
    ids = byte_bpe.encode(df, FILE)
    assert sorted(len(r["ids"]) for r in ids.collect()) == sorted(
        len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts)
    back = byte_bpe.decode(ids, FILE)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for t in texts)
    got = byte_bpe.round_trip_digests(df, FILE)
    want = []
    for i, t in enumerate(texts):
        x = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i % 3, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert byte_bpe.round_trip_digests(df.limit(0), FILE).count() == 0
    gaps = spark.createDataFrame([(1, None), (2, [464, None, 50256])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode(gaps, FILE).collect()} == {1: "", 2: "The<|endoftext|>"}


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(FILE, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": {**spec["model"], "dropout": 0.1}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps({**spec, **change}), encoding="utf-8")
        with pytest.raises(ValueError):
            byte_bpe.ByteBpe(str(path))
