"""What a worker remembers of the chunks that it has encoded."""

import random
import tracemalloc

import numpy as np

from statsmith.llm import token_ids
from statsmith.llm.packing import pack
from statsmith.llm.queries import WORD_FILE


def _words(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("aehinorstuà") for _ in range(8)) + r.choice(["", "", ",", "."]) for _ in range(n)]


def test_forgotten_chunks_have_the_same_ids(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(token_ids, "CACHE_CHUNKS", 50)
    words = _words(40)
    words += [w.capitalize() for w in words] + ["...", "don't", "日x", "", "x" * 70]
    texts = [" ".join(random.Random(i).choices(words, k=60)) for i in range(100)]
    coder, want = token_ids.WordIds(WORD_FILE), Tokenizer.from_file(WORD_FILE).encode_batch(texts, add_special_tokens=False)
    for lo in range(0, 100, 10):
        assert coder(texts[lo:lo + 10]) == [np.array(e.ids, "<u4").tobytes() for e in want[lo:lo + 10]]
        assert len(coder.known) <= 50


def test_a_long_text_of_new_words_needs_bounded_memory(monkeypatch):
    """One text counts too: 60,000 new words, 20,000 remembered."""
    monkeypatch.setattr(token_ids, "CACHE_CHUNKS", 20_000)
    coder, words = token_ids.WordIds(WORD_FILE), _words(60_000)
    text = " ".join(words)
    tracemalloc.start()
    coder([text])
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 6e6, held


def test_pack_sends_texts_in_small_batches(spark, monkeypatch):
    """The session's own bounds hold again behind the job."""
    seen = []
    monkeypatch.setattr("statsmith.llm.packing.stored_table",
                        lambda df, what: seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or df)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    pack(docs, WORD_FILE)
    assert seen == ["4m"] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
