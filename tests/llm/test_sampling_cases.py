"""Sampling with repeated and null ids; repeated rows of the suffix dedup."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from statsmith.llm import importance, suffix_dedup


def test_exactly_k_rows_stay(spark):
    rows = [(i if i < 100 else None, "the same text") for i in range(3100)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = importance.resample(docs, labels, share=0.5).collect()
    assert len(got) == 3100 and sum(r["kept"] for r in got) == 1550
    assert len({r["sample_key"] for r in got}) == 3100
    one = spark.createDataFrame([(7, t) for t in ["a b"] * 3000 + ["c d"] * 100], "doc_id long, text string")
    assert importance.resample(one, labels, share=0.3).filter("kept").count() == 930


def test_weights_keys_and_choice_against_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(["good words here", "good words", "bad stuff", "", None, "good bad", "bad stuff stuff"] * 6)]
    labels = [(i, int("bad" not in (t or "bad")), 0) for i, t in docs[:20]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in importance.resample(d, lab, share=0.5).collect()}
    good = {i for i, q, _ in labels if q}
    raw, target, grams = Counter(), Counter(), {}
    for i, t in docs:
        _, slot = importance.ngram_slots([t or ""])
        grams[i] = slot.tolist()
        raw.update(grams[i])
        target.update(grams[i] if i in good else [])
    rt, rr = sum(target.values()) + importance.SLOTS, sum(raw.values()) + importance.SLOTS
    for i, g in grams.items():
        want = sum(math.log((target[s] + 1) / rt / ((raw[s] + 1) / rr)) for s in g)
        assert abs(got[i]["log_weight"] - want) < 1e-9 and got[i]["n_grams"] == len(g)
    order = sorted((i for i in got if got[i]["n_grams"]), key=lambda i: -got[i]["sample_key"])
    k = min(len(order), round(0.5 * len(docs)))
    assert {i for i in got if got[i]["kept"]} == set(order[:k])


def test_repeated_rows_once(spark):
    rows = [(1, "x" * 80), (1, "x" * 80), (1, "y" * 80), (None, "z"), (None, "z"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df, texts=True).count() == 7
    got = suffix_dedup.remove_repeats(df, texts=True, distinct=True).collect()
    assert sorted((r["doc_id"] or 0, r["kept_text"][:1]) for r in got) == [(0, "z"), (1, "x"), (1, "y"), (2, "")]


def test_carried_columns_stay_with_their_text(spark):
    passage = "a passage of more than fifty bytes that two documents hold, word for word"
    rows = [(None, passage, None, "a b"), (3, "first " + passage + " end", "fr", None), (3, "another text of id 3", "en", "w"),
            (9, passage, "de", "only a repeat"), (4, None, "en", "w"), (5, "", None, "w"), (6, "short", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, `text` string, lang string, `source.of` string")
    for piece in (4 << 20, 20):
        got = suffix_dedup.remove_repeats(df, texts=True, slice_bytes=piece, carry=["source.of", "doc_id", "lang"]).collect()
        assert sorted(((r["carried_1"], r["kept_text"], r["carried_2"], r["carried_0"]) for r in got), key=str) == sorted(
            [(None, passage, None, "a b"), (3, "first  end", "fr", None), (3, "another text of id 3", "en", "w"),
             (9, "", "de", "only a repeat"), (4, "", "en", "w"), (5, "", None, "w"), (6, "short", "en", None)], key=str)
        assert all(r["carried_1"] == r["doc_id"] for r in got)


def test_pipeline_shuffles_each_text_once(spark):
    """The passages stage: no join behind the operator, rows as before."""
    import corpus_pipeline
    passage = "a passage of more than fifty bytes that two documents hold, word for word"
    rows = [(1, passage, "en", "s", 9), (2, "x " + passage, "fr", None, 9), (2, "x " + passage, "fr", None, 9),
            (2, "other", "de", "t", 9), (None, "no id", None, "u", 9), (7, passage, "en", "v", 9), (8, None, "en", "v", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    cut = corpus_pipeline.passages(spark, docs, "")
    assert cut.schema.names == docs.schema.names and cut.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(
        [(1, passage, "en", "s", len(passage)), (2, "x ", "fr", None, 2), (2, "other", "de", "t", 5), (None, "no id", None, "u", 5)],
        key=str)
    assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_anchor_marks_are_bits():
    """An anchor costs four bytes on the way to its hash range and two bits back."""
    rng = np.random.default_rng(2)
    texts = ["".join(t) for t in rng.choice(list("abcdefgh "), size=(40, 3000))]
    texts[20:30] = texts[:10]                                # in another slice
    slices = [suffix_dedup.Slice(pa.table({"doc_id": range(i, i + 20), "text": texts[i:i + 20]}), 50) for i in (0, 20)]
    bits, sent = 3, []
    for n, s in enumerate(slices):
        h, several = s.anchor_hashes()
        edge, short = suffix_dedup._edges(h, bits), suffix_dedup._short(h, bits)
        assert edge[0] == 0 and edge[-1] == len(h) and short.nbytes == 4 * len(h)
        sent += [(j, n, short[i:e].tobytes(), several[i:e].tobytes()) for j, (i, e) in enumerate(zip(edge, edge[1:], strict=False))]
    both = np.intersect1d(slices[0].anchor_hashes()[0], slices[1].anchor_hashes()[0])
    assert len(both) > 1000
    for most, often in ((1, True), (10 ** 6, False)):
        back = pa.concat_tables([suffix_dedup.find_shared(suffix_dedup._rows(suffix_dedup._ANCHORS, [r for r in sent if r[0] == j]), most)
                                 for j in range(1 << bits)])
        for n, s in enumerate(slices):
            mine = back.filter(pa.array([x == n for x in back["slice"].to_pylist()]))
            got, many = s.marked(mine, bits)
            assert got.tolist() == both.tolist() and many.tolist() == [often] * len(both)
            assert sum(len(x) for c in ("a", "b") for x in mine[c].to_pylist()) <= 2 * (len(s.anchor_hashes()[0]) // 8 + (1 << bits))
    # two anchors whose 32 bits agree are both looked at, in a slice and beyond it
    one = suffix_dedup._rows(suffix_dedup._ANCHORS, [(0, 0, np.array([5, 5, 9], np.uint32).tobytes(), bytes(3)),
                                                     (0, 1, np.array([8, 9], np.uint32).tobytes(), bytes(2))])
    found = suffix_dedup.find_shared(one, 10)
    assert [(r["slice"], list(suffix_dedup._unpacked(r["a"], n))) for r, n in zip(found.to_pylist(), (3, 2), strict=True)] == \
        [(0, [True, True, True]), (1, [False, True])]


def test_suffix_dedup_works_in_little_memory():
    """A slice of 3 MB and a bucket of 20,000 items: what one task allocates."""
    rng = np.random.default_rng(1)
    texts = ["".join(t) for t in rng.choice(list("abcdefgh "), size=(100, 30_000))]
    s = suffix_dedup.Slice(pa.table({"doc_id": range(100), "text": texts}), 50)
    tracemalloc.start()
    s.anchor_hashes()
    anchors = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n, side = 20_000, 80
    text = rng.integers(97, 105, (n, side)).astype(np.uint8)
    text[n // 2:] = text[:n // 2]
    row = (0, 0, np.arange(n, dtype=np.uint32).tobytes(), text.tobytes(),
           np.tile(np.array([0, 30], np.uint8), n).tobytes(), np.arange(n).tobytes())
    table = suffix_dedup._rows(suffix_dedup._ITEMS, [row])
    tracemalloc.start()
    found = suffix_dedup.compare_bucket(table, 50)
    compared = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.frombuffer(found["a"][0].as_py(), np.uint32).tolist() == list(range(n // 2, n))
    assert anchors < 60e6 and compared < 40e6, (anchors, compared)
