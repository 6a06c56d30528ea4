"""Phrases against counting every one of them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statsmith.llm import collocations
from statsmith.llm.common import small_batches


def brute_force(rows, top, min_count):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    out = []
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    gone = set()
    for (lang, p), a in cands.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and 100 * a >= 100 * cands[lang, p[i:j]]:
                    gone.add((lang, p[i:j]))
    for lang in n:
        found = []
        for (x, p), a in cands.items():
            if x == lang and (x, p) not in gone:
                score, _, le, r = min((1000 * a * n[lang] // (f[x, p[:k]] * f[x, p[k:]]), k, f[x, p[:k]], f[x, p[k:]])
                                      for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), le, r))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, rows=400):
    r = random.Random(seed)
    words = ["the", "The", "of", "ÉLAN", "a\x1cb", "x", "日本", *[f"w{i}" for i in range(60)]]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["new york city hall", "w50 w51 w52 w53 w54 w55", "of the x of the x of the x", "los\t\tangeles"]
    out = []
    for _ in range(rows):
        parts = [r.choice(fixed) if r.random() < 0.3 else " ".join(r.choices(words, weights, k=r.randint(1, 9))) for _ in range(6)]
        out.append((r.choice(["en", "en", "fr", None]), r.choice([". ", "\n", " ", " ,; ", "\x0b"]).join(parts)))
    return [*out, ("en", None), ("fr", ""), ("xx", "only once"), *out[:30]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 7, "?") for i, (x, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, n int, word string").repartition(5)


@pytest.mark.parametrize(("top", "min_count"), [(2000, 20), (5, 12)])
def test_phrases_against_brute_force(spark, top, min_count):
    rows = corpus(1)
    got = collocations.mine(frame(spark, rows), top=top, min_count=min_count)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, top, min_count)


def test_pruning_leaves_frequent_words_and_keeps_ties(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARES", (0.02, 0.1, 1.0))
    monkeypatch.setattr(collocations, "CHUNK", 7)                # several passes a step
    monkeypatch.setattr(collocations, "ROW_CODES", 50)
    rows = corpus(2)
    rows += [("en", ". ".join(f"rare{i} pair{i}" for i in range(12)))] * 12           # 12 phrases of one score
    report = []
    got = collocations.mine(frame(spark, rows), top=5, min_count=12, report=report)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 5, 12)
    everything = []
    collocations.mine(frame(spark, rows), top=2000, min_count=12, report=everything)
    assert sum(r[2] for r in report) < sum(r[2] for r in everything)        # words below the bound were never expanded


def test_windows():
    r = np.random.default_rng(1)
    code = r.integers(0, 4, 500)
    for length, prefix in ((2, 1), (3, 2), (4, 4), (3, 0)):
        have = Counter()
        ends = {}
        c = [0, *code.tolist(), 0]
        for i in range(1, len(c) - length):
            w = tuple(c[i:i + length])
            if 0 not in w and (not prefix or w[:prefix] in {(1, 2, 3, 1)[:prefix], (2, 2, 2, 2)[:prefix]}):
                have[w] += 1
                ends.setdefault(w, []).append((c[i - 1], c[i + length]))
        wanted = [np.array(x, np.int64) for x in zip((1, 2, 3, 1), (2, 2, 2, 2), strict=True)]
        wanted = np.sort(collocations.mixed([np.array([1, 2], np.int64), *[np.array(x, np.int64) for x in ((2, 2), (3, 2), (1, 2))]][:prefix])) if prefix else None
        found = collocations.window_counts(code.astype(np.int64), length, prefix, wanted)
        words, n, e = found
        got = {tuple(int(w[j]) for w in words): (int(n[j]), *[int(x[j]) for x in e]) for j in range(len(n))}
        assert got == {w: (k, min(x for x, _ in ends[w]), max(x for x, _ in ends[w]), min(y for _, y in ends[w]),
                           max(y for _, y in ends[w])) for w, k in have.items()}


def test_no_rows(spark):
    none = frame(spark, [("en", "a b")]).limit(0)
    assert collocations.mine(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.mine(none).count() == 0
    assert collocations.mine(frame(spark, [(None, None), ("en", ""), ("en", "a b c d")])).count() == 0


def test_a_shared_hash_raises(spark, monkeypatch):
    monkeypatch.setattr(collocations, "word_code", lambda w: len(w))
    with pytest.raises(ValueError, match="share"):
        collocations.mine(frame(spark, [("en", "aa bb " * 30)]), min_count=5)


def test_wide_rows_reach_workers_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 18).alias("wide"))
    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(n) for n in names]
    with small_batches(spark, "4m", 256):
        assert spark.conf.get(names[1]) == "256"
        assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) <= 17
    assert [spark.conf.get(n) for n in names] == before
    with pytest.raises(ZeroDivisionError), small_batches(spark, "4m", 256):
        raise ZeroDivisionError
    assert [spark.conf.get(n) for n in names] == before
