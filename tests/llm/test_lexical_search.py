"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np

from statsmith.llm import lexical_search
from statsmith.llm.lexical_search import Queries, Shard

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for name, text in set(items):
        found = []
        for i, c in held:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    m = 100 - 50 + (50 * n * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        out += [(name, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def key(rows):
    return sorted(tuple((x is None, x) for x in r) for r in rows)


def make(n_docs, n_items, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)] + ["the", "THE", "é", "Élan", "a_b", "日本", "x1"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[7][1]) for i in range(80)]                          # ties
    items = [(i, text(r.randint(1, 12))) for i in range(n_items)]
    return docs, items


def test_terms():
    for text in ["", "A_b c-d1 ÀÉ é x y日 !", "ABC abc9\x00z\x7fq"]:
        assert [t.decode() for t in lexical_search.terms_of(text.encode())] == terms(text)


def test_blocks_bound_every_document():
    r = np.random.default_rng(3)
    names = [b"t%d" % i for i in range(120)]
    q = Queries([[names[j] for j in r.choice(120, 9, replace=False)] for _ in range(15)] + [[names[0], b"absent"]])
    inside = len(q.vocab)
    cells = np.unique(r.integers(0, 300 * inside, 6000))
    row, term = cells // inside, cells % inside
    impact = r.integers(1, 1000, len(cells))
    shard = Shard(q, row, term, impact, 300)
    for t, (blocks, top) in shard.blocks.items():
        assert sorted(np.concatenate(blocks).tolist()) == sorted(row[term == t].tolist())
        at = q.coordinates[t] if q.coordinates[t] is not None else np.arange(inside)
        for rows, summary in zip(blocks, top, strict=True):
            assert (summary == shard.impact[rows][:, at].max(axis=0)).all()
    read = 0
    for i, item in enumerate(q.items):
        scores = shard.impact[:, item].sum(axis=1)
        want = np.lexsort((np.arange(300), -scores))[:5]
        want = want[scores[want] > 0]
        rows, found, blocks = shard.top(i, 5, 0)
        assert rows.tolist() == want.tolist() and found.tolist() == scores[want].tolist()
        read += blocks
        floor = int(scores[want[2]]) if len(want) > 2 else 1
        rows, found, _ = shard.top(i, 5, floor)
        assert rows.tolist() == [x for x in want.tolist() if scores[x] >= floor]
    assert read < sum(len(shard.blocks[t][0]) for item in q.items for t in item.tolist() if t in shard.blocks)


def test_search_against_brute_force(spark, monkeypatch):
    docs, items = make(900, 25, 1)
    docs += [(None, docs[3][1]), (5, docs[4][1]), (5, docs[5][1]), (2000, None), (2001, ""), (2002, "the " * 50_000)]
    items += [(0, items[0][1]), (0, items[1][1]), (90, None), (91, "!!"), (92, "nowhere"), (None, "the é")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, item int").repartition(7)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, rank int")
    want = key(brute_force(docs, items))
    assert key(map(tuple, lexical_search.search(d, q).collect())) == want
    monkeypatch.setattr(lexical_search, "PASS_TERMS", 40)                 # several passes, tiny shards
    monkeypatch.setattr(lexical_search, "SHARD_CELLS", 1)
    assert key(map(tuple, lexical_search.search(d, q).collect())) == want
    assert key(map(tuple, lexical_search.search(d, q, k=3).collect())) == key(brute_force(docs, items, 3))


def test_empty_tables(spark):
    docs, items = make(20, 3, 2)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        got = lexical_search.search(a, b)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
