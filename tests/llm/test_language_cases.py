"""Letters, long words and long training texts of the language model."""

import numpy as np

from statsmith.llm import language_crf


def test_only_letters_make_words():
    assert language_crf.words_of("² ½ ²³ 12 _ !") == []
    assert language_crf.words_of("x²y a1B") == ["x", "y", "a", "b"]


def test_every_letter_of_a_long_word_is_read():
    word = "Donaudampfschifffahrtsgesellschaft"
    assert "".join(language_crf.words_of(word)) == word.lower()
    model = language_crf.fit([("aa", "tokoto kokoto totoko " * 40), ("bb", "lirili rilili liliri " * 40)], sequences=200)
    head, tail = "x" * 8, "y" * 8
    middle_a, middle_b = (model.predict([head + m * 6 + tail])[0] for m in ("tokoto", "lirili"))
    assert middle_a[0] == "aa" and middle_b[0] == "bb"


def test_texts_without_letters_are_undetermined(spark):
    model = language_crf.fit([("aa", "tokoto kokoto " * 40), ("bb", "lirili rilili " * 40)], sequences=200)
    rows = [(0, "²"), (1, "½ ²³"), (2, None), (3, ""), (4, "tokoto koko to")]
    got = {r["doc_id"]: r for r in language_crf.identify(
        spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and got[4]["lang_pred"] == "aa"
    wide = spark.createDataFrame([(i, t, "odd", 0.1) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    kept = language_crf.keep_identified(wide, model, 0.5)
    assert kept.schema == wide.schema and [r["doc_id"] for r in kept.collect()] == [4]
    assert language_crf.keep_identified(wide.limit(0), model, 0.5).count() == 0


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(i, "tokoto kokoto " * 30, "en") for i in range(40)] + [(100 + i, "lirili rilili " * 3000, "xx") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = language_crf.training_rows(df, 20, 1000, 10_000_000, "doc_id", "text", "lang")
    assert {k for k, _ in taken} == {"en", "xx"} and max(len(t) for _, t in taken) <= 1000
    few = language_crf.training_rows(df, 20, 1000, 8_000, "doc_id", "text", "lang")
    assert sum(len(t) for _, t in few) <= 16_000


def test_marginals_of_mixed_lengths():
    """One long text among short ones: against the sums over each text alone."""
    rng = np.random.default_rng(3)
    lengths = np.array([0, 3, 400, 1, 0, 7, 7, 2])
    score, moves = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    post, moved = language_crf.marginals(score, lengths, moves)
    alone, none = language_crf.marginals(score, lengths, moves, count_moves=False)
    assert none is None and np.array_equal(post, alone)
    step, want, total = np.exp(moves), [], np.zeros((3, 3))
    for s in np.split(np.exp(score), np.cumsum(lengths)[:-1]):
        if not len(s):
            continue
        f, b = [s[0] / s[0].sum()], [np.ones(3)]
        for x in s[1:]:
            f.append((f[-1] @ step) * x / ((f[-1] @ step) * x).sum())
        for x in s[:0:-1]:
            v = step @ (b[0] * x)
            b.insert(0, v / v.sum())
        p = np.array(f) * np.array(b)
        want.append(p / p.sum(axis=1, keepdims=True))
        for i in range(len(s) - 1):
            pair = np.outer(f[i], s[i + 1] * b[i + 1]) * step
            total += pair / pair.sum()
    assert np.allclose(post, np.concatenate(want)) and np.allclose(moved, total)
