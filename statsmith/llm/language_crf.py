"""Language identification with a linear-chain conditional random field.

Every word of a text gets a label, so text that switches languages is
described word by word.  A word's features are hashed character n-grams with
marks at its edges (those that touch an edge are its affixes) and the lexicon
of a language that holds it; learned transitions tie neighbouring words.
Forward-backward gives each word's posterior, and a document's language is the
one with the largest mean posterior.

The model is fitted on a bounded sample of labelled rows (``per_language`` rows
of each language, a piece of at most ``max_chars`` characters of each,
``total_chars`` characters in all); word sequences joined from pieces of
several languages teach it where text switches.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.llm.common import quoted
from statsmith.llm.token_ids import steps

_WORD = re.compile(r"[^\W\d_]+")      # runs of letters and of number characters such as the superscript two
SLOTS = 1 << 16                       # hashed feature slots
GRAMS = (2, 3, 4)
WIDTH = 16                            # characters of a word that features look at
CACHE_WORDS = 400_000
SLICE = 1_000_000                     # characters whose words are worked on together
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; runs longer than ``WIDTH`` are cut into
    successive pieces of it, so every letter is read."""
    found = _WORD.findall(text.lower())
    if "".join(found).isalpha() and max(map(len, found)) <= WIDTH:
        return found
    out = []
    for w in found:
        if len(w) <= WIDTH and w.isalpha():
            out.append(w)
            continue
        for run in [w] if w.isalpha() else "".join([c if c.isalpha() else " " for c in w]).split():
            out.extend(run[i:i + WIDTH] for i in range(0, len(run), WIDTH))
    return out


def features(words: list[str]) -> np.ndarray:
    """Feature slots (words, features); slot 0 is none.  Words have at most
    ``WIDTH`` characters."""
    code = np.array([f"<{w}>" for w in words], f"<U{WIDTH + 2}").view(np.uint32).reshape(len(words), WIDTH + 2)
    code = code.astype(np.uint64)
    out = []
    for n in GRAMS:
        h = np.full((len(words), WIDTH + 3 - n), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[:, k:k + WIDTH + 3 - n]
            h ^= h >> np.uint64(29)
        slot = (h % np.uint64(SLOTS - 1)).astype(np.int64) + 1
        out.append(np.where(code[:, n - 1:] == 0, 0, slot))
    return np.concatenate(out, axis=1)


class LanguageModel:
    """Labels, feature weights, lexicon (word -> label number) and transitions."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.weights = np.zeros((SLOTS, n), np.float32)
        self.lexicon: dict[str, int] = {}
        self.lexicon_weight = np.zeros(n, np.float32)
        self.moves = np.zeros((n, n), np.float32)
        self._known: dict[str, int] = {}
        self._table = np.zeros((0, n), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-score of each label for each word."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for i in range(0, len(words), 20_000):
            part = words[i:i + 20_000]
            f = features(part)
            got = self.weights[f].sum(axis=1) / np.sqrt(np.maximum(1, (f > 0).sum(axis=1)))[:, None]
            lex = np.array([self.lexicon.get(w, -1) for w in part])
            has = np.flatnonzero(lex >= 0)
            got[has, lex[has]] += self.lexicon_weight[lex[has]]
            out[i:i + len(part)] = got
        return out

    def _rows(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, and the table of label scores by number."""
        if len(self._known) > CACHE_WORDS:
            self._known, self._table = {}, self._table[:0]
        fresh = sorted(set().union(*words).difference(self._known)) if words else []
        if fresh:
            self._known.update(zip(fresh, range(len(self._known), len(self._known) + len(fresh)), strict=True))
            self._table = np.concatenate([self._table, self.scores(fresh)])
        flat = np.fromiter(map(self._known.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        return flat, self._table

    def posteriors(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each label for each word, texts one after another, and
        the texts' first positions."""
        flat, table = self._rows(words)
        n = np.array([len(w) for w in words], np.int64)
        return marginals(table[flat], n, self.moves, count_moves=False)[0], np.cumsum(n) - n

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(label, mean posterior) of each text; texts without letters are
        undetermined with score 0."""
        words = [words_of(t) for t in texts]
        post, start = self.posteriors(words)
        n = np.array([len(w) for w in words], np.int64)
        total = np.zeros((len(texts), len(self.labels)))
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(post.astype(np.float64), start[some], axis=0) / n[some, None]
        best = total.argmax(axis=1)
        return [(self.labels[b], float(min(1.0, t[b]))) if k else (UNDETERMINED, 0.0)
                for b, t, k in zip(best, total, n, strict=True)]


def marginals(score: np.ndarray, lengths: np.ndarray, moves: np.ndarray, count_moves: bool = True):
    """Forward-backward over many sequences at once: posterior of each label
    at each position, and the expected number of each move (with
    ``count_moves``, else None).  Sequences are stepped through together,
    longest first; the positions of a step lie next to each other, so a step
    that only a few long sequences reach costs little."""
    labels = score.shape[1]
    emit = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
    step = np.exp(moves - moves.max())
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest + 1), "right")
    edge = np.r_[0, np.cumsum(active)].tolist()           # first position of each step
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    t = np.arange(len(score)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.asarray(edge, np.int64)[t] + np.repeat(rank, lengths)
    del t
    laid = np.empty_like(emit)
    laid[at] = emit
    total = np.add.reduce
    fore = np.empty_like(laid)
    state = None
    for t in range(longest):
        here = laid[edge[t]:edge[t + 1]]
        state = here.copy() if t == 0 else (state[:len(here)] @ step) * here
        state /= total(state, axis=1, keepdims=True)
        fore[edge[t]:edge[t + 1]] = state
    rest = np.ones_like(laid)
    moved = np.zeros((labels, labels)) if count_moves else None
    back, turned = np.ones((0, labels), emit.dtype), step.T
    for t in range(longest - 1, -1, -1):
        new = rest[edge[t]:edge[t + 1]]
        if k := len(back):
            ahead = back * laid[edge[t + 1]:edge[t + 1] + k]
            ahead /= total(ahead, axis=1, keepdims=True)
            new[:k] = ahead @ turned
            if count_moves:
                f = fore[edge[t]:edge[t] + k]
                weight = 1 / np.maximum((f * new[:k]).sum(axis=1, keepdims=True), 1e-30)
                moved += ((f * weight).T @ ahead) * step
            new /= total(new, axis=1, keepdims=True)
        back = new
    fore *= rest
    fore /= total(fore, axis=1, keepdims=True)
    return fore[at], moved


def training_rows(df: DataFrame, per_language: int, max_chars: int, total_chars: int, id_col: str, text_col: str,
                  lang_col: str):
    """A bounded number of labelled rows (language, text), chosen by the hash
    of id and text; of a text over ``max_chars`` a piece that starts at a place
    given by the hash.  Many languages share ``total_chars``: fewer rows each."""
    rows = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("draw", F.xxhash64("id", "text"))
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return []
    per_language = max(1, min(per_language, total_chars // (2 * max_chars * len(found))))
    share = F.create_map(*[x for k, n in found.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    some = rows.filter(F.pmod("draw", F.lit(1_000_000)) / 1_000_000 < share[F.col("lang")])
    spare = F.greatest(F.length("text") - max_chars, F.lit(0)) + 1
    piece = F.substring("text", (1 + F.pmod("draw", spare)).cast("int"), F.lit(max_chars))
    some = some.select("lang", piece.alias("text"), "draw").orderBy("draw", "lang").limit(2 * per_language * len(found))
    return [(r["lang"], r["text"]) for r in some.select("lang", "text").collect()]


def fit(rows: list[tuple[str, str]], sequences: int = 3000, words: int = 48, rounds: int = 40,
        rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> LanguageModel:
    """Fit by AdaGrad on the exact gradient of the log-likelihood."""
    by: dict[str, list[list[str]]] = {}
    for lang, text in sorted(rows):
        w = words_of(text)
        if w:
            by.setdefault(lang, []).append(w)
    model = LanguageModel(sorted(by))
    n = len(model.labels)
    if n < 1:
        return model
    counts: dict[str, np.ndarray] = {}
    for k, lang in enumerate(model.labels):
        for doc in by[lang]:
            for w in doc:
                counts.setdefault(w, np.zeros(n))[k] += 1
    share = sum(counts.values())
    for w, c in counts.items():
        rel = c / np.maximum(share, 1)
        if c.sum() >= 5 and rel.max() >= 0.8 * rel.sum():
            model.lexicon[w] = int(rel.argmax())
    rng = np.random.default_rng(seed)
    vocab = {w: i for i, w in enumerate(counts)}
    word_at, label_at = [], []
    for _ in range(sequences):
        seq, lab = [], []
        single = rng.random() < 0.5                       # half of the sequences do not switch
        lang = int(rng.integers(n))
        while len(seq) < words:
            lang = lang if single else int(rng.integers(n))
            docs = by[model.labels[lang]]
            doc = docs[int(rng.integers(len(docs)))]
            size = int(rng.integers(3, 20))
            at = int(rng.integers(max(1, len(doc) - size + 1)))
            piece = doc[at:at + size]
            seq += [vocab[w] for w in piece]
            lab += [lang] * len(piece)
        word_at.append(seq[:words])
        label_at.append(lab[:words])
    at, gold = np.array(word_at), np.array(label_at)
    names = list(vocab)
    slots = features(names)
    scale = 1 / np.sqrt(np.maximum(1, (slots > 0).sum(axis=1)))
    lex = np.array([model.lexicon.get(w, -1) for w in names])
    lengths = np.full(sequences, words)
    gold_moves = np.zeros((n, n))
    np.add.at(gold_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    hot = np.eye(n)[gold.ravel()]
    sums = [np.full(x.shape, 1e-8) for x in (model.weights, model.lexicon_weight, model.moves)]
    for _ in range(rounds):
        score = model.scores(names)
        post, moves = marginals(score[at.ravel()].astype(np.float64), lengths, model.moves.astype(np.float64))
        by_word = np.zeros((len(names), n))
        np.add.at(by_word, at.ravel(), hot - post)
        grad_w = np.stack([np.bincount(slots.ravel(), (by_word[:, k] * scale).repeat(slots.shape[1]), SLOTS)
                           for k in range(n)], axis=1)
        grad_w[0] = 0
        has = lex >= 0
        grad_l = np.bincount(lex[has], by_word[has, lex[has]], n)
        for x, g, s in ((model.weights, grad_w, sums[0]), (model.lexicon_weight, grad_l, sums[1]),
                        (model.moves, gold_moves - moves, sums[2])):
            g = g / sequences - decay * x
            s += g * g
            x += (rate * g / np.sqrt(s)).astype(np.float32)
    return model


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score`` (mean posterior of
    the label, 0 to 1).

    Null text, and text without letters, is ``und`` with score 0, as is every
    text under a model without labels.  Repeated rows give repeated rows, an
    empty table an empty result.
    """
    docs = df.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(model)           # SLOTS x languages weights: bounded

    def run(batches):
        m = held.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in steps(texts, 10_000, SLICE):
                got = m.predict(texts[lo:hi]) if m.labels else [(UNDETERMINED, 0.0)] * (hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: LanguageModel, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose text has letters and a
    language with a mean posterior of at least ``min_score``.

    Rows are filtered where they are read: no shuffle, no join.  Rows with null
    text go; of repeated rows all stay or all go; an empty table, or a model
    without labels, gives an empty result.
    """
    held = df.sparkSession.sparkContext.broadcast(model)           # SLOTS x languages weights: bounded
    at = df.columns.index(text_col)

    def run(batches):
        m = held.value
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for lo, hi in steps(texts, 10_000, SLICE):
                got = m.predict(texts[lo:hi]) if m.labels else [(UNDETERMINED, 0.0)] * (hi - lo)
                yield b.slice(lo, hi - lo).filter(pa.array([k != UNDETERMINED and s >= min_score for k, s in got]))

    return df.mapInArrow(run, df.schema)


def held_out(id_col):
    """The fixed test fold: one document in five by the CRC of its id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def learn(df: DataFrame, per_language: int = 500, max_chars: int = 20_000, total_chars: int = 100_000_000,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Model from the labelled rows outside the test fold."""
    train = df.filter(~F.coalesce(held_out(quoted(id_col)), F.lit(False)))
    return fit(training_rows(train, per_language, max_chars, total_chars, id_col, text_col, lang_col))
