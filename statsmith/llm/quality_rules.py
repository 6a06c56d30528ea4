"""Quality rules whose cutoffs are chosen with a bound on false rejection.

Each rule rejects a document when a statistic of its whole text exceeds a
cutoff.  In each stratum (language) a cutoff counts as safe when the exact
binomial (Clopper-Pearson) upper bound of its rejection rate among labelled
good documents is below the rule's share of the allowed false rejection.
Cutoffs are tested from the loosest to the tightest, stopping at the first
failure (fixed sequence: no correction among them); the error level is divided
by the number of strata and rules (Bonferroni).  So with the given confidence
no stratum loses more than ``allowed`` of its good documents to the rules.  A
rule without a safe cutoff is not used in that stratum.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.llm.common import quoted, stored_table
from statsmith.llm.token_ids import steps

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"                  # fixed by the contract
WINDOW = 5

# rule -> statistic, and its cutoffs from the loosest to the tightest
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02)),
    "upper_case": ("n_upper / greatest(n_letters, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15)),
    "exclamations": ("n_exclaims / greatest(n_words, 1)", (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05)),
}


def words_of(text: str) -> list[str]:
    """Runs of characters other than the six ASCII blanks."""
    return [w for w in _SPACE.split(text) if w]


def repeated(words: list[str]) -> int:
    """Words inside a window of five words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # exact window numbers: pairs, pairs of pairs, and the fifth word
    rank = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
    two = rank(code[:-1], code[1:])
    four = rank(two[:-2], two[2:])
    five = rank(four[:n], code[4:4 + n])
    often = np.bincount(five)[five] > 1
    if not often.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1]) > 0))


def text_statistics(text: str) -> tuple:
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)] if "\n" in text else ([text] if words else [])
    joined = "".join(words)
    upper = sum(map(joined.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if joined.isascii() else sum(map(str.isupper, joined))
    return (len(words), len(joined), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words),
            len(lines), upper, len(joined) - sum(map(joined.count, "0123456789,.;:!?-'\"()" + SYMBOLS)), text.count("!"))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
         "n_exclaims")


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and the counts in ``STATS`` of each whole text."""
    docs = df.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                     F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in steps(texts):
                cols = zip(*map(text_statistics, texts[lo:hi]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                     *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "stratum", *STATS])

    return docs.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{s} long" for s in STATS))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound: the rate at which k or fewer of n has
    probability ``level``."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    fixed = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        term = fixed + i * math.log(p) + (n - i) * math.log1p(-p) if p < 1 else np.full(len(i), -np.inf)
        top = term.max()
        tail = top + math.log(np.exp(term - top).sum()) if top > -np.inf else -np.inf
        lo, hi = (p, hi) if tail > math.log(level) else (lo, p)
    return hi


def choose_cutoffs(counts: dict, allowed: float = 0.05, error: float = 0.05) -> dict:
    """``counts``: stratum -> (good documents, rule -> rejected per cutoff).
    Returns stratum -> rule -> cutoff (only safe ones)."""
    level = error / max(1, len(counts) * len(RULES))
    out = {}
    for stratum, (n, rejected) in counts.items():
        out[stratum] = {}
        for rule, (_, cuts) in RULES.items():
            for cut, k in zip(cuts, rejected[rule], strict=True):
                if n == 0 or upper_bound(k, n, level) > allowed / len(RULES):
                    break
                out[stratum][rule] = cut
    return out


def apply_rules(df: DataFrame, labels: DataFrame, allowed: float = 0.05, error: float = 0.05, min_words: int = 10,
                id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id``, the counts in ``STATS``,
    ``base_failed``, ``rejected_by`` (the first rule that rejects, or null) and
    ``kept``.

    ``labels`` has ``doc_id`` and ``quality`` (1 is good).  Null text counts as
    empty, a null stratum is a stratum of its own; a stratum without good
    labelled documents has no rules.  Repeated rows give repeated rows, and a
    label repeated for one id counts once (good if any says so).  An empty
    table gives an empty result.  The driver holds one row per stratum.
    """
    stats = stored_table(statistics(df, id_col, text_col, stratum_col), "statistics")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    hold = stats.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    aggs = [F.sum((F.expr(e) > c).cast("long")).alias(f"{r}_{i}") for r, (e, cuts) in RULES.items()
            for i, c in enumerate(cuts)]
    counts = {r["stratum"]: (r["good"], {n: [r[f"{n}_{i}"] for i in range(len(c))] for n, (_, c) in RULES.items()})
              for r in hold.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *aggs).collect()}
    chosen = choose_cutoffs(counts, allowed, error)
    by = F.lit(None).cast("string")
    for rule, (expr, _) in RULES.items():
        cuts = {s: c[rule] for s, c in chosen.items() if rule in c}
        if cuts:
            cut = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv])[F.col("stratum")]
            by = F.coalesce(by, F.when(F.expr(expr) > cut, F.lit(rule)))
    return stats.withColumn("rejected_by", by).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
