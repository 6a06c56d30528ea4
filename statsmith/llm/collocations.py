"""Phrase collocations by best-first growth with admissible bounds.

A phrase grows to the right from its first word.  A phrase of count ``a`` in a
language of ``n`` words scores ``1000 a n / (l r)`` at each cut into parts of
counts ``l`` and ``r``, and the lowest cut counts.  At the cut behind the first
word ``w`` the right part is at least as frequent as the phrase, so no phrase
that starts with ``w`` scores more than ``1000 n / f(w)``: the count of the
prefix bounds all its extensions.  The frontier of first words is expanded from
the highest bound down, in waves; after a wave each language's 2000th surviving
score is known as far as it is settled, and words whose bound lies below it are
never expanded.  A bound equal to it is expanded, so ties are complete.

Texts are read once and kept as arrays of word hashes, 0 between pieces; words
rarer than ``min_count`` can be in no phrase and become 0 too.  A step counts
the windows whose prefix is on the frontier: within a task by numpy, over tasks
by the hashes of their words.  The frontier travels to the tasks in sorted
arrays of at most ``CHUNK`` hashes, one pass over the arrays for each; a false
match of such a hash costs a row and changes no count.  The word hashes
themselves are checked: two words that share one raise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statsmith.llm.common import fresh_dir, quoted, small_batches, stored_table
from statsmith.llm.token_ids import steps

LONGEST = 5
CHUNK = 1_000_000                     # hashes sent to the tasks at once (8 MB)
WORDS_HELD = 150_000                  # distinct words a task remembers before it sends their counts
ROW_CODES = 1 << 12                   # words of a stored row (32 kB; a Parquet page holds 100 rows at least)
STEP_CODES = 1 << 18                  # words counted together
BATCH = "4m"                          # bytes of rows sent to a Python worker at once
BATCH_ROWS = 256                      # rows read from Parquet at once
OUT_ROWS = 1 << 15                    # counted windows sent back at once
FILTER_BITS = 1 << 24                 # slots of the filter of frequent words (2 MB)
BOUND_STEPS = 4                       # steps of a bound for each factor of two
SHARES = (1 / 8, 1.0)                 # of all frequent occurrences, at the end of each wave
UNDETERMINED = "und"

_BREAK = b"."                         # stands for all piece ends; never part of a word
_TABLE = bytes(ord(_BREAK) if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256)).lower()
PARTS = [f"w{i + 1}" for i in range(LONGEST)]
U = np.uint64


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased, with ``.`` between pieces."""
    return text.translate(_TABLE).replace(_BREAK, b" . ").split()


def word_code(word: bytes) -> int:
    """64-bit hash of a word, never 0."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True) or 1


def coded(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows: ``codes`` (hashes of successive words, 0 at the ends
    of pieces and texts) and ``word`` (a word, its hash and count in a task)."""
    docs = df.select(F.coalesce(quoted(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"),
                     F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        number: dict[bytes, int] = {_BREAK: 0}
        code = np.zeros(1, np.int64)
        counts: dict[str, np.ndarray] = {}

        def word_rows():
            names = np.array([*number], object)
            for lang, n in counts.items():
                some = np.flatnonzero(n)
                some = some[some > 0]
                for i in range(0, len(some), 50_000):
                    at = some[i:i + 50_000]
                    yield rows("word", lang, names[at].tolist(), code[at], n[at], [None] * len(at))

        def rows(kind, lang, words, codes, n, binary):
            k = len(binary)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * k, pa.string()), pa.array([lang] * k, pa.string()),
                 pa.array(words, pa.binary()).cast(pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(binary, pa.binary())], names=["kind", "lang", "word", "code", "n", "codes"])

        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in steps(texts, 1000, 1_000_000):
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[lo:hi], texts[lo:hi], strict=True):
                    by.setdefault(lang, []).extend([*words_of(text), _BREAK])
                for lang, words in by.items():
                    new = list(set(words).difference(number))
                    number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                    code = np.concatenate([code, np.array([word_code(w) for w in new], np.int64)])
                    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    n = np.bincount(at, minlength=len(number))
                    have = counts.get(lang, np.zeros(0, np.int64))
                    n[:len(have)] += have
                    counts[lang] = n
                    ends = np.flatnonzero(at == 0)
                    start, blocks = 0, []
                    while start < len(at):          # a row ends where a piece ends
                        k = min(len(ends) - 1, int(np.searchsorted(ends, start + ROW_CODES)))
                        blocks.append(code[at[start:ends[k] + 1]].tobytes())
                        start = int(ends[k]) + 1
                    none = [None] * len(blocks)
                    yield rows("codes", lang, none, none, none, blocks)
                if len(number) > WORDS_HELD:
                    yield from word_rows()
                    number, code, counts = {_BREAK: 0}, np.zeros(1, np.int64), {}
        yield from word_rows()

    return docs.mapInArrow(run, "kind string, lang string, word string, code long, n long, codes binary")


def frequent_words(parts: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(``lang, n``: words of each language; ``lang, code, f, n, bound`` of the
    frequent ones).  Raises when a frequent word shares its hash with another:
    their second hashes differ."""
    total = stored_table(parts.groupBy("lang").agg(F.sum("n").alias("n")), "language-words")
    words = parts.groupBy("lang", "code").agg(F.sum("n").alias("f"), F.min(F.xxhash64("word")).alias("one"),
                                              F.max(F.xxhash64("word")).alias("other"))
    words = words.filter(F.col("f") >= min_count).join(F.broadcast(total), "lang")       # a row for each language
    bound = F.expr("CAST(1000 AS DECIMAL(20,0)) * n div f")
    words = stored_table(words.withColumn("bound", bound), "frequent-words")
    if not words.filter("one <> other").isEmpty():
        raise ValueError("two words share a 64-bit hash")
    return total, words.drop("one", "other")


def word_filter(words: DataFrame) -> np.ndarray:
    """Bit map over hashed slots that is set for every frequent word: fixed
    size, put together from chunks made on the executors."""
    side = 1 << 16

    def run(batches):
        for b in batches:
            for c, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                bits = np.zeros(side, np.uint8)
                bits[s.values.to_numpy()] = 1
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(bits).tobytes()])],
                                                 names=["chunk", "bits"])

    slot = F.col("code").bitwiseAND(FILTER_BITS - 1).cast("int")
    each = words.select(slot.alias("slot")).distinct().groupBy((F.col("slot") / side).cast("int").alias("chunk")).agg(
        F.collect_list((F.col("slot") % side).cast("int")).alias("slots"))               # at most 65,536 a chunk
    out = np.zeros((FILTER_BITS // side, side // 8), np.uint8)
    for r in each.mapInArrow(run, "chunk int, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def without_rare(codes: DataFrame, bits: np.ndarray) -> DataFrame:
    """``lang, codes``: words outside the filter become 0, runs of 0 one 0."""
    held = codes.sparkSession.sparkContext.broadcast(bits)             # 2 MB

    def run(batches):
        for b in batches:
            kept = []
            for v in b.column(1):
                c = np.frombuffer(v.as_buffer(), np.int64)
                slot = c & (FILTER_BITS - 1)
                c = np.where((held.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1, c, 0)
                kept.append(c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]].tobytes() if len(c) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], names=["lang", "codes"])

    return codes.select("lang", "codes").mapInArrow(run, "lang string, codes binary")


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit mix of windows given by the hashes of their words."""
    h = columns[0].view(U)
    for c in columns[1:]:
        h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15) + c.view(U)
    return h


def inside(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(held, values), max(0, len(held) - 1))
    return held[at] == values if len(held) else np.zeros(len(values), bool)


def window_counts(code: np.ndarray, length: int, prefix: int, wanted: np.ndarray):
    """Distinct windows of ``length`` words without 0 whose first ``prefix``
    words mix to a value in ``wanted``: (words, count, least and greatest
    neighbour on the left and on the right; 0 is none)."""
    pad = np.zeros(LONGEST + 1, np.int64)
    c = np.concatenate([pad, code, pad])
    n = len(code)
    at = np.flatnonzero(code) + len(pad)
    for k in range(1, length):
        at = at[c[at + k] != 0]
    if prefix:
        at = at[inside(mixed([c[at + k] for k in range(prefix)]), wanted)]
    if not len(at) or not n:
        return None
    words = [c[at + k] for k in range(length)]
    order = np.argsort(mixed(words), kind="stable")
    words, at = [w[order] for w in words], at[order]
    new = np.zeros(len(at), bool)                 # words decide, so windows whose mixes agree stay apart
    new[0] = True
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(at)])
    left, right = c[at - 1], c[at + length]
    ends = [f.reduceat(x, start) for x in (left, right) for f in (np.minimum, np.maximum)]
    return [w[start] for w in words], size, ends


def count_windows(codes: DataFrame, wanted: dict[int, tuple[int, dict[str, np.ndarray]]]) -> DataFrame:
    """``lang, w1 .. w5, a, l_min, l_max, r_min, r_max`` of all windows of
    each length whose prefix is wanted: length -> (words of the prefix,
    language -> sorted mixes)."""
    held = codes.sparkSession.sparkContext.broadcast(wanted)           # at most CHUNK hashes
    names = ["lang", *PARTS, "a", "l_min", "l_max", "r_min", "r_max"]

    def run(batches):
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def count(lang):
            code = np.concatenate(waiting.pop(lang))
            size.pop(lang)
            for length, (prefix, by) in held.value.items():
                found = window_counts(code, length, prefix, by[lang]) if lang in by else None
                if found:
                    words, n, ends = found
                    zero = np.zeros(len(n), np.int64)
                    whole = pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), *map(pa.array, words + [zero] * (LONGEST - length)),
                         pa.array(n, pa.int64()), *map(pa.array, ends)], names=names)
                    yield from (whole.slice(i, OUT_ROWS) for i in range(0, len(n), OUT_ROWS))

        for b in batches:
            for lang, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = np.frombuffer(v.as_buffer(), np.int64)
                waiting.setdefault(lang, []).extend([c, np.zeros(1, np.int64)])
                size[lang] = size.get(lang, 0) + len(c) + 1
                if size[lang] > STEP_CODES:
                    yield from count(lang)
        for lang in list(waiting):
            yield from count(lang)

    each = codes.mapInArrow(run, "lang string, " + ", ".join(f"{x} long" for x in names[1:]))
    return each.groupBy("lang", *PARTS).agg(
        F.sum("a").alias("a"), F.min("l_min").alias("l_min"), F.max("l_max").alias("l_max"),
        F.min("r_min").alias("r_min"), F.max("r_max").alias("r_max"))


def mix_chunks(phrases: DataFrame, length: int):
    """The mixes of phrases of ``length`` words, by language, sorted, in parts
    of about ``CHUNK``: (number of a row's part, the part, language -> mixes)."""
    n = phrases.count()
    parts = -(-n // CHUNK)
    part = F.pmod(F.xxhash64(*PARTS[:length]), F.lit(max(1, parts)))
    for k in range(parts):
        got = phrases.filter(part == k).select("lang", *PARTS[:length]).toPandas()
        yield part, k, {lang: np.unique(mixed([g[p].to_numpy(np.int64) for p in PARTS[:length]])) for lang, g in got.groupby("lang")}


def counted(codes: DataFrame, phrases: DataFrame, prefix: int, length: int, min_count: int) -> DataFrame:
    """Counts of the phrases of ``length`` words whose first ``prefix`` words
    are in ``phrases``, stored; those under ``min_count`` are left out."""
    path, some = fresh_dir(codes.sparkSession, "phrases"), False
    known = phrases.select("lang", *PARTS[:prefix]).distinct()
    for part, k, by in mix_chunks(phrases, prefix):
        found = count_windows(codes, {length: (prefix, by)}).filter(F.col("a") >= min_count)
        # a window whose prefix only shares its mix with a wanted one goes
        found.join(known.filter(part == k), ["lang", *PARTS[:prefix]], "left_semi").write.mode("append").parquet(path)
        some = True
    schema = f"lang string, {', '.join(f'{p} long' for p in PARTS)}, a long, l_min long, l_max long, r_min long, r_max long"
    if not some:
        return codes.sparkSession.createDataFrame([], schema)
    return codes.sparkSession.read.schema(schema).parquet(path)


def cuts(found: DataFrame) -> DataFrame:
    """Every phrase with every cut: ``k`` and the words of both parts."""
    def part(words):
        return F.struct(*[w.alias(f"p{i + 1}") for i, w in enumerate(words + [F.lit(0).cast("long")] * (LONGEST - len(words)))])

    w = [F.col(p) for p in PARTS]
    each = [F.when(w[k] != 0, F.struct(F.lit(k).alias("k"), part(w[:k]).alias("left"), part(w[k:]).alias("right")))
            for k in range(1, LONGEST)]
    return found.withColumn("cut", F.explode(F.array_compact(F.array(*each))))


def scored(found: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    """``lang, w1 .. w5, a, l, r, n, score, survives``: the lowest cut of every
    phrase, and whether no phrase one word longer is as frequent."""
    def with_count(rows, side, name):
        keys = [F.col(f"cut.{side}.p{i + 1}").alias(f"k{i + 1}") for i in range(LONGEST)]
        part = counts.select(F.col("lang").alias("k0"), *[F.col(p).alias(f"c{i + 1}") for i, p in enumerate(PARTS)],
                             F.col("f").alias(name))
        rows = rows.select("*", *keys)
        on = (rows["lang"] == part["k0"])
        for i in range(LONGEST):
            on = on & (rows[f"k{i + 1}"] == part[f"c{i + 1}"])
        return rows.join(part, on).drop("k0", *[f"{x}{i + 1}" for x in "kc" for i in range(LONGEST)])

    rows = with_count(with_count(cuts(found), "left", "l"), "right", "r").join(F.broadcast(total), "lang")   # a row a language
    big = "CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))"
    score = F.expr(f"CAST({big} AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = rows.withColumn("best", F.struct(score.alias("score"), F.col("cut.k").alias("k"), "l", "r"))
    low = best.groupBy("lang", *PARTS).agg(
        F.min("best").alias("best"), F.first("a").alias("a"), F.first("n").alias("n"),
        *[F.first(x).alias(x) for x in ("l_min", "l_max", "r_min", "r_max")])
    same = ((F.col("l_min") == F.col("l_max")) & (F.col("l_min") != 0)) | ((F.col("r_min") == F.col("r_max")) & (F.col("r_min") != 0))
    return low.select("lang", *PARTS, "a", "best.l", "best.r", "n", "best.score", (~same | (F.col("w5") != 0)).alias("survives"))


def settled(found: DataFrame, top: int) -> DataFrame:
    """``lang, least``: the ``top``-th surviving score of each language that
    has so many."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"))
    return found.filter("survives").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= top).filter(
        F.col("at") == top).select("lang", F.col("score").alias("least"))


def wave_bounds(words: DataFrame) -> list[tuple[int, int]]:
    """Steps of the bound that each wave covers, highest first, from the number
    and occurrences of the words in each step (some hundred rows)."""
    found = words.groupBy("step").agg(F.sum("f").alias("f")).orderBy(F.desc("step")).collect()
    total, run, out, first = sum(r["f"] for r in found), 0, [], None
    shares = list(SHARES)
    for r in found:
        first = r["step"] if first is None else first
        run += r["f"]
        if run >= shares[0] * total:
            out.append((first, r["step"]))
            first = None
            while len(shares) > 1 and run >= shares[0] * total:
                shares.pop(0)
    return out + ([(first, found[-1]["step"])] if first is not None else [])


def mine(df: DataFrame, top: int = 2000, min_count: int = 100, lang_col: str = "lang", text_col: str = "text",
         report: list | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top``
    surviving phrases by falling score, falling count and rising phrase.

    Null texts count as empty, a null language as ``und``.  Repeated rows count
    as often as they come.  An empty table, and a language without a phrase of
    ``min_count`` occurrences, give no rows.  ``report`` (a list) receives a
    tuple (highest, lowest step of the bound, first words expanded, phrases
    found) for each wave.
    """
    spark = df.sparkSession
    with small_batches(spark, BATCH, BATCH_ROWS):
        path = fresh_dir(spark, "coded")
        coded(df, lang_col, text_col).write.partitionBy("kind").parquet(path)
        schema = "lang string, word string, code long, n long, codes binary, kind string"
        parts = spark.read.schema(schema).parquet(path)
        total, words = frequent_words(parts.filter("kind = 'word'"), min_count)
        codes = stored_table(without_rare(parts.filter("kind = 'codes'"), word_filter(words)), "codes")
        zero = F.lit(0).cast("long")
        first = words.select("lang", F.col("code").alias("w1"), *[zero.alias(p) for p in PARTS[1:]], "f", "bound",
                             F.floor(F.log2(F.col("bound").cast("double")) * BOUND_STEPS).cast("int").alias("step"))
        counts = first.select("lang", *PARTS, "f")
        schema = f"lang string, {', '.join(f'{p} long' for p in PARTS)}, a long, l long, r long, n long, score long, survives boolean"
        results = spark.createDataFrame([], schema)
        floor = spark.createDataFrame([], "lang string, least long")
        for high, low in wave_bounds(first):
            front = first.filter(F.col("step").between(low, high)).join(F.broadcast(floor), "lang", "left")    # a row a language
            front = front.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("least")
            grown, found = front, []
            for length in range(2, LONGEST + 1):
                grown = counted(codes, grown, length - 1, length, min_count)
                found.append(grown)
                if grown.isEmpty():
                    break
            new = found[0]
            for f in found[1:]:
                new = new.unionByName(f)
            counts = counts.unionByName(new.select("lang", *PARTS, F.col("a").alias("f")))
            counts = missing_parts(codes, new, counts)
            results = results.unionByName(stored_table(scored(new, counts, total), "scored"))
            floor = stored_table(settled(results, top), "floor")
            if report is not None:
                report.append((high, low, front.count(), new.count()))
    return ranked(results, floor, parts.filter("kind = 'word'").select("lang", "code", "word"), top)


def missing_parts(codes: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` with the right parts of ``found`` whose first word has not
    been expanded, counted exactly."""
    right = cuts(found).select("lang", *[F.col(f"cut.right.p{i + 1}").alias(p) for i, p in enumerate(PARTS)])
    lacking = stored_table(right.filter("w2 <> 0").distinct().join(counts, ["lang", *PARTS], "left_anti"), "parts")
    size = sum((F.col(p) != 0).cast("int") for p in PARTS)
    for r in lacking.groupBy(size.alias("size")).count().orderBy("size").collect():          # lengths 2 to 4
        got = counted(codes, lacking.filter(size == r["size"]), r["size"], r["size"], 1)
        counts = counts.unionByName(got.select("lang", *PARTS, F.col("a").alias("f")))
    return counts


def ranked(results: DataFrame, floor: DataFrame, words: DataFrame, top: int) -> DataFrame:
    rows = results.filter("survives").join(F.broadcast(floor), "lang", "left")                            # a row a language
    rows = rows.filter(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    rows = stored_table(rows, "best")                                            # ``top`` rows a language, and ties
    codes = rows.select("lang", F.explode(F.array(*PARTS)).alias("code")).filter("code <> 0").distinct()
    names = stored_table(words.join(codes, ["lang", "code"], "left_semi").distinct(), "names")
    for p in PARTS:
        name = names.select(F.col("lang").alias("word_lang"), F.col("code"), F.col("word").alias(f"{p}_word"))
        rows = rows.join(name, (rows["lang"] == name["word_lang"]) & (rows[p] == name["code"]), "left").drop("word_lang", "code")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"{p}_word" for p in PARTS]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT d, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM t),
v AS (SELECT d, lang, k, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM p),
o1 AS (SELECT d, lang, k, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM v),
o5 AS (SELECT lang, w1, lead(w1, 1) OVER z AS w2, lead(w1, 2) OVER z AS w3, lead(w1, 3) OVER z AS w4, lead(w1, 4) OVER z AS w5
       FROM o1 WINDOW z AS (PARTITION BY d, k ORDER BY i)),
g AS MATERIALIZED (SELECT lang, [w1, w2, w3, w4, w5][1:m] AS g, m, count(*) AS f FROM o5, range(1, 6) r(m)
      WHERE m = 1 OR (m = 2 AND w2 IS NOT NULL) OR (m = 3 AND w3 IS NOT NULL) OR (m = 4 AND w4 IS NOT NULL) OR w5 IS NOT NULL AND m = 5
      GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE f >= 100 AND m > 1),
longer AS (SELECT lang, g[1:m - 1] AS g, f FROM c UNION SELECT lang, g[2:m] AS g, f FROM c),
alive AS (SELECT c.* FROM c ANTI JOIN longer USING (lang, g, f)),
x AS MATERIALIZED (SELECT lang, g, f, k, g[1:k] AS lg, g[k + 1:m] AS rg FROM alive, range(1, 5) r(k) WHERE k < m),
k AS (SELECT x.lang, x.g, x.f, x.k, lf.f AS l, rf.f AS r,
             (1000::HUGEINT * x.f::HUGEINT * n.n) // (lf.f::HUGEINT * rf.f::HUGEINT) AS score
      FROM x JOIN n ON n.lang = x.lang JOIN g lf ON lf.lang = x.lang AND lf.g = x.lg JOIN g rf ON rf.lang = x.lang AND rf.g = x.rg),
b AS (SELECT lang, g, any_value(f) AS a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score
      FROM k GROUP BY lang, g),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank,
             array_to_string(g, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, score::BIGINT AS score FROM b)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
