"""Ranked lexical search over posting lists in geometric blocks.

Queries are worked off in passes of a bounded number of terms.  A pass reads
every whole document once and keeps, of each, its length and the frequencies of
the pass's terms.  Those rows are indexed in shards of a bounded number of
documents, so a frequent term is spread over all shards.  Inside a shard each
term's posting list is clustered by document similarity (nearest of some of the
list's own documents, by a random projection of the impact vectors); each
cluster is a block, and its summary is the coordinatewise maximum of its
documents' impacts.  The sum of a summary over a query's terms bounds the score
of every document of the block, exactly, in integers.  A query takes the blocks
of its terms by falling bound and stops at the first bound below its 50th best
score: only blocks that cannot hold a better or equal document are skipped.

A first round over one in ``SEED_SHARE`` documents gives each
query a score that at least ``k`` documents reach; the round over all documents
starts from it, so each query sends a number of rows that does not grow with
the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statsmith.llm.common import fresh_dir, quoted, stored_table
from statsmith.llm.token_ids import steps

PASS_TERMS = 8192                     # distinct terms of the queries of one pass (a longer query stands alone)
PASS_ITEMS = 4096
SHARD_CELLS = 1 << 22                 # documents x terms of a shard
SHARD_DOCS = 1024
BLOCK_DOCS = 16                       # documents of a block, on average
SKETCH = 16                           # dimensions of the random projection
SEED_SHARE = 16                       # one document in so many takes part in the first round
LONG_QUERY = 2000                     # terms of a query whose co-occurring terms are not listed

# letters, digits and everything beyond ASCII; A-Z in lower case, the rest a blank
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: maximal runs of ASCII letters and digits and
    of characters beyond ASCII, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Queries:
    """The items of one pass: distinct terms by number, the terms of each item."""

    def __init__(self, items: list[list[bytes]]):
        self.vocab: dict[bytes, int] = {}
        self.items = [np.array(sorted({self.vocab.setdefault(t, len(self.vocab)) for t in item}), np.int64) for item in items]
        n = len(self.vocab)
        self.holders: list[list[int]] = [[] for _ in range(n)]
        for i, item in enumerate(self.items):
            for t in item.tolist():
                self.holders[t].append(i)
        # coordinates of a term's summaries: the terms that some item holds together with it (None: all)
        self.coordinates: list[np.ndarray | None] = [None] * n
        for t, held in enumerate(self.holders):
            size = sum(len(self.items[i]) for i in held)
            if size <= max(n // 2, 64) and all(len(self.items[i]) <= LONG_QUERY for i in held):
                self.coordinates[t] = np.unique(np.concatenate([self.items[i] for i in held]))
        rng = np.random.default_rng(11)
        self.directions = rng.standard_normal((n, SKETCH)).astype(np.float32)


class Weights:
    """Statistics of all documents: term weights, number and total length."""

    def __init__(self, frequency: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in frequency], np.int64)

    def impacts(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * length * self.n_docs) // max(1, self.n_terms)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Shard:
    """Impacts of a bounded number of documents and the blocks of each posting
    list: rows of documents, their limits, and the summaries."""

    def __init__(self, queries: Queries, row: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int):
        self.queries = queries
        self.impact = np.zeros((docs, len(queries.vocab)), np.int64)
        self.impact[row, term] = impact
        sketch = np.zeros((docs, SKETCH), np.float32)
        if len(row):
            part = queries.directions[term] * impact[:, None].astype(np.float32)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sketch[row[first]] = np.add.reduceat(part, first, axis=0)
        sketch /= np.maximum(np.sqrt((sketch * sketch).sum(axis=1, keepdims=True)), 1e-9)
        order = np.lexsort((row, term))
        names, start = np.unique(term[order], return_index=True)
        lists = np.split(row[order], start[1:]) if len(names) else []
        self.blocks: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        for t, rows in zip(names.tolist(), lists, strict=True):
            self.blocks[t] = self._clustered(t, rows, sketch)

    def _clustered(self, t: int, rows: np.ndarray, sketch: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Blocks of one posting list and their summaries (blocks, coordinates)."""
        at = self.queries.coordinates[t]
        n = len(rows) // BLOCK_DOCS
        if n < 2:
            part, start = rows, np.zeros(1, np.int64)
        else:
            pivots = rows[np.linspace(0, len(rows) - 1, n).astype(np.int64)]
            nearest = (sketch[rows] @ sketch[pivots].T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            part = rows[order]
            start = np.flatnonzero(np.r_[True, np.diff(nearest[order]) != 0])
        cells = self.impact[part] if at is None else self.impact[part[:, None], at[None, :]]
        return np.split(part, start[1:]), np.maximum.reduceat(cells, start, axis=0)

    def top(self, item: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores) of the documents that score ``floor`` or more and are
        among the first ``k`` by falling score and rising row; blocks read."""
        terms = self.queries.items[item]
        blocks, bounds = [], []
        for t in terms.tolist():
            found = self.blocks.get(t)
            if found is not None:
                at = self.queries.coordinates[t]
                cols = terms if at is None else np.searchsorted(at, terms)
                blocks += found[0]
                bounds.append(found[1][:, cols].sum(axis=1))
        best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not blocks:
            return *best, 0
        bound = np.concatenate(bounds)
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        seen = np.zeros(len(self.impact), bool)
        done, step = 0, 2
        floor = max(1, floor)
        while done < len(order) and bound[done] >= floor:
            # the next few blocks whose exact bound reaches the score to beat
            upto = min(done + step, int(np.searchsorted(-bound, -floor, "right")))
            rows = np.unique(np.concatenate([blocks[i] for i in order[done:upto]]))
            rows = rows[~seen[rows]]
            seen[rows] = True
            scores = self.impact[rows[:, None], terms[None, :]].sum(axis=1)
            keep = scores >= floor
            rows, scores = np.concatenate([best[0], rows[keep]]), np.concatenate([best[1], scores[keep]])
            first = np.lexsort((rows, -scores))[:k]
            best = rows[first], scores[first]
            if len(first) == k:
                floor = max(floor, int(best[1][-1]))
            done, step = upto, step * 2
        return *best, done


def query_passes(queries: DataFrame, id_col: str, text_col: str):
    """Lists of (item id, terms), each a pass; rows come to the driver a
    partition at a time, and a pass at most is held."""
    rows = queries.select(quoted(id_col).alias("item_id"), F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text"))
    held, seen = [], set()
    for r in rows.distinct().toLocalIterator():
        terms = set(terms_of(bytes(r["text"])))
        if not terms:
            continue
        if held and (len(seen | terms) > PASS_TERMS or len(held) >= PASS_ITEMS):
            yield held
            held, seen = [], set()
        held.append((r["item_id"], sorted(terms)))
        seen |= terms
    if held:
        yield held


def term_rows(docs: DataFrame, queries: Queries) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every row of ``doc_id, text`` (binary): the
    text's number of terms, and the pass's terms with their frequencies."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(queries.vocab)     # the terms of one pass

    def run(batches):
        vocab = held.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in steps(texts):
                length, doc, term = [], [], []
                for t in texts[lo:hi]:
                    words = terms_of(t)
                    length.append(len(words))
                    found = [v for v in map(vocab.get, words) if v is not None]
                    term += found
                    doc.append(len(found))
                row = np.repeat(np.arange(hi - lo), doc)
                cell, tf = np.unique(row * max(1, len(vocab)) + np.array(term, np.int64), return_counts=True)
                offsets = np.searchsorted(cell, np.arange(hi - lo + 1) * max(1, len(vocab))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(length, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(cell % max(1, len(vocab)), pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def best_rows(rows: DataFrame, queries: Queries, weights: Weights, k: int, floors: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: the best ``k`` documents of each shard for each
    item, of those that reach the item's floor."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast((queries, weights, floors))    # of one pass
    size = max(32, min(SHARD_DOCS, SHARD_CELLS // max(1, len(queries.vocab))))

    def search(part: pa.Table):
        q, w, floor = held.value
        part = part.take(pc.sort_indices(part.column("doc_id")))       # rows rise with the id, nulls last
        terms = part.column("terms").combine_chunks()
        counts = np.diff(terms.offsets.to_numpy())
        row = np.repeat(np.arange(len(part)), counts)
        length = part.column("n").to_numpy()[row]
        term = terms.flatten().to_numpy().astype(np.int64)
        shard = Shard(q, row, term, w.impacts(term, part.column("tfs").combine_chunks().flatten().to_numpy(), length), len(part))
        found = [shard.top(i, k, int(floor[i])) for i in range(len(q.items))]
        at = np.concatenate([f[0] for f in found])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), pa.int32()),
             part.column("doc_id").combine_chunks().take(pa.array(at)),
             pa.array(np.concatenate([f[1] for f in found]), pa.int64())], names=["item", "doc_id", "score"])

    def run(batches):
        parts, n = [], 0
        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column(2)), 0))
            for lo in range(0, b.num_rows, size):
                piece = b.slice(lo, size)
                while piece.num_rows:
                    take = piece.slice(0, size - n)
                    parts.append(take)
                    n += take.num_rows
                    piece = piece.slice(take.num_rows)
                    if n == size:
                        yield search(pa.Table.from_batches(parts))
                        parts, n = [], 0
        if n:
            yield search(pa.Table.from_batches(parts))

    return rows.mapInArrow(run, f"item int, doc_id {kind}, score long")


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each item with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest
    score above 0 for each item, all if fewer; equal scores by rising id, a
    null id last.

    Null and empty texts hold no terms; an item without terms, or whose terms
    no document holds, has no rows.  Rows of ``docs`` that repeat an id are
    documents of their own.  Equal rows of ``queries`` are one item; rows that
    share an id but not the text are ranked apart.  Empty tables give an empty
    result.  Each pass over the queries is written to the shared folder.
    """
    spark = docs.sparkSession
    texts = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text"))
    kinds = queries.select(quoted(item_col).alias("item_id")).schema["item_id"], texts.schema["doc_id"]
    schema = f"item_id {kinds[0].dataType.simpleString()}, rank int, doc_id {kinds[1].dataType.simpleString()}, score long"
    path, passes = fresh_dir(spark, "search"), 0
    for held in query_passes(queries, item_col, item_text_col):
        q = Queries([terms for _, terms in held])
        rows = stored_table(term_rows(texts, q), "term-rows")
        n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()    # terms of one pass
        frequency = np.zeros(len(q.vocab), np.int64)
        for r in counts:
            frequency[r["term"]] = r["count"]
        weights = Weights(frequency, n_docs, n_terms)
        seeds = rows.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SEED_SHARE)) == 0)
        floors = np.zeros(len(held), np.int64)
        for r in first_rows(best_rows(seeds, q, weights, k, floors), k).filter(F.col("rank") == k).collect():   # a row an item
            floors[r["item"]] = r["score"]
        ranked = first_rows(best_rows(rows, q, weights, k, floors), k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(held)],
                                      f"item int, item_id {kinds[0].dataType.simpleString()}")
        ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        passes += 1
    return spark.read.schema(schema).parquet(path) if passes else spark.createDataFrame([], schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents),
s AS (SELECT count(*) FILTER (len(words) > 0) AS big_n, sum(len(words))::BIGINT AS big_l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
      FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
