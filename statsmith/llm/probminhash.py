"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is its weighted shingles: five lower-cased words, weighted by how
often they occur (a shorter text is one shingle).  ProbMinHash: each shingle
is a Poisson process with its weight as rate, whose arrivals fall on random
registers; a register keeps the shingle that arrives first, and a shingle
stops as soon as its next arrival is later than every register's.  Two
documents agree in a register with probability equal to their probability
Jaccard, and in a register of their shingles without weights with their plain
Jaccard, so bands of both kinds of registers give candidates.  Candidates are
verified on the whole texts: a link is a probability Jaccard or a plain
Jaccard of the shingles of at least the threshold.

Texts with the same words are one node from the start.  Within a band's
bucket nobody is paired with everybody: members are first paired with the
bucket's smallest id.  In buckets that then still hold several classes, blocks
of members compare their signatures in place: each member outside the largest
class is paired with its best match in another class, and after another round
of classes with all remaining matches of other classes, each pair in the first
bucket that it shares.  A pair counts as a match, and its texts are read, when
at least ``FLOOR`` registers agree (weighted or plain), inside buckets also at
least ``LONG_FLOOR`` of a longer signature (either kind).  Registers are compared by a byte,
and no chance equality is reckoned with, so the floors hold for texts of any
length: at 0.8 they miss 1.4 and 0.7 pairs in 100,000 (binomial tails).  Pairs
inside one class are never formed, and no bucket is cut off: a large one is
worked off in pairs of blocks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.llm.common import id_text, stored_table
from statsmith.llm.token_ids import steps

U = np.uint64
WORDS = 5                             # words of a shingle
BANDS, ROWS = 26, 5                   # registers of a kind: 130; a pair at 0.8 is missed once in 30,000
FLOOR = 0.646                         # least share of equal registers: 0.8 less 4.4 standard errors
LONG = 512                            # registers, a byte of each, of a node that shares a bucket
LONG_FLOOR = 0.72                     # least share of equal ones: 0.8 less 4.5 standard errors
BLOCK = 2000                          # members of a bucket compared at a time
CACHE_WORDS = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes:
    """64-bit hashes of words, remembered by a Python worker."""

    def __init__(self):
        import xxhash
        self.digest = xxhash.xxh3_64_intdigest
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.digest(w)
        return np.fromiter(map(known.__getitem__, words), U, len(words))


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(texts: list[str]):
    """Weighted shingles of whole texts: (document, hash, count) arrays sorted
    by document and hash, and a 128-bit key of each document's words."""
    import xxhash
    hasher = word_hashes()
    words = [t.lower().split() for t in texts]
    keys = [xxhash.xxh3_128_digest(" ".join(w)) for w in words]
    n = np.array([len(w) for w in words], np.int64)
    flat = hasher([w for ws in words for w in ws])
    doc = np.repeat(np.arange(len(n)), n)
    end = np.cumsum(n)
    value = np.zeros(len(flat), U)
    for k in range(WORDS):
        part = np.zeros(len(flat), U)
        part[:len(flat) - k] = flat[k:]
        if k:                                     # words behind the document's end count as none
            part[np.arange(len(flat)) + k >= end[doc]] = U(0)
        value = _mix(value * U(0x9E3779B97F4A7C15) + part + U(k))
    place = np.arange(len(flat)) - (end - n)[doc]
    use = place <= np.maximum(0, n - WORDS)[doc]
    doc, value = doc[use], value[use]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])][:len(doc)])
    return doc[start], value[start], np.diff(np.r_[start, len(doc)]), keys


def signatures(docs: int, doc: np.ndarray, value: np.ndarray, count: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash signatures (docs, registers) of weighted shingles."""
    time = np.full((docs, registers), np.inf)
    who = np.zeros((docs, registers), U)
    flat_time, flat_who = time.ravel(), who.ravel()
    limit = np.full(docs, np.inf)
    arrival = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        r = _mix(value + U(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
        # an exponential waiting time, and the register that the arrival falls on
        arrival = arrival - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / count
        go = arrival < limit[doc]
        doc, value, count, arrival, r = doc[go], value[go], count[go], arrival[go], r[go]
        at = doc * registers + (_mix(r) % U(registers)).astype(np.int64)
        np.minimum.at(flat_time, at, arrival)
        won = flat_time[at] == arrival
        flat_who[at[won]] = value[won]
        left = doc[np.r_[True, doc[1:] != doc[:-1]][:len(doc)]]      # documents with shingles still arriving
        limit[left] = time[left].max(axis=1)
    return who


def band_keys(who: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(docs, bands) keys; equal where all registers of the band are."""
    key = np.tile(np.arange(bands, dtype=U), (len(who), 1))
    for r in range(rows):
        key = _mix(key * U(0x9E3779B97F4A7C15) + who[:, r::rows][:, :bands])
    return key.view(np.int64)


def both_signatures(docs: int, doc: np.ndarray, value: np.ndarray, count: np.ndarray, registers: int) -> np.ndarray:
    """(docs, 2, registers): signatures of the weighted and of the plain
    shingles, which are the same where no shingle repeats."""
    weighted = signatures(docs, doc, value, count, registers)
    both = np.stack([weighted, weighted], axis=1)
    many = np.zeros(docs, bool)
    many[doc[count > 1]] = True
    if many.any():
        part = many[doc]
        both[many, 1] = signatures(int(many.sum()), (np.cumsum(many) - 1)[doc[part]], value[part],
                                   np.ones(int(part.sum())), registers)
    return both


def low_bytes(who: np.ndarray) -> np.ndarray:
    """A byte of each register."""
    return (_mix(who) & U(255)).astype(np.uint8)


def equal_share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal bytes along the last axis."""
    return np.bitwise_count(np.packbits(x == y, axis=-1)).sum(axis=-1, dtype=np.int64) / x.shape[-1]


def long_signatures(docs: int, doc: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(docs, 2, LONG) bytes: a byte of each register of the weighted and of
    the plain shingles."""
    return low_bytes(both_signatures(docs, doc, value, count, LONG))


def long_match(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The larger share of equal registers of rows of ``long_signatures``."""
    return equal_share(x, y).max(axis=1)


def similarity(x, cx, y, cy) -> tuple[float, float]:
    """(probability Jaccard, plain Jaccard) of two weighted sets, given as
    sorted hashes and counts."""
    both, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    union = len(x) + len(y) - len(both)
    if not len(both):
        return 0.0, 0.0
    a, b = cx[ix].astype(float), cy[iy].astype(float)
    only_x, only_y = cx.sum() - a.sum(), cy.sum() - b.sum()
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    ratio = a / b
    low = np.searchsorted(ratio, ratio, "left")                    # those with a smaller ratio
    above = a.sum() - np.r_[0, np.cumsum(a)][low] + only_x
    below = np.r_[0, np.cumsum(b)][low] + only_y
    return float((1 / (above / a + below / b)).sum()), len(both) / union


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, words`` (128-bit key of the word sequence), ``bands`` (null
    for a text without words; those of the weighted, then those of the plain
    shingles), ``sig`` (a byte of each register, likewise)."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in steps(texts):
                doc, value, count, keys = shingles(texts[lo:hi])
                who = both_signatures(hi - lo, doc, value, count, bands * rows)
                key = np.concatenate([band_keys(who[:, k], bands, rows) for k in (0, 1)], axis=1)
                low = low_bytes(who)
                some = np.zeros(hi - lo, bool)
                some[doc] = True
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(keys, pa.binary()),
                     pa.array([k if s else None for k, s in zip(key.tolist(), some, strict=True)], pa.list_(pa.int64())),
                     pa.array([x.tobytes() for x in low], pa.binary())], names=["doc_id", "words", "bands", "sig"])

    return docs.mapInArrow(run, "doc_id long, words binary, bands array<long>, sig binary")


def matching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose signatures, weighted or plain, agree in
    enough registers."""

    def run(batches):
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, 2, -1)
                    if t.num_rows else np.zeros((0, 2, 1), np.uint8) for c in ("sa", "sb"))
            yield t.select(["a", "b"]).filter(pa.array(equal_share(x, y).max(axis=1) >= FLOOR, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def block_pairs(bucket: int, node: np.ndarray, label: np.ndarray, sig: np.ndarray, long: np.ndarray, bands: np.ndarray,
                block: np.ndarray, best: bool) -> np.ndarray:
    """(pairs, 2) nodes of different labels whose signatures match, short and
    long, and that share no band before this bucket's: all, or for each member
    outside the largest label its best match.  With two blocks only pairs
    across them (those within are another task's)."""
    size = np.unique(label, return_counts=True)
    rows = np.flatnonzero(label != size[0][size[1].argmax()])
    many = (sig[:, 0] != sig[:, 1]).any(axis=1)                    # the other texts have no repeated shingles
    two = len(np.unique(block)) > 1
    out = [np.zeros((0, 2), np.int64)]
    step = max(1, 20_000_000 // max(1, sig.size))
    for i in range(0, len(rows), step):
        r = rows[i:i + step]
        same = equal_share(sig[r, None, 0], sig[None, :, 0])
        own = many[r]
        same[own] = np.maximum(same[own], equal_share(sig[r[own], None, 1], sig[None, :, 1]))
        same[:, many] = np.maximum(same[:, many], equal_share(sig[r, None, 1], sig[None, many, 1]))
        ok = (label[r][:, None] != label[None]) & (same >= FLOOR)
        if two:
            ok &= block[r][:, None] != block[None]
        x, y = np.nonzero(ok)
        x, near = r[x], np.zeros(len(y))
        for j in range(0, len(x), 20_000):
            p, q = x[j:j + 20_000], y[j:j + 20_000]
            first = (bands[p] == bands[q]).argmax(axis=1)
            near[j:j + 20_000] = np.where(bands[p, first] == bucket, long_match(long[p], long[q]), 0)
        x, y, near = (v[near >= LONG_FLOOR] for v in (x, y, near))
        if best and len(x):
            order = np.lexsort((node[y], -near, x))
            x, y = x[order], y[order]
            first = np.r_[True, x[1:] != x[:-1]]
            x, y = x[first], y[first]
        out.append(np.sort(np.stack([node[x], node[y]], axis=1), axis=1))
    return np.unique(np.concatenate(out), axis=0)


def bucket_pairs(places: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, best: bool) -> DataFrame:
    """Matching pairs across the classes of each bucket that holds several."""
    held = places.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = held.groupBy("bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2"),
                                       F.count(F.lit(1)).alias("n")).filter("l1 <> l2").select(
        "bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    # a repeated id has the signatures of each of its texts: it matches by any of them
    long = sets.select(F.col("doc_id").alias("node"), "long").distinct()
    some = held.join(mixed, "bucket").join(nodes.select("node", "sig", "bands"), "node").join(long, "node")
    some = some.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = some.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "node", "label", "sig", "long", "bands", "block", F.least("block", "other").alias("b1"),
                         F.greatest("block", "other").alias("b2"))

    def run(table):
        node, label, block = (table.column(c).to_numpy() for c in ("node", "label", "block"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(node), 2, -1)
        long = np.frombuffer(b"".join(table.column("long").to_pylist()), np.uint8).reshape(len(node), 2, -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        pairs = block_pairs(table.column("bucket")[0].as_py(), node, label, sig, long, bands, block, best)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("bucket", "b1", "b2").applyInArrow(run, "a long, b long").distinct()


def compressed(docs: DataFrame) -> DataFrame:
    """``doc_id, zipped``: whole texts as zstandard frames, for a shuffle."""

    def run(batches):
        import zstandard
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([pack(t.encode()) for t in b.column(1).to_pylist()], pa.binary())],
                names=["doc_id", "zipped"])

    return docs.mapInArrow(run, "doc_id long, zipped binary")


def shingle_sets(zipped: DataFrame) -> DataFrame:
    """``doc_id, hashes, counts`` (sorted little-endian blobs) and ``long``
    (``long_signatures``) of ``compressed`` texts."""

    def run(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            frames = b.column(1).to_pylist()
            for at in range(0, len(frames), 500):
                texts = [unpack(f).decode() for f in frames[at:at + 500]]
                for lo, hi in steps(texts):
                    doc, value, count, _ = shingles(texts[lo:hi])
                    long = long_signatures(hi - lo, doc, value, count)
                    cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(at + lo, hi - lo),
                         pa.array([value[i:e].tobytes() for i, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                         pa.array([count[i:e].astype(np.uint32).tobytes() for i, e in zip(cut[:-1], cut[1:], strict=True)],
                                  pa.binary()), pa.array([x.tobytes() for x in long], pa.binary())],
                        names=["doc_id", "hashes", "counts", "long"])

    return zipped.mapInArrow(run, "doc_id long, hashes binary, counts binary, long binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links among the pairs (``a, b``) by their exact shingle sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))

    def run(batches):
        for t in batches:
            keep = []
            for ha, ca, hb, cb in zip(*(t.column(c).to_pylist() for c in ("ha", "ca", "hb", "cb")), strict=True):
                s = similarity(np.frombuffer(ha, U), np.frombuffer(ca, np.uint32),
                               np.frombuffer(hb, U), np.frombuffer(cb, np.uint32))
                keep.append(max(s) >= threshold - 1e-12)
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(
        run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component, for
    every node of ``links`` (``a, b``).  Each round hooks a node to its
    smallest neighbour and contracts; rounds grow with the logarithm of the
    longest path."""
    edges = stored_table(links.filter("a <> b"), "edges")
    labels = stored_table(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                          .withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        top = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = stored_table(up.join(top, "p").select("a", F.col("q").alias("p")), "parents")
        labels = stored_table(labels.join(up.withColumnRenamed("a", "label"), "label", "left").select(
            "node", F.coalesce("p", "label").alias("label")), "labels")
        one = up.select("a", F.col("p").alias("pa"))
        two = up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = stored_table(edges.join(one, "a").join(two, "b").filter("pa <> pb").select(
            F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links: the classes that they join are
    contracted, so a round costs as much as the new links."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = stored_table(links.join(one, "a", "left").join(two, "b", "left").select(
        "a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "links")
    top = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    ends = joined.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("label")),
                                           F.struct(F.col("b").alias("node"), F.col("lb").alias("label")))).alias("e"))
    every = labels.select("node", "label").unionByName(ends.select("e.*")).distinct()
    top = top.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return stored_table(every.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def near_duplicates(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``doc_id, class_id`` (smallest id of the class),
    ``class_size`` and ``kept`` (the row of that id).

    Null and empty texts, and texts without words, are classes of their own.
    Rows that repeat an id are one document.  A row without an id is a class
    of its own without an id, and is kept.  An empty table gives an empty
    result.
    """
    docs = id_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    named = docs.filter("doc_id IS NOT NULL")
    signed = stored_table(sign(named, bands, rows), "signatures")
    worded = signed.filter("bands IS NOT NULL")
    nodes = stored_table(worded.groupBy("words").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    places = nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    pivot = places.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # from here on only the places in buckets of several nodes, which most buckets are not
    places = stored_table(places.join(pivot.select("bucket", "pivot"), "bucket"), "places")
    star = places.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    ids = stored_table(places.select("node").distinct().join(nodes.select("node", "bands", "sig"), "node"), "shared")
    tested = stored_table(matching(star, ids), "pairs")
    # shingle sets of all documents that share a bucket: their texts move once, to where their ids
    # (a set that grows with the input, so never broadcast) are hashed
    wanted = ids.select(F.col("node").alias("doc_id")).hint("shuffle_hash")
    sets = stored_table(shingle_sets(compressed(named).join(wanted, "doc_id", "left_semi")), "sets")
    labels = components(stored_table(verified(tested, sets, threshold), "links"))
    for best in (True, False):
        pairs = bucket_pairs(places, ids, sets, labels, best)
        pairs = stored_table(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        found = stored_table(verified(pairs, sets, threshold), "links")
        if not found.isEmpty():
            labels = extended(labels, found)
    member = worded.select("doc_id", "words").distinct().join(nodes.select("words", "node"), "words").select("doc_id", "node")
    # a repeated id whose texts differ joins their nodes
    label = member.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))
    label = label.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    every = docs.select("doc_id").join(label, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    size = every.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return every.join(size, "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
