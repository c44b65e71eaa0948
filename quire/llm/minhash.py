"""Near-duplicate documents by consistent weighted sampling.

Texts are multisets of five-word shingles with TF-IDF weights.  Improved
consistent weighted sampling draws a signature whose places agree with the
probability of the weighted Jaccard similarity; bands of it propose pairs, the
exact weighted Jaccard similarity of whole texts decides them, and classes are
the connected components of what is left.

A shingle's idf is that of its document frequency over all documents, between
the share COMMON, under which every shingle counts as rare, and a floor.  So
only shingles in at least that share of the documents need to be known, and
there are at most (shingles of a mean document) / COMMON of them.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import of_worker, scratch, short_batches, staged
from quire.llm.decontaminate import words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 5
COMMON = 0.02
IDF_FLOOR = 0.5
#: Documents that are counted together while common shingles are looked for.
CHUNK = 2048
#: Candidates for common shingles that are broadcast; more are counted by a shuffle.
CANDIDATES = 2_000_000
#: A bucket of so many texts or fewer has all its pairs compared; a larger one is joined by prefixes.
SMALL_BUCKET = 12
#: Rows of one key from which, if they are also more than 1 / HOT_KEYS of all
#: rows, they are not dealt by it.
HOT_ROWS, HOT_KEYS = 500, 100_000
#: Parts into which the pairs of one text are dealt.
SALTS = 64
#: Slots in which shingles are counted to order them; more slots, fewer pairs to compare.
SLOTS = 1 << 20
BROADCAST_IDS = 1_000_000
WORD_CACHE = 150_000

_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingle_hashes(found: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles, with repeats; fewer than five words are one shingle."""
    return next(_hashed([found]))


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += h[j : j + n] * _MULTIPLIERS[j]
    return _mixed(total)


def _hashed(lists: list[list[bytes]]) -> Iterator[np.ndarray]:
    """``shingle_hashes`` of several word lists, computed over all their words at once."""
    lengths = [len(x) for x in lists]
    word_hash = of_worker(("word hashes",), _WordHashes).__getitem__
    flat = np.fromiter(map(word_hash, chain.from_iterable(lists)), np.uint64, sum(lengths))
    whole = _windows(flat, SHINGLE) if len(flat) >= SHINGLE else None
    at = 0
    for n in lengths:
        out = whole[at : at + n - SHINGLE + 1].copy() if n >= SHINGLE else _windows(flat[at : at + n], n) if n else flat[:0]
        out.sort()
        yield out
        at += n


def shingle_lists(texts: list[str | None]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and ``shingle_hashes`` of each text, some hundred thousand words at a time."""
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        held.append(words(text))
        size += len(held[-1])
        if size >= 300_000:
            yield from zip(held, _hashed(held), strict=True)
            held, size = [], 0
    yield from zip(held, _hashed(held), strict=True)


def distinct(ordered: np.ndarray) -> np.ndarray:
    """The values of a sorted array, each once."""
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def weighted(hashes: np.ndarray, common: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: occurrences times idf (1 if not common)."""
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    shingles = hashes[first]
    weights = np.diff(first, append=len(hashes)).astype(np.float64)
    if len(common) and len(shingles):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weights *= np.where(common[at] == shingles, idf[at], 1.0)
    return shingles, weights


def idf_of(df: int, documents: int, common: float = COMMON) -> float:
    """1 for a shingle in a share of *common* of the documents, less for one in more."""
    return max(IDF_FLOOR, min(1.0, math.log(1 + documents / df) / math.log(1 + 1 / common)))


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets of shingles."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    least = np.minimum(wa[i], wb[j]).sum()
    most = wa.sum() + wb.sum() - least
    return float(least / most) if most > 0 else 0.0


def _draws() -> tuple[np.ndarray, ...]:
    """2 ** 16 draws of the scheme's variables: r and log c of Gamma(2, 1), beta of (0, 1).

    They are ordered by the value that a shingle of weight 1 gets, so that among
    such shingles the least hash, whose upper bits choose the draw, has the
    least value.
    """
    n = 1 << 16
    u = [(_mixed(np.arange(1, n + 1, dtype=np.uint64) * _MULTIPLIERS[j]) >> _U(11)).astype(np.float64) / 2.0**53 + 2.0**-54 for j in range(5)]
    r, log_c, beta = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
    order = np.argsort(log_c - r * (1 - beta), kind="stable")
    r, log_c, beta = r[order], log_c[order], beta[order]
    return r, log_c, beta, log_c - r * (1 - beta)


_R, _LOG_C, _BETA, _PLAIN_VALUE = _draws()


def _least_hashes(shingles: np.ndarray, samples: int, block: int = 2048) -> np.ndarray:
    """The least hash of *shingles* for each sample; hashes of one sample are a permutation."""
    a = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * _MULTIPLIERS[0]) | _U(1)
    b = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * _MULTIPLIERS[1])
    least = np.full(samples, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), block):
        h = np.multiply.outer(a, shingles[i : i + block])
        h += b[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least


def signature(shingles: np.ndarray, weights: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """Improved consistent weighted sampling: *samples* hashes of (shingle, level).

    A shingle's hash chooses its draw (r, c, beta) in a sample.  With weight w it
    has level t = floor(log w / r + beta) and value log c - r (t - beta) - r; the
    least value, of equal ones the least hash, is the sample.  Level 0 is all
    that weight 1 has, and its values are ordered as hashes are.
    """
    plain = weights == 1.0
    least = _least_hashes(shingles[plain], samples)
    best, level = _PLAIN_VALUE[least >> _U(48)] if plain.any() else np.full(samples, np.inf), np.zeros(samples, np.int64)
    if not plain.all():
        some, logs = shingles[~plain], np.log(weights[~plain])
        a = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * _MULTIPLIERS[0]) | _U(1)
        b = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * _MULTIPLIERS[1])
        for i in range(0, len(some), 2048):
            h = np.multiply.outer(a, some[i : i + 2048]) + b[:, None]
            draw = (h >> _U(48)).astype(np.int64)
            r, beta = _R[draw], _BETA[draw]
            t = np.floor(logs[i : i + 2048] / r + beta)
            value = _LOG_C[draw] - r * (t - beta) - r
            low = value.min(axis=1)
            at = np.where(value == low[:, None], h, _U(0xFFFFFFFFFFFFFFFF)).argmin(axis=1)
            rows = np.arange(samples)
            wins = (low < best) | ((low == best) & (h[rows, at] < least))
            best, least = np.where(wins, low, best), np.where(wins, h[rows, at], least)
            level = np.where(wins, t[rows, at].astype(np.int64), level)
    return _mixed(least + level.astype(np.uint64) * _MULTIPLIERS[4])


def bands(sample: np.ndarray) -> np.ndarray:
    """One hash for each band of the signature, different for equal samples of different bands."""
    rows = sample.reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) * _MULTIPLIERS[3]
    for j in range(ROWS):
        total = _mixed(total + rows[:, j] * _MULTIPLIERS[j])
    return total.view(np.int64)


def common_shingles(docs: DataFrame, common: float = COMMON, candidates: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, idf) of the shingles in at least a share *common* of the documents, exactly.

    A shingle that common is so in at least one chunk of documents, too; those
    candidates are then counted over all documents.
    """
    spark = docs.sparkSession
    short_batches(spark)
    documents = docs.count()
    least = max(2, math.ceil(common * documents))
    texts = docs.select("text")

    def counts(hashes: list[np.ndarray], of: np.ndarray | None = None, at_least: int = 1) -> Iterator[pa.RecordBatch]:
        if hashes:
            h, n = np.unique(np.concatenate(hashes), return_counts=True)
            h, n = h[n >= at_least], n[n >= at_least]
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))], ["h", "n"])

    def local(share: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for batch in batches:
                for _, found_here in shingle_lists(batch.column(0).to_pylist()):
                    held.append(distinct(found_here))
                    if len(held) >= CHUNK:
                        yield from counts(held, at_least=math.ceil(share * len(held)))
                        held = []
            yield from counts(held, at_least=max(1, math.ceil(share * len(held))))

        return run

    found = staged(texts.mapInArrow(local(common), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "common-candidates")
    if found.count() <= candidates:
        sought = np.sort(found.select("h").toArrow().column("h").to_numpy().view(np.uint64))
        sent = spark.sparkContext.broadcast(sought)

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for _, ordered in shingle_lists(batch.column(0).to_pylist()):
                    h = distinct(ordered)
                    at = np.searchsorted(sent.value, h)
                    at[at == len(sent.value)] = 0
                    seen[at[sent.value[at] == h]] += 1
            hit = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[hit].view(np.int64)), pa.array(seen[hit])], ["h", "n"])

        counted = texts.mapInArrow(exact, "h long, n long") if len(sought) else found.limit(0)
    else:
        counted = texts.mapInArrow(local(0.0), "h long, n long")
    rows = counted.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    hashes = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([idf_of(n, documents, common) for n in rows.column("n").to_pylist()], float)[order]


def one_row_each(docs: DataFrame) -> DataFrame:
    """*docs* with one row for each doc_id that is not null: that of the least md5 of the text, of equal ones the least as JSON."""
    twice = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    n = twice.count()
    if not n:
        return docs
    named = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.md5("text"), F.to_json(F.struct(*(c for c, name in zip(named, docs.columns, strict=True) if name != "text"))))
    first = docs.join(_sent(twice, n), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*named), order).alias("__row"))
    return docs.join(_sent(twice, n), "doc_id", "left_anti").select(*named).unionByName(first.select("__row.*"))


def signatures(docs: DataFrame, hashes: np.ndarray, idf: np.ndarray) -> DataFrame:
    """doc_id, k1, k2 (digest of the words), weight (summed), bands of each document with an id.

    A document without words has null digests.
    """
    spark = docs.sparkSession
    short_batches(spark)
    sent = spark.sparkContext.broadcast((hashes, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, weights, found, ends = [], [], [], [], [0]
            for ws, ordered in shingle_lists(batch.column(1).to_pylist()):
                if ws:
                    shingles, w = weighted(ordered, *sent.value)
                    a, b = struct.unpack("<qq", hashlib.blake2b(b" ".join(ws), digest_size=16).digest())
                    weights.append(float(w.sum()))
                    found.append(bands(signature(shingles, w)))
                else:
                    a = b = None
                    weights.append(0.0)
                k1.append(a)
                k2.append(b)
                ends.append(len(found) * BANDS)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(weights, pa.float64()), lists], ["doc_id", "k1", "k2", "weight", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, weight double, bands array<long>")


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """*rows* (*total* of them) with the row of *table* that has their *keys*.

    ``n`` of *table* says how many of *rows* have a key.  Rows of one that very
    many have stay where they are: at most HOT_KEYS rows of *table* go to them.
    """
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    large = F.broadcast(table.filter(hot))
    rest = rows.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(table.filter(~hot), keys))


def _sets(docs: DataFrame, wanted: DataFrame, hashes: np.ndarray, idf: np.ndarray) -> DataFrame:
    """(rep, s, w): shingles and weights of the documents in *wanted*, as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast((hashes, idf))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_sent(wanted, wanted.count()), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, weights = [], []
            for _, ordered in shingle_lists(batch.column(1).to_pylist()):
                h, w = weighted(ordered, *sent.value)
                sets.append(h.tobytes())
                weights.append(b"" if (w == 1.0).all() else w.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(weights, pa.binary())], ["rep", "s", "w"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, s binary, w binary")


def _load(s: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(s, "<u8")
    return h, np.frombuffer(w, "<f4").astype(np.float64) if w else np.ones(len(h))


def verify(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of which the texts' weighted Jaccard similarity is *least* or more.

    A text b that many others are compared with goes to SALTS places at most,
    and each of the others to one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = (c.to_pylist() for c in batch.columns[2:])
            sims = [similarity(*_load(sa, wa), *_load(sb, wb)) for sa, wa, sb, wb in zip(*rest, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt"))
    left = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa"), F.col("w").alias("wa"))
    right = sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"), F.col("w").alias("wb"))
    places = dealt.select("b", "salt").distinct().join(right, "b")
    both = dealt.join(left, "a").join(places, ["b", "salt"]).select("a", "b", "sa", "wa", "sb", "wb")
    return both.mapInArrow(run, "a long, b long, similarity double").filter(F.col("similarity") >= least - 1e-9)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of *edges* (a, b): the least node that each is connected with.

    Large-star and small-star steps by turns; nothing but (node, node) rows
    moves, minima are taken where rows are read first, and each round is staged.
    The edges of a node with very many stay where they are (``_joined``).
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")

    def size(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = size(now)
    while True:
        # large star: each larger neighbour is joined with the least of the neighbourhood
        sides = both(now)
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _joined(sides.filter("b > a"), least, ["a"], 2 * before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each smaller neighbour, and the node itself, with the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = staged(small.filter("a <> b").distinct(), "edges")
        after = size(now)
        if after == before:
            break
        before = after
    labels = now.groupBy("a").agg(F.min("b").alias("label"))
    roots = now.select(F.col("b").alias("node")).distinct()
    return labels.select(F.col("a").alias("node"), "label").union(roots.select("node", F.col("node").alias("label")))


def classes(docs: DataFrame, least: float = SIMILARITY, common: float = COMMON) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of each document, and what ties it.

    Documents with the same words are one text; texts are linked if their
    weighted Jaccard similarity is *least* or more, and classes are connected
    components.  A document without words (null, empty, blank) is a class of its
    own, as is a row with a null doc_id (its class_id is null).  Of rows with the
    same doc_id one counts: see ``one_row_each``.  Ids are integers; others are
    cast, which fails for those that are none.  Returns one row for each distinct
    doc_id; columns of *docs* other than doc_id and text are not read, except to
    choose among rows with the same doc_id.
    """
    short_batches(docs.sparkSession)
    docs = one_row_each(docs)
    hashes, idf = common_shingles(docs, common)
    marked = staged(signatures(docs, hashes, idf), "signatures")
    copies = marked.filter("k1 IS NOT NULL").groupBy("k1", "k2")
    texts = staged(copies.agg(F.min("doc_id").alias("rep"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")), "texts")
    with scratch(docs.sparkSession):
        labels = staged(_labels(docs, texts, hashes, idf, least), "labels", keep=True)
    named = texts.join(labels, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("label", "rep").alias("class_id"))
    with_words = _joined(marked.filter("k1 IS NOT NULL").select("doc_id", "k1", "k2"), named, ["k1", "k2"], marked.count())
    without = marked.filter("k1 IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    no_id = docs.filter("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().select("doc_id", F.col("doc_id").alias("class_id"))
    return with_words.select("doc_id", "class_id").union(without).union(no_id)


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles of *sets* fall into each of SLOTS slots, a text's shingle counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                np.add.at(seen, (np.frombuffer(s, "<u8") >> _U(20)) % _U(SLOTS), 1)
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(seen[hit])], ["slot", "n"])

    found = sets.select("s").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def _prefixes(sets: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """(h, rep, label, total, rest, short) of the shingles that may be the first that two similar texts share.

    All texts order their shingles alike, those of rarely met slots first, and
    *rest* is the weight from a shingle on.  Texts whose first common shingle it
    is share *rest* at most, and similar ones share least / (1 + least) of their
    summed weight: *least* of the heavier text's and 2 least / (1 + least) of
    the lighter one's, which is what *short* says.
    """
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    heavy, light = least - 1e-6, 2 * least / (1 + least) - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, s, w, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, weights = _load(s, w)
                met = sent.value[(h >> _U(20)) % _U(SLOTS)]
                order = np.lexsort((h, met))
                h, weights, met = h[order], weights[order], met[order]
                total = weights.sum()
                rest = np.cumsum(weights[::-1])[::-1]
                at = np.flatnonzero((rest >= heavy * total) & (met > 1))
                n = len(at)
                columns = [h[at].view(np.int64), np.full(n, rep), np.full(n, label), np.full(n, total), rest[at], rest[at] >= light * total]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "rep", "label", "total", "rest", "short"])

    return sets.select("rep", "s", "w", "label").mapInArrow(run, "h long, rep long, label long, total double, rest double, short boolean")


def _all_pairs(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of texts in *sets* (rep, s, w, label) of different labels: all similar ones, and some more.

    The label that most texts with a shingle have meets only other labels
    there (part 1 is all texts without it), so that texts of one large class are
    not compared with each other.
    """
    rows = staged(_prefixes(sets, _slot_counts(sets), least), "prefixes")
    by_label = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"))
    shared = by_label.groupBy("h").agg(F.max(F.struct("n", "label"))["label"].alias("major"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n")).filter("labels > 1")
    met = staged(_joined(rows, shared, ["h"], rows.count()).withColumn("is_major", F.col("label") == F.col("major")), "shared-prefixes")
    parts = F.when(F.col("is_major"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    x = met.filter("short").select("h", F.explode(parts).alias("part"), F.col("rep").alias("x"), F.col("label").alias("xl"), F.col("total").alias("xt"), F.col("rest").alias("xr"))
    y = met.select("h", F.when(F.col("is_major"), 0).otherwise(1).alias("part"), F.col("rep").alias("y"), F.col("label").alias("yl"), F.col("total").alias("yt"), F.col("rest").alias("yr"))
    share = F.least("xr", "yr") >= (least / (1 + least) - 1e-6) * (F.col("xt") + F.col("yt"))
    fits = share & F.expr("xl <> yl AND (xt < yt OR xt = yt AND x < y)") & (F.col("xt") >= (least - 1e-6) * F.col("yt"))
    return x.join(y, ["h", "part"]).filter(fits).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _labels(docs: DataFrame, texts: DataFrame, hashes: np.ndarray, idf: np.ndarray, least: float) -> DataFrame:
    """(node, label) of the linked *texts*: the components of all similar pairs that share a bucket.

    First each text of a bucket is compared with its most central one, that
    whose buckets hold most texts: the text that others are copies of shares
    buckets with more of them than they do, so this links most of a group.
    Texts of one bucket that are still apart
    are then compared pair by pair in a small bucket, and those of large ones
    joined by prefixes, which leaves out no similar pair.
    """
    members = texts.select("rep", "weight", F.explode("bands").alias("bucket"))
    total = texts.count() * BANDS
    sizes = staged(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    buckets = staged(_joined(members, sizes, ["bucket"], total), "buckets")
    central = buckets.groupBy("rep").agg(F.sum("n").alias("met"))
    chosen = F.max(F.struct("met", (-F.col("rep")).alias("r"), "weight")).alias("p")
    heads = buckets.join(central, "rep").groupBy("bucket").agg(F.first("n").alias("n"), chosen)
    heads = staged(heads.select("bucket", "n", (-F.col("p.r")).alias("pivot"), F.col("p.weight").alias("w2")), "heads")
    fits = lambda a, b: F.least(a, b) >= (least - 1e-9) * F.greatest(a, b)
    both = lambda p: p.select(F.col("a").alias("doc_id")).union(p.select("b")).distinct()

    met = _joined(buckets.drop("n"), heads, ["bucket"], total).filter((F.col("rep") != F.col("pivot")) & fits("weight", "w2"))
    pairs = staged(met.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    sets = staged(_sets(docs, both(pairs), hashes, idf), "sets")
    found = staged(components(verify(pairs, sets, least).select("a", "b")), "labels")

    labelled = buckets.join(found, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = staged(labelled.select("bucket", "n", "rep", "weight", "label"), "labelled")
    few, many = labelled.filter(F.col("n") <= SMALL_BUCKET), labelled.filter(F.col("n") > SMALL_BUCKET)
    other = few.select("bucket", F.col("rep").alias("rep2"), F.col("weight").alias("w2"), F.col("label").alias("label2"))
    near = few.join(other, "bucket").filter(F.expr("rep > rep2 AND label <> label2") & fits("weight", "w2"))
    near = staged(near.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct(), "near")
    apart = many.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("n").alias("n")).filter("lo < hi").select("bucket", "n")
    left = staged(_joined(many.select("bucket", "rep", "label"), staged(apart, "apart"), ["bucket"], total).select("rep", "label").distinct(), "left")

    lacking = both(near).union(left.select("rep")).distinct().join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    sets = sets.union(staged(_sets(docs, staged(lacking, "lacking"), hashes, idf), "sets"))
    done = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = near.union(_all_pairs(sets.join(left, "rep"), least)).distinct().join(done, ["a", "b"], "left_anti")
    links = verify(staged(more, "pairs"), sets, least).select("a", "b")
    return components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))


def kept(docs: DataFrame, least: float = SIMILARITY, common: float = COMMON) -> DataFrame:
    """One document of each class, that of the least doc_id, with the columns of *docs*.

    Rows with a null doc_id stay; of rows with the same doc_id one stays.
    """
    rows = one_row_each(docs)
    with scratch(docs.sparkSession):
        gone = staged(classes(rows, least, common).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")), "gone", keep=True)
    return rows.join(_sent(gone, gone.count()), F.col("doc_id") == F.col("__gone"), "left_anti")
