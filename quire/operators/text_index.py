"""An index of texts by trigrams and grams: searches that read the postings of a phrase's rarest ones instead of all texts.

A trigram is three code points of the lower-cased text as one number.  A gram is
the least hash of GRAM code points among WINDOW that follow each other, as a
negative number: all texts that have a phrase of GRAM + WINDOW - 1 code points
have its grams, which are much rarer than its trigrams.  Texts are
numbered in blocks of PLACES.  Postings are a block's places in ascending order,
their differences in as few bytes as they need, in a Parquet table sorted by
trigram within each block, so that a filter on trigrams skips what it does not
want.  A search meets each block once, with all phrases: postings become bits,
one for each place, and only texts whose bits of a phrase are all set are
compared with it, exactly.  No row stands for a phrase and a text but the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.staging import spread, staged

#: Pairs of trigram or gram and text that a task gathers before it writes postings.
HELD = 4_000_000
#: Trigrams and grams of a phrase that are looked up, the rarest ones.
LOOKED_UP = 4
#: Trigrams that are sent to all tasks as a filter; more are joined.
SENT = 200_000
#: Code points of a gram, places that one is chosen from, and the hashes that there are.
GRAM, WINDOW, GRAMS = 10, 11, 1 << 18
#: Texts of a block, a power of two and a multiple of 64.
PLACES = 4096
#: Phrases, and bytes of them, that a task holds; for more, all blocks are met again.
PHRASES, PHRASE_BYTES = 1 << 19, 64 << 20


@dataclass
class TextIndex:
    """A written index: ``postings`` (block, tri, n, places) and ``texts`` (block, place, id, text) below its folder."""

    spark: SparkSession
    path: str

    def texts(self) -> DataFrame:
        return self.spark.read.schema("block long, place int, id long, text string").parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("block long, tri long, n int, places binary").parquet(f"{self.path}/postings")


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, ascending; of fewer than three code points there is none."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint32(0x9E3779B1)) ^ (b + (a >> np.uint32(15)))
    x *= np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(13))


def grams(text: str) -> np.ndarray:
    """The distinct grams of a text, as numbers below 0; a text shorter than a window has none."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(c) < GRAM + WINDOW - 1:
        return np.zeros(0, np.int64)
    two = _mixed(c[:-1], c[1:])
    four = _mixed(two[:-2], two[2:])
    eight = _mixed(four[:-4], four[4:])
    low = _mixed(eight[:-2], two[8:]) % np.uint32(GRAMS)
    n = 1
    while 2 * n <= WINDOW:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    low = np.minimum(low[: len(low) - (WINDOW - n)], low[WINDOW - n :])
    return -1 - np.unique(low[np.append(True, low[1:] != low[:-1])]).astype(np.int64)


def keys(text: str) -> np.ndarray:
    """What a text is found by: its trigrams and grams."""
    return np.concatenate([trigrams(text), grams(text)])


def packed(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of ascending ids in lists that begin at *starts*: differences, seven bits a byte, the last below 128."""
    gaps = np.diff(ids, prepend=0)
    gaps[starts] = ids[starts]
    # ids may be negative: a first one is written with its sign as the lowest bit
    gaps = np.where(gaps < 0, (-gaps << 1) - 1, gaps << 1)
    sizes = np.ones(len(gaps), np.int64)
    for b in range(1, 10):
        sizes += gaps >> (7 * b) > 0
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    at = ends - sizes
    for b in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > b
        out[at[has] + b] = (gaps[has] >> (7 * b) & 127) | np.where(sizes[has] > b + 1, 128, 0)
    return out, ends


def unpacked(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of lists of *counts* that ``packed`` wrote one after another."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    gaps = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first) if len(first) else np.zeros(0, np.int64)
    gaps = np.where(gaps & 1, -(gaps + 1 >> 1), gaps >> 1)
    total = np.cumsum(gaps)
    starts = np.cumsum(counts) - counts
    return total - np.repeat(total[starts] - gaps[starts], counts)


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> TextIndex:
    """Write the index of *docs* below *path*.

    Ids are integers.  Null texts and null ids are not in it, and rows with the
    same id are one document of which any may match.  Nothing is shuffled: each
    task writes the postings of the texts it reads.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    at = F.col("at")
    numbered = rows.withColumn("at", F.monotonically_increasing_id())
    numbered = numbered.select(F.shiftright(at, PLACES.bit_length() - 1).alias("block"), at.bitwiseAND(PLACES - 1).cast("int").alias("place"), "id", "text")
    index = TextIndex(docs.sparkSession, path)
    numbered.write.mode("overwrite").parquet(f"{path}/texts", compression="zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, block = 0, None
        for batch in batches:
            for of, place, lowered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (of != block or size >= HELD):
                    yield _postings(block, held)
                    held, size = [], 0
                block, found = of, keys(lowered)
                held.append((found, np.full(len(found), place, np.int64)))
                size += len(found)
        if held:
            yield _postings(block, held)

    made = index.texts().select("block", "place", F.lower("text").alias("text")).mapInArrow(run, "block long, tri long, n int, places binary")
    made.write.mode("overwrite").parquet(f"{path}/postings", compression="zstd")
    return index


def _postings(block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    tri, places = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(tri, kind="stable")  # places ascend already
    tri, places = tri[order], places[order]
    starts = np.flatnonzero(np.append(True, tri[1:] != tri[:-1])) if len(tri) else np.zeros(0, np.int64)
    data, ends = packed(places, starts)
    counts = np.diff(starts, append=len(tri))
    offsets = np.concatenate([[0], ends[starts + counts - 1]]).astype(np.int32) if len(starts) else np.zeros(1, np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    blocks = pa.array(np.full(len(starts), block, np.int64))
    return pa.RecordBatch.from_arrays([blocks, pa.array(tri[starts]), pa.array(counts.astype(np.int32)), lists], ["block", "tri", "n", "places"])


def search(index: TextIndex, phrases: DataFrame, looked_up: int = LOOKED_UP) -> DataFrame:
    """phrase_id, id of all texts that have a phrase (phrase_id, phrase), in any case.

    Only postings of trigrams and grams of the phrases are read, of each phrase
    those of its *looked_up* rarest ones, and only texts that have them all are compared.
    An empty or null phrase finds nothing; one of one or two code points has no
    trigram, and for such phrases all texts are read once.
    """
    asked = phrases.select("phrase_id", F.lower("phrase").alias("phrase")).filter("length(phrase) > 0")
    # equal phrases are one
    asked = staged(asked.distinct(), "asked")
    texts, postings = index.texts(), index.postings()
    short = asked.filter("length(phrase) < 3")
    long = staged(asked.filter("length(phrase) >= 3").select("phrase").distinct().withColumn("of", F.monotonically_increasing_id()), "phrases")
    held = long.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    chunks = max(1, -(-held[0] // PHRASES), -(-held[1] // PHRASE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = keys(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(found), i))), pa.array(found)], ["of", "tri"])

    wanted = staged(long.select("of", "phrase").mapInArrow(run, "of long, tri long"), "wanted")
    sizes = staged(_of(postings, wanted.select("tri").distinct()).groupBy("tri").agg(F.sum("n").cast("long").alias("n")), "sizes")
    rank = F.row_number().over(Window.partitionBy("of").orderBy("n", "tri"))
    # a phrase of which no text has some trigram is nowhere
    known = wanted.join(sizes, "tri", "left").withColumn("all", F.count("n").over(Window.partitionBy("of")) == F.count(F.lit(1)).over(Window.partitionBy("of")))
    chunk = F.pmod(F.xxhash64("of"), F.lit(chunks)).cast("int").alias("chunk")
    rarest = staged(known.filter("all").withColumn("r", rank).filter(F.col("r") <= looked_up).select("of", "tri", chunk), "rarest")
    compared = _compared(texts, postings, long, rarest, chunks)
    found = compared.join(long.join(asked, "phrase").select("of", "phrase_id"), "of").select("phrase_id", "id")
    if not short.isEmpty():
        found = found.union(texts.join(F.broadcast(short), F.contains(F.lower("text"), F.col("phrase"))).select("phrase_id", "id"))
    # a pair can be there twice only if an id is
    twice = [df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1") for df, c in ((asked, "phrase_id"), (texts, "id"))]
    return found if all(df.isEmpty() for df in twice) else found.distinct()


def _compared(texts: DataFrame, postings: DataFrame, phrases: DataFrame, rarest: DataFrame, chunks: int) -> DataFrame:
    """(of, id): the *texts* that have the *phrases* (of, phrase), by the trigrams in *rarest* (of, tri, chunk).

    Blocks are dealt to as many parts as there are shuffle partitions, and each
    part gets a chunk's phrases once, then its blocks one after another: their
    postings, then their texts.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
    tris = rarest.groupBy("of", "chunk").agg(F.collect_list("tri").alias("tris"))
    none = lambda kind: F.lit(None).cast(kind)
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asked = tris.join(phrases, "of").select("chunk", every, F.lit(-1).cast("long").alias("block"), F.lit(0).alias("kind"), F.col("of").alias("number"), F.col("phrase").cast("binary").alias("data"), "tris", none("int").alias("at"))
    wanted = rarest.select("tri", "chunk").distinct()
    listed = _of(postings, wanted.select("tri").distinct())
    listed = listed.withColumn("chunk", F.lit(0)) if chunks == 1 else listed.join(wanted, "tri")
    listed = listed.select("chunk", part, "block", F.lit(1).alias("kind"), F.col("tri").alias("number"), F.col("places").alias("data"), none("array<long>").alias("tris"), F.col("n").alias("at"))
    to = F.lit(0) if chunks == 1 else F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    read = texts.select(to.alias("chunk"), part, "block", F.lit(2).alias("kind"), F.col("id").alias("number"), F.lower("text").cast("binary").alias("data"), none("array<long>").alias("tris"), F.col("place").alias("at"))
    dealt = spread(asked.unionByName(listed).unionByName(read), "chunk", "part").sortWithinPartitions("chunk", "part", "block", "kind", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(rows, lambda r: r[:2]):
            some: _Phrases | None = None
            for (block, kind), of in groupby(group, lambda r: r[2:4]):
                if kind == 0:
                    some = _Phrases([(r[4], r[5], r[6]) for r in of])
                elif some is None:
                    break
                elif kind == 1:
                    some.meet(block, of)
                elif some.block == block:
                    for word, members in groupby(of, lambda r: r[7] // 64):
                        found, ids = some.within([(r[7] % 64, r[4], r[5]) for r in members], word)
                        if len(found):
                            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids, pa.int64())], ["of", "id"])

    return dealt.mapInArrow(run, "of long, id long")


class _Phrases:
    """Phrases (number, bytes, trigrams), and the bits of the block that they met last."""

    def __init__(self, rows: list[tuple]):
        self.numbers, self.phrases = [r[0] for r in rows], [r[1] for r in rows]
        self.tris = np.unique(np.concatenate([np.array(r[2], np.int64) for r in rows]))
        # of a phrase with fewer trigrams the last one stands for those that it lacks
        width = max(len(r[2]) for r in rows)
        self.of = np.searchsorted(self.tris, np.array([r[2] + r[2][-1:] * (width - len(r[2])) for r in rows], np.int64))
        self.block = None

    def meet(self, block: int, rows: Iterator[tuple]) -> None:
        """Take the postings of a block; a trigram may have several."""
        numbers, data, counts = zip(*((r[4], r[5], r[7]) for r in rows), strict=True)
        counts = np.array(counts, np.int64)
        own, row = np.unique(np.array(numbers, np.int64), return_inverse=True)
        places = unpacked(np.frombuffer(b"".join(data), np.uint8), counts)
        flags = np.zeros((len(own), PLACES // 8), np.uint8)
        np.bitwise_or.at(flags, (np.repeat(row, counts), places >> 3), np.uint8(1) << (places & 7).astype(np.uint8))
        # a line for each 64 places, so that phrases are looked up in a short one
        self.bits = np.ascontiguousarray(flags.view("<u8").T)
        at = np.full(len(self.tris), -1)
        at[np.searchsorted(self.tris, own)] = np.arange(len(own))
        lines = at[self.of]
        self.here = np.flatnonzero((lines >= 0).all(axis=1))
        self.lines = np.ascontiguousarray(lines[self.here].T)
        self.block = block

    def within(self, texts: list[tuple], word: int) -> tuple[list[int], list[int]]:
        """(numbers of phrases, ids) of (place, id, bytes) of the block's *word*-th 64 texts."""
        bits = self.bits[word]
        shared = bits[self.lines[0]]
        for line in self.lines[1:]:
            shared &= bits[line]
        hit = np.flatnonzero(shared)
        of, place = np.nonzero(np.unpackbits(shared[hit].view(np.uint8), bitorder="little").reshape(-1, 64))
        by_place = {p: (i, data) for p, i, data in texts}
        found, ids = [], []
        for h, p in zip(self.here[hit[of]].tolist(), place.tolist(), strict=True):
            i, data = by_place[p]
            if self.phrases[h] in data:
                found.append(self.numbers[h])
                ids.append(i)
        return found, ids


def _of(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """The postings of the trigrams in *wanted* (tri): few are a filter that the scan skips by, more a join."""
    rows = wanted.limit(SENT + 1).collect()
    if len(rows) > SENT:
        return postings.join(wanted, "tri", "left_semi")
    return postings.filter(F.col("tri").isin([r["tri"] for r in rows])) if rows else postings.limit(0)
