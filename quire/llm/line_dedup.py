"""Line dedup that can be undone, with sharded cuckoo filters.

An index holds an exact reference count for each line key, the number of
documents with it, dealt to shards by the key; and for each shard a cuckoo
filter of the keys in enough documents to be dropped.  Inserting or deleting
documents adds to or takes from the counts, and keys that cross the threshold
enter or leave their shard's filter, so a deletion brings lines back.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import append_columns, field, short_batches, staged

LEAST_DOCUMENTS = 10
LEAST_POINTS = 1
#: Keys of one shard, about.
SHARD_KEYS = 1_000_000
#: Largest table of dropped keys (16 bytes each, with their filters) that is
#: broadcast; a larger one is joined.
BROADCAST_KEYS = 2_000_000
#: Keys that a task counts before it passes them on.
HELD_KEYS = 200_000

_SPACE = b" \t\n\v\f\r"


def keys(text: str | None) -> list[bytes]:
    """The key of each line: stripped, with A-Z in lower case."""
    return [line.strip(_SPACE).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _points(key: bytes) -> int:
    return sum(b & 0xC0 != 0x80 for b in key)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each in one of two buckets.

    A key is given by two 64-bit halves of its digest.  Keys may be inserted
    and deleted; ``contains`` never denies a key that is there.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 1):
        need = max(1, int(capacity / (self.SLOTS * 0.85)) + 1)
        self.mask = (1 << (need - 1).bit_length()) - 1
        self.table = np.zeros((self.mask + 1, self.SLOTS), np.uint16)
        self.n = 0

    @staticmethod
    def _print(k2: int) -> int:
        return (k2 & 0xFFFF) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 & 0xFFFFFFFF)) & self.mask

    def _places(self, k1: int, k2: int) -> tuple[int, int, int]:
        mark, bucket = self._print(k2), k1 & self.mask
        return mark, bucket, self._other(bucket, mark)

    def insert(self, k1: int, k2: int) -> bool:
        """False if the filter is too full; it is then as before."""
        mark, a, b = self._places(k1, k2)
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                self.n += 1
                return True
        path, bucket = [], b
        for i in range(self.KICKS):
            slot = (i + mark) % self.SLOTS
            path.append((bucket, slot, int(self.table[bucket, slot])))
            self.table[bucket, slot], mark = mark, path[-1][2]
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                self.n += 1
                return True
        for bucket, slot, old in reversed(path):
            self.table[bucket, slot] = old
        return False

    def delete(self, k1: int, k2: int) -> bool:
        """Take out a key that was inserted; False if its fingerprint is missing."""
        mark, a, b = self._places(k1, k2)
        for bucket in (a, b):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                self.n -= 1
                return True
        return False

    def contains(self, k1: int, k2: int) -> bool:
        mark, a, b = self._places(k1, k2)
        return mark in self.table[a] or mark in self.table[b]

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls()
        out.table = np.frombuffer(data, "<u2").reshape(-1, cls.SLOTS).copy()
        out.mask, out.n = len(out.table) - 1, int((out.table != 0).sum())
        return out

    @classmethod
    def of(cls, pairs: list[tuple[int, int]]) -> CuckooFilter:
        capacity = max(16, len(pairs))
        while True:
            out = cls(capacity)
            if all(out.insert(a, b) for a, b in pairs):
                return out
            capacity *= 2


def _halves(d: bytes) -> tuple[int, int]:
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


@dataclass
class LineIndex:
    """counts: (shard, k1, k2, n); filters: (shard, filter); both staged tables."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    least: int = LEAST_DOCUMENTS


def key_counts(docs: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """k1, k2, n: the documents that hold each key; summed where they are read first.

    Keys are digests of 128 bits.  A null text has one empty line, whose key is
    too short to count.
    """
    short_batches(docs.sparkSession)

    def out(seen: Counter) -> pa.RecordBatch:
        both = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(list(seen.values()), pa.int64())], ["k1", "k2", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(digest(k) for k in set(keys(text)) if len(k) >= least_points and (least_points <= 1 or _points(k) >= least_points))
            if len(seen) >= HELD_KEYS:
                yield out(seen)
                seen = Counter()
        if seen:
            yield out(seen)

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, least: int = LEAST_DOCUMENTS, least_points: int = LEAST_POINTS) -> LineIndex:
    """The index of *docs*; that of an empty table is empty."""
    counted = staged(key_counts(docs, least_points), "line-counts")
    shards = max(4, -(-counted.count() // SHARD_KEYS))
    placed = counted.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
    return LineIndex(placed, _filters(placed.filter(F.col("n") >= least), shards), shards, least)


def _filters(hot: DataFrame, shards: int) -> DataFrame:
    def make(key, rows):
        pairs = list(zip(rows["k1"].to_pylist(), rows["k2"].to_pylist(), strict=True))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([CuckooFilter.of(pairs).to_bytes()], pa.binary())})

    return staged(hot.groupBy("shard").applyInArrow(make, "shard int, filter binary"), "line-filters")


def _fitting(index: LineIndex) -> LineIndex:
    """The index, dealt anew if its shards hold twice as many keys as they should or more."""
    shards = max(4, -(-index.counts.count() // SHARD_KEYS))
    if shards < 2 * index.shards:
        return index
    counts = index.counts.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
    return LineIndex(counts, _filters(counts.filter(F.col("n") >= index.least), shards), shards, index.least)


def _changed(index: LineIndex, docs: DataFrame, sign: int, least_points: int) -> LineIndex:
    delta = key_counts(docs, least_points).select("k1", "k2", (F.col("n") * sign).alias("n"), F.pmod("k1", F.lit(index.shards)).cast("int").alias("shard"))
    marked = index.counts.select("shard", "k1", "k2", "n", F.col("n").alias("before")).unionByName(delta.select("shard", "k1", "k2", "n", F.lit(0).cast("long").alias("before")))
    merged = staged(marked.groupBy("shard", "k1", "k2").agg(F.sum("n").alias("n"), F.sum("before").alias("before")), "line-counts")
    least = index.least
    crossed = merged.filter((F.col("n") >= least) != (F.col("before") >= least)).select("shard", "k1", "k2", (F.col("n") >= least).alias("enters"))

    def make(key, old, rows):
        found = CuckooFilter.from_bytes(old["filter"][0].as_py()) if old.num_rows else CuckooFilter(max(16, rows.num_rows))
        full = False
        for a, b, enters in sorted(zip(rows["k1"].to_pylist(), rows["k2"].to_pylist(), rows["enters"].to_pylist(), strict=True), key=lambda r: r[2]):
            full = full or not (found.insert(a, b) if enters else found.delete(a, b))
        shard = (key[0] if not hasattr(key[0], "as_py") else key[0].as_py())
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([None if full else found.to_bytes()], pa.binary())})

    merged_filters = staged(
        index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(make, "shard int, filter binary"), "line-filters"
    )
    counts = merged.filter("n > 0").select("k1", "k2", "n", "shard")
    if merged_filters.filter("filter IS NULL").limit(1).count():  # a filter ran over: make all anew
        merged_filters = _filters(counts.filter(F.col("n") >= least), index.shards)
    return _fitting(LineIndex(counts, merged_filters, index.shards, least))


def insert(index: LineIndex, docs: DataFrame, least_points: int = LEAST_POINTS) -> LineIndex:
    """The index with the lines of more documents."""
    return _changed(index, docs, 1, least_points)


def delete(index: LineIndex, docs: DataFrame, least_points: int = LEAST_POINTS) -> LineIndex:
    """The index without the lines of documents that were inserted before."""
    return _changed(index, docs, -1, least_points)


_FIELDS = [field("text", T.StringType()), field("n_lines", T.LongType()), field("n_dropped", T.LongType())]


def apply(index: LineIndex, docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """*docs* with dropped lines gone from ``text``, n_lines (before) and n_dropped.

    A line goes from every document if its key is in ``index.least`` documents
    or more.  Filters screen the lines; the exact counts confirm those that
    pass.  A null or empty text has one line and becomes the empty text.
    Repeated rows count and stay as documents of their own; columns named
    n_lines or n_dropped are replaced, and doc_id is not read.  More than
    *broadcast_keys* dropped keys are joined with the lines, to the same result.
    """
    hot = index.counts.filter(F.col("n") >= index.least).select("shard", "k1", "k2")
    spark = docs.sparkSession
    if hot.count() > broadcast_keys:
        return _apply_joined(hot, docs)
    packed = np.array([(r["k1"], r["k2"]) for r in hot.toLocalIterator()], "<i8").tobytes()
    filters = {r["shard"]: r["filter"] for r in index.filters.toLocalIterator()}
    sent, shards = spark.sparkContext.broadcast((packed, filters)), index.shards

    def make():
        exact = {packed_keys[i : i + 16] for packed_keys in (sent.value[0],) for i in range(0, len(packed_keys), 16)}
        screens = {k: CuckooFilter.from_bytes(v) for k, v in sent.value[1].items()}

        def dropped(key: bytes) -> bool:
            if not key:
                return False
            d = digest(key)
            k1, k2 = _halves(d)
            screen = screens.get(k1 % shards)
            return screen is not None and screen.contains(k1, k2) and d in exact

        def compute(texts):
            kept, n_lines, n_dropped = [], [], []
            for text in texts:
                lines = (text or "").split("\n")
                stay = [line for line, key in zip(lines, keys(text), strict=True) if not dropped(key)]
                kept.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            return kept, n_lines, n_dropped

        return compute

    return append_columns(docs, ["text"], make, _FIELDS).select(*_order(docs))


def _order(docs: DataFrame) -> list:
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return [*names, "n_lines", "n_dropped"]


def _free(df: DataFrame, name: str) -> str:
    """*name*, with as many underscores as make it no column of *df*."""
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _apply_joined(hot: DataFrame, docs: DataFrame) -> DataFrame:
    """``apply`` where the dropped keys are too many to broadcast: lines are joined with them by key.

    What is found for a text holds for all rows with it, so rows are known by
    the digest of their text.
    """
    short_batches(docs.sparkSession)
    mark, places = _free(docs, "text_digest"), _free(docs, "dropped_places")
    named = docs.withColumn(mark, F.md5(F.coalesce("text", F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, at, digests = [], [], []
            for m, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, key in enumerate(keys(text)):
                    if key:
                        marks.append(m), at.append(i), digests.append(digest(key))
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(at, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["m", "place", "k1", "k2"])

    lines = named.select(F.col(mark).alias("m"), "text").mapInArrow(run, "m string, place int, k1 long, k2 long")
    hits = lines.join(hot.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy(F.col("m").alias(mark)).agg(F.collect_set("place").alias(places))
    joined = named.join(hits, mark, "left")

    def make():
        def compute(texts, dropped):
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(texts, dropped, strict=True):
                lines, gone = (text or "").split("\n"), set(gone or ())
                kept.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            return kept, n_lines, n_dropped

        return compute

    return append_columns(joined, ["text", places], make, _FIELDS).select(*_order(docs))


#: The query on ``documents``, for DuckDB.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), x AS (
  SELECT doc_id, rid, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM l, generate_series(1, len(lines)) AS s(i)
), hot AS (
  SELECT k FROM x WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot.k IS NULL), '')) AS kept_sha256
FROM x LEFT JOIN hot USING (k) GROUP BY doc_id, rid
"""
