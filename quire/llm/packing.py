"""Packing of documents into fixed-length sequences by sums of squares.

Documents are encoded where they are read; only their pieces' lengths are
shuffled.  Each task packs a share of the pieces: a piece goes to the open bin
(or a new one) after which the squared counts of open bins, summed over the
residual gaps, are smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import bpe
from quire.llm.common import short_batches, staged

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs, about.
SHARE = 400_000
#: Bits of sequence_id that number a task's sequences.
SEQUENCE_BITS = 40

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of *n* ids: full ones, after a shorter first piece if need be."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = bpe.TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece (and its ``ids``).

    A null or empty text is its end id alone; a text longer than *capacity* is
    cut.  Repeated rows give repeated pieces; further columns are left out.  Ids
    are integers; others are cast, which fails for those that are none.
    """
    short_batches(docs.sparkSession)
    schema = _PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(enc.encode(text), enc.dtype.type(end_id)).astype("<u4")
                at = 0
                for k, n in enumerate(cut(len(ids), capacity)):
                    part = ids[at : at + n]
                    for column, value in zip(out, (doc_id, k, at, n, zlib.crc32(part)), strict=False):
                        column.append(value)
                    if with_ids:
                        out[5].append(part.astype(np.int32))
                    at += n
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            if with_ids:
                arrays.append(pa.array(out[5], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin number, offset) of each length, placed in the order given."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, n in enumerate(lengths.tolist()):
        if n >= capacity:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        gaps = count[n:capacity]
        fits = np.flatnonzero(gaps)
        best, gain = capacity, 2 * count[capacity - n] + 1  # a new bin
        if len(fits):
            change = 2 * (count[fits] - gaps[fits]) + 2
            if fits[0] == 0:  # a gap of n is filled; count[0] is of no account
                change[0] = 1 - 2 * gaps[0]
            k = int(change.argmin())
            if change[k] <= gain:
                best = n + int(fits[k])
        if best == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[best].pop()
            count[best] -= 1
        bins[i], offsets[i] = b, capacity - best
        if best > n:
            open_bins[best - n].append(b)
            count[best - n] += 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """*parts*, with sequence_id and offset.

    Pieces are staged and dealt by a hash of their row number to tasks of about
    *share* pieces, and each task packs its own by decreasing length (then
    doc_id, piece and row number), so a lost task is redone alike.  An empty
    table gives no rows; equal rows, and those without an id, are packed apart.
    """
    rows = staged(parts, "pieces")
    tasks = max(1, -(-rows.count() // share))
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = numbered.repartition(tasks, F.xxhash64("__row")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "__row").select(*rows.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        bins, offsets = sum_of_squares(rows.column("length").to_numpy(), capacity)
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        yield from rows.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets)).combine_chunks().to_batches(10_000)

    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(pieces(docs, capacity), capacity)
