"""Token-id files as wavelet matrices, one compressed file for each shard.

A shard holds the ids of consecutive documents.  Its ids are numbered by their
rank among the shard's distinct ids; bit-planes of these numbers, from the
highest, are stored with each level stably parted by its bit.  With counts of
ones by block, access, counting and occurrence lookup need no decoding of the
whole shard: sections are decompressed when a query touches them, planes block
by block.

Shard file, little-endian: ``QWM2``; uint32 header length; header as JSON with
n_tokens, n_docs, levels, zeros (by level) and the byte length of each part of
each section; then the sections: alphabet (uint32), doc_ids (int64), which of
them are known (bits), doc_starts (int64, one more than documents; all before
the shard not counted), then for each level the plane (bits, lowest first) and
ranks (uint32, ones before each block of 512 bits).  A part is PART bytes of a
section (the last one: the rest), compressed by itself (zstd).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import bpe
from quire.llm.common import short_batches, staged

MAGIC = b"QWM2"
BLOCK = 512
#: Bytes of a section that are compressed together; blocks lie within a part.
PART = 1 << 14
#: Numbers that are parted at a time, so that their places stay in the processor's cache.
RUN = 1 << 16
END_ID = 2
#: A shard is closed once it has so many ids; documents are never split.
SHARD_TOKENS = 1 << 20


class WaveletMatrix:
    """Bit-planes of a sequence of numbers below 2 ** levels."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, numbers: np.ndarray, levels: int) -> WaveletMatrix:
        n, planes, zeros, ranks = len(numbers), [], [], []
        for level in range(levels - 1, -1, -1):
            ones = (numbers & numbers.dtype.type(1 << level)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            ranks.append(_ranks(planes[-1], n))
            zeros.append(n - int(np.count_nonzero(ones)))
            parted, a, b = np.empty_like(numbers), 0, zeros[-1]
            for i in range(0, n, RUN):
                run, bits = numbers[i : i + RUN], ones[i : i + RUN]
                low, high = np.flatnonzero(~bits), np.flatnonzero(bits)
                parted[a : a + len(low)] = run.take(low)
                parted[b : b + len(high)] = run.take(high)
                a, b = a + len(low), b + len(high)
            numbers = parted
        return cls(n, planes, zeros, ranks)

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block = i // BLOCK
        a = block * BLOCK // 8
        whole, bits = divmod(i - block * BLOCK, 8)
        count = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][a : a + whole]).sum())
        return count + (int(self.planes[k][a + whole]) & ((1 << bits) - 1)).bit_count() if bits else count

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit = int(self.planes[k][i // 8]) >> (i % 8) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the *value*s among places lo to hi stand below the last plane."""
        for k in range(len(self.planes)):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if value >> (len(self.planes) - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often *value* stands at places lo to hi (hi not counted)."""
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k."""
        ones = self.ranks[k][:]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, j, side="right")) - 1
        a = block * BLOCK // 8
        bits = np.unpackbits(self.planes[k][a : a + BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[block])])

    def select(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) *value*."""
        lo, hi = self._range(value, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for k in range(len(self.planes) - 1, -1, -1):
            if value >> (len(self.planes) - 1 - k) & 1:
                i = self._select_bit(k, 1, i - self.zeros[k])
            else:
                i = self._select_bit(k, 0, i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All numbers, by undoing the partings from the last level up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k][:], count=self.n, bitorder="little").view(bool)
            out[self.zeros[k] :] |= kind(1 << (len(self.planes) - 1 - k))
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = out[: self.zeros[k]]
            above[np.flatnonzero(ones)] = out[self.zeros[k] :]
            out = above
        return out


def _ranks(plane: np.ndarray, n: int) -> np.ndarray:
    blocks = n // BLOCK + 1
    padded = np.zeros(blocks * BLOCK // 8, np.uint8)
    padded[: len(plane)] = plane
    ones = np.bitwise_count(padded.view(np.uint64)).reshape(blocks, -1).sum(1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones[:-1], dtype=np.uint32)])


def write_shard(doc_ids: list, ids: list[bytes], dtype: np.dtype) -> bytes:
    """A shard file of documents' ids, given as bytes."""
    tokens = np.frombuffer(b"".join(ids), dtype)
    seen = np.zeros(int(tokens.max()) + 1 if len(tokens) else 0, bool)
    seen[tokens] = True
    alphabet = np.flatnonzero(seen).astype("<u4")
    levels = max(1, (max(1, len(alphabet)) - 1).bit_length())
    rank = np.zeros(len(seen), np.uint16 if levels <= 16 else np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    matrix = WaveletMatrix.build(rank[tokens], levels)
    starts = np.concatenate([[0], np.cumsum([len(x) // dtype.itemsize for x in ids])]).astype("<i8")
    known = np.array([d is not None for d in doc_ids], bool)
    sections = [alphabet, np.array([d or 0 for d in doc_ids], "<i8"), np.packbits(known), starts]
    for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
        sections += [plane, ranks.astype("<u4")]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    packed = []
    for x in sections:
        data = memoryview(x.tobytes())
        packed.append([squeeze(data[i : i + PART]) for i in range(0, len(data), PART)])
    head = {"n_tokens": len(tokens), "n_docs": len(doc_ids), "levels": levels, "zeros": matrix.zeros, "sections": [[len(p) for p in parts] for parts in packed]}
    header = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *(p for parts in packed for p in parts)])


class _Section:
    """A section's items; its parts are decompressed when they are read first, and kept."""

    def __init__(self, data: memoryview, at: int, sizes: list[int], kind: str):
        self.data, self.kind = data, np.dtype(kind)
        self.bounds = [at, *(at + n for n in accumulate(sizes))]
        self.parts: dict[int, np.ndarray] = {}
        self.per_part = PART // self.kind.itemsize

    def _part(self, j: int) -> np.ndarray:
        found = self.parts.get(j)
        if found is None:
            packed = self.data[self.bounds[j] : self.bounds[j + 1]]
            found = self.parts[j] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), self.kind)
        return found

    def __getitem__(self, key: int | slice) -> np.integer | np.ndarray:
        if not isinstance(key, slice):
            return self._part(key // self.per_part)[key % self.per_part]
        last = len(self.bounds) - 1
        stop = last * self.per_part if key.stop is None else key.stop
        first = (key.start or 0) // self.per_part
        found = [self._part(j) for j in range(first, min(last, -(-stop // self.per_part)))]
        if not found:
            return np.zeros(0, self.kind)
        joined = found[0] if len(found) == 1 else np.concatenate(found)
        return joined[(key.start or 0) - first * self.per_part : stop - first * self.per_part]


class Shard:
    """Reads one shard file: tokens by place, counts, occurrences, documents."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack_from("<I", data, 4)
        head = json.loads(data[8 : 8 + size])
        at, view = 8 + size, memoryview(data)
        self.sections: list[_Section] = []
        for i, sizes in enumerate(head["sections"]):
            kind = ("<u4", "<i8", "u1", "<i8")[i] if i < 4 else ("u1", "<u4")[i % 2]
            self.sections.append(_Section(view, at, sizes, kind))
            at += sum(sizes)
        self.n_docs = head["n_docs"]
        self.matrix = WaveletMatrix(head["n_tokens"], self.sections[4::2], head["zeros"], self.sections[5::2])

    @cached_property
    def alphabet(self) -> np.ndarray:
        return self.sections[0][:]

    @cached_property
    def doc_ids(self) -> list[int | None]:
        known = np.unpackbits(self.sections[2][:], count=self.n_docs).astype(bool)
        return [int(d) if k else None for d, k in zip(self.sections[1][:], known, strict=True)]

    @cached_property
    def doc_starts(self) -> np.ndarray:
        return self.sections[3][:]

    def __len__(self) -> int:
        return self.matrix.n

    def _number(self, token: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, token))
        return i if i < len(self.alphabet) and self.alphabet[i] == token else None

    def token(self, i: int) -> int:
        return int(self.sections[0][self.matrix.access(i)])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        number = self._number(token)
        return 0 if number is None else self.matrix.count(number, lo, hi)

    def occurrences(self, token: int) -> list[int]:
        number = self._number(token)
        return [] if number is None else self.matrix.occurrences(number)

    def tokens(self) -> np.ndarray:
        return self.alphabet[self.matrix.decode()] if len(self) else np.zeros(0, "<u4")


def write_shards(docs: DataFrame, tokenizer: str = bpe.TOKENIZER, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode *docs* (doc_id, text) and write shard files to the shared folder.

    The result, already written, has one row for each file: part and shard
    (their order is ascending doc_id order, null first), n_tokens, n_docs and
    the file itself.  Files are rows of a Parquet table, so that any file system
    and any retried task will do.  A null or empty text is its end id alone;
    equal doc_ids are ordered by a hash of the text; an empty table has no
    shards.  Further columns are left out.  Ids are integers; others are cast,
    which fails for those that are none.  The table is not compressed again.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    placed = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        part, shard, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            values = [[part], [shard], [size // enc.dtype.itemsize], [len(held)], [write_shard(held, ids, enc.dtype)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["part", "shard", "n_tokens", "n_docs", "file"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(enc.encode_bytes(text) + end)
                held.append(doc_id)
                size += len(ids[-1])
                if size >= shard_tokens * enc.dtype.itemsize:
                    yield out()
                    shard, ids, held, size = shard + 1, [], [], 0
        if held:
            yield out()

    return staged(placed.mapInArrow(run, "part int, shard int, n_tokens long, n_docs long, file binary"), "shards", compression="none")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, part, shard.

    ``start`` counts the ids of all documents before it.  Only counts by part
    and by shard are summed over the files; their order is that of the parts.
    """
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("shard_start")).join(parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(data)
                tokens = shard.tokens().astype("<u4")
                at = shard.doc_starts
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(at, at[1:], strict=False)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    read = shards.select("part", "shard", "file").mapInArrow(run, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("part_start") + F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"
    )
