"""An index of a vector collection: cells around centres, and vectors as their quantised difference from the centre.

A search reads the codes of the cells nearest to its queries, a byte for each
number, and the exact vectors of its best candidates only.  The centres are
fitted on a bounded sample (SAMPLE vectors in an order fixed by a hash); every
vector is in the index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.vectors import HELD_QUERIES, _exact_unit
from quire.sources.sinks import write_bytes
from quire.staging import staged

#: Vectors that centres are fitted on, vectors of a cell about, cells at most, rounds of fitting.
SAMPLE, CELL, CELLS, ROUNDS = 50_000, 256, 4096, 12
#: Share of the cells that a search reads, and candidates for each result.
PROBES, CANDIDATES = 0.7, 5
#: Rows that are scored at once.
STEP = 4096


@dataclass
class Index:
    """A written index: its folder, its centres, and the vectors' length."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    id_col: str


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit length from rows of unit length: each row's direction counts for its nearest centre."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + STEP] @ centres.T).argmax(axis=1) for i in range(0, len(sample), STEP)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), centres)
    return centres


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", keep: tuple[str, ...] = (), sample: int = SAMPLE) -> Index:
    """Write the index of *vectors* (id, embedding, columns to *keep*) below *path*.

    ``codes`` and ``vectors`` are Parquet tables with a folder for each cell,
    sorted by cell and id over ranges, so that a cell with very many vectors is
    many files.  Vectors must be of one length; those of zeros are like nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col("embedding").cast("array<double>").alias("embedding"), *keep)
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64(id_col), id_col).limit(min(n, sample)).select("embedding").collect()
    centres = fit(_exact_unit([r["embedding"] for r in drawn]), max(1, min(CELLS, n // CELL))) if drawn else np.zeros((1, 1))
    sent = spark.sparkContext.broadcast(centres)
    schema = f"`{id_col}` long, cell int, scale float, code binary, v binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                unit = _exact_unit(part.column(1).to_pylist())
                cell = (unit @ sent.value.T).argmax(axis=1)
                rest = unit - sent.value[cell]
                scale = (np.abs(rest).max(axis=1) / 127).astype(np.float32)
                code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).clip(-127, 127).astype(np.int8)
                columns = [part.column(0), pa.array(cell.astype(np.int32)), pa.array(scale), _cells_of(code), _cells_of(unit)]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], [id_col, "cell", "scale", "code", "v", *keep])

    schema += "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    made = staged(rows.mapInArrow(encode, schema), "index-rows")
    dealt = made.repartitionByRange("cell", id_col).sortWithinPartitions("cell", id_col)
    dealt.select("cell", id_col, "scale", "code", *keep).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/codes")
    dealt.select("cell", id_col, "v").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
    write_bytes(spark, json.dumps({"id": id_col, "centres": centres.tolist()}).encode(), f"{path}/centres.json")
    return Index(spark, path, centres, id_col)


def _cells_of(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary cells."""
    data = np.ascontiguousarray(m)
    width = data.shape[1] * data.itemsize
    return pa.array([data[i].tobytes() for i in range(len(data))] if width else [b""] * len(data), pa.binary())


def load(spark: SparkSession, path: str) -> Index:
    """An index that was written below *path*."""
    text = spark.read.text(f"{path}/centres.json", wholetext=True).first()["value"]
    found = json.loads(text)
    return Index(spark, path, np.array(found["centres"], float), found["id"])


def search(index: Index, queries: DataFrame, k: int = 10, where: str | None = None, probes: float = PROBES, candidates: int = CANDIDATES, held: int = HELD_QUERIES) -> DataFrame:
    """query, id, score: about the *k* vectors most like each query vector (of the index's id column, embedding).

    A query reads the share *probes* of the cells whose centres are nearest to
    it, and compares the best ``k * candidates`` by their codes exactly; what
    is missed is what lies in other cells.  *where* is a condition on columns
    that the index keeps.  Cells that no query of a block reads are not read.
    """
    spark, name = index.spark, index.id_col
    asked = queries.select(F.col(name).cast("long").alias("query"), F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-asked.count() // held))
    out = None
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).collect()
        found = _searched(index, block, k, where, probes, candidates)
        out = found if out is None else out.unionByName(found)
    return out


def _searched(index: Index, block: list, k: int, where: str | None, probes: float, candidates: int) -> DataFrame:
    spark, name = index.spark, index.id_col
    unit = _exact_unit([r["embedding"] for r in block])
    ids = np.array([r["query"] for r in block], np.int64)
    if not len(ids):
        return spark.createDataFrame([], f"query long, `{name}` long, score double")
    read = max(1, int(np.ceil(probes * len(index.centres))))
    near = np.argsort(-(unit @ index.centres.T), axis=1, kind="stable")[:, :read]
    reads = np.zeros((len(ids), len(index.centres)), bool)
    np.put_along_axis(reads, near, True, axis=1)
    sent = spark.sparkContext.broadcast((ids, unit, index.centres, np.packbits(reads, axis=1)))
    codes = spark.read.parquet(f"{index.path}/codes").filter(where or "true")
    if not (of_block := reads.any(axis=0)).all():
        codes = codes.filter(F.col("cell").isin(np.flatnonzero(of_block).tolist()))
    wanted = k * candidates

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unit, centres, reads = sent.value
        kept = _Best(len(unit), wanted)
        for batch in batches:
            cells = batch.column(0).to_numpy()
            # rows come cell by cell
            ends = np.flatnonzero(np.append(cells[1:] != cells[:-1], True)) + 1
            for start, end in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                cell = int(cells[start])
                asks = np.flatnonzero(reads[:, cell >> 3] >> (7 - (cell & 7)) & 1)
                for at in range(start, end, STEP):
                    part = batch.slice(at, min(STEP, end - at))
                    code = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int8).reshape(part.num_rows, -1)
                    v = centres[cell] + code * part.column(2).to_numpy()[:, None]
                    for few in range(0, len(asks), STEP):
                        q = asks[few : few + STEP]
                        kept.add(q, part.column(1).to_numpy(), cell, unit[q] @ v.T)
        for columns in kept.rows():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "id", "cell", "guess"])

    guessed = codes.select("cell", name, "scale", "code").mapInArrow(score, "q long, id long, cell int, guess double")
    order = Window.partitionBy("q").orderBy(F.desc("guess"), "id")
    some = guessed.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= wanted).select("q", "id", "cell")
    exact = spark.read.parquet(f"{index.path}/vectors").select("cell", F.col(name).alias("id"), "v")
    pairs = exact.join(staged(some, "candidates"), ["cell", "id"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, _, _ = sent.value
        for batch in batches:
            q = batch.column(0).to_numpy()
            v = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(len(q), -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column(1), pa.array((unit[q] * v).sum(axis=1))], ["query", name, "score"])

    scored = pairs.select("q", "id", "v").mapInArrow(compare, f"query long, `{name}` long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), name)
    return scored.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")


class _Best:
    """The best rows of each query so far: what is below a query's last is not taken, and rows are cut now and then."""

    HELD = 1 << 20

    def __init__(self, queries: int, wanted: int):
        self.wanted, self.least = wanted, np.full(queries, -np.inf)
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, q: np.ndarray, ids: np.ndarray, cell: int, scores: np.ndarray) -> None:
        i, j = np.nonzero(scores > self.least[q][:, None])
        self.parts.append((q[i], ids[j], np.full(len(i), cell, np.int32), scores[i, j]))
        self.size += len(i)
        if self.size >= self.HELD:
            self._cut()

    def _cut(self) -> None:
        q, ids, cells, scores = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, rank = order[rank < self.wanted], q[rank < self.wanted], rank[rank < self.wanted]
        full = rank == self.wanted - 1
        self.least[q[full]] = scores[order[full]]
        self.parts = [(q, ids[order], cells[order], scores[order])]
        self.size = len(q)

    def rows(self) -> list[tuple]:
        if self.parts:
            self._cut()
        return self.parts


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> float:
    """The share of the rows (query, id) of *exact* that *found* has."""
    all_ = exact.select("query", id_col)
    total = all_.count()
    return all_.join(found.select("query", id_col), ["query", id_col], "left_semi").count() / total if total else 1.0
