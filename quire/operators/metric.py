"""Pairs of vectors over a cosine, by cells around pivots: exact, and bounded in each task.

Vectors that are equal are one.  Each goes to the cell of its nearest pivot, and
as a visitor to those cells of lower number in which it may have a neighbour:
angles obey the triangle inequality, so one within an angle t of a vector of
another cell is no farther from that cell's pivot than the cell's radius and t,
nor than its own pivot and 2 t.  A task holds at most about RESIDENTS vectors of
a cell and lets up to VISITS pass, so a cell of any size is many tasks.

With a high threshold few cells are visited; with a low one, in many dimensions,
most are, and what is left is a blocked product of all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.staging import staged

#: Vectors of a cell, about, and cells at most (their pivots are sent to all tasks).
CELL, CELLS = 4096, 4096
#: Vectors that a task holds, and that pass it, about.
RESIDENTS, VISITS = 4096, 16384
#: Vectors of one product with the residents.
STEP = 512


def unit(lists: list) -> np.ndarray:
    """Rows of length 1, but for zeros."""
    m = np.array(lists, float).reshape(len(lists), -1)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)


def distinct(vectors: DataFrame, threshold: float, id_col: str) -> DataFrame:
    """(id, v, rep): each vector's unit form, and the least id of those that equal it.

    Vectors that do not even reach *threshold* with themselves (zeros, those
    with no numbers) stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = unit(batch.column(1).to_pylist())
            own = (m * m).sum(axis=1) > threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in m], pa.binary()), pa.array(own)], ["id", "v", "own"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    made = staged(rows.mapInArrow(run, "id long, v binary, own boolean"), "units")
    key = F.when(F.col("own"), F.sha2("v", 256)).otherwise(F.col("id").cast("string")).alias("key")
    least = made.groupBy(key).agg(F.min("id").alias("rep"))
    return made.select("id", "v", key).join(least, "key").select("id", "v", "rep")


def _placed(reps: DataFrame, threshold: float) -> DataFrame:
    """(cell, id, v, home) of vectors (id, v) in their own cell and in those that they visit."""
    spark = reps.sparkSession
    n = reps.count()
    drawn = reps.orderBy(F.xxhash64("id"), "id").limit(max(1, min(CELLS, n // CELL))).select("v").collect()
    sent = spark.sparkContext.broadcast(np.array([np.frombuffer(r["v"]) for r in drawn]).reshape(len(drawn), -1) if drawn else np.zeros((1, 1)))

    def angles(batch: pa.RecordBatch) -> np.ndarray:
        m = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(batch.num_rows, -1)
        return np.arccos(np.nan_to_num(m @ sent.value.T, nan=0.0).clip(-1, 1))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(at, STEP) for batch in batches for at in range(0, batch.num_rows, STEP))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            angle = angles(batch)
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], ["cell", "angle"])

    radius = np.full(max(1, len(drawn)), -np.inf)
    for r in reps.mapInArrow(own, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("radius")).collect():
        radius[r["cell"]] = r["radius"]
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            angle = angles(batch)
            cell = angle.argmin(axis=1)
            near = angle[np.arange(len(cell)), cell][:, None]
            visits = (angle <= radius + reach) & (angle <= near + 2 * reach) & (np.arange(angle.shape[1]) < cell[:, None])
            i, j = np.nonzero(visits)
            row = pa.array(np.concatenate([np.arange(len(cell)), i]))
            columns = [pa.array(np.concatenate([cell, j]).astype(np.int32)), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.arange(len(row)) < len(cell))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "id", "v", "home"])

    return reps.mapInArrow(places, "cell int, id long, v binary, home boolean")


def _dealt(placed: DataFrame) -> DataFrame:
    """(cell, block, part, passes, id, v) in order: a block's residents, then those that pass it in one part.

    Residents of later blocks of a cell pass the earlier ones.
    """
    sizes = placed.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("all"))
    grid = sizes.select("cell", F.ceil(F.col("homes") / RESIDENTS).cast("int").alias("blocks"), F.ceil(F.col("all") / VISITS).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    rows = placed.join(F.broadcast(grid), "cell").withColumn("own", F.when(F.col("home"), block))
    part = F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    stays = rows.filter("home").select("cell", F.col("own").alias("block"), F.explode(upto(F.col("parts"))).alias("part"), F.lit(0).alias("passes"), "id", "v")
    passed = rows.select("cell", F.explode(upto(F.coalesce("own", "blocks"))).alias("block"), part.alias("part"), F.lit(1).alias("passes"), "id", "v")
    keys = ["cell", "block", "part"]
    return stays.unionByName(passed).repartition(*keys).sortWithinPartitions(*keys, "passes")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, residents' ids and matrix, an iterator of the same of those that pass) for each block and part."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    matrix = lambda some: (np.array([r[4] for r in some], np.int64), np.frombuffer(b"".join(r[5] for r in some)).reshape(len(some), -1))
    for (_, _, part), group in groupby(rows, lambda r: r[:3]):
        kinds = groupby(group, lambda r: r[3])
        stays, passed = [], iter(())
        for passes, some in kinds:
            if passes:
                passed = some
                break
            stays = list(some)
        if not stays:
            continue

        def steps(passed=passed) -> Iterator[tuple]:
            held: list[tuple] = []
            for r in passed:
                held.append(r)
                if len(held) == STEP:
                    yield matrix(held)
                    held = []
            if held:
                yield matrix(held)

        yield part, matrix(stays), steps()


def _products(part: int, stays: tuple, passed: Iterator[tuple], threshold: float) -> Iterator[tuple]:
    """(resident places, other ids, other places among residents or None, scores) of the hits, some at a time."""
    ids, m = stays
    if part == 0:
        for at in range(0, len(ids), STEP):
            score = m[at : at + STEP] @ m.T
            j, i = np.nonzero(score > threshold)
            once = i < j + at
            yield i[once], ids[at + j[once]], at + j[once], score[j[once], i[once]]
    for others, w in passed:
        score = w @ m.T
        j, i = np.nonzero(score > threshold)
        yield i, others[j], None, score[j, i]


def pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of all pairs a < b of vectors (id, v) over *threshold*, each once."""
    placed = staged(_placed(reps, threshold), "placed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stays, passed in _groups(batches):
            for i, other, _, score in _products(part, stays, passed, threshold):
                one = stays[0][i]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(score)], ["a", "b", "score"])

    return _dealt(placed).mapInArrow(run, "a long, b long, score double")


def edges(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that connect what ``pairs`` connects, at most one for each vector that a task sees.

    A task joins its components as hits come, and a component's vectors are
    told as a chain, so that no vector has many edges.
    """
    placed = staged(_placed(reps, threshold), "placed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stays, passed in _groups(batches):
            found = list(_contracted(stays[0], _products(part, stays, passed, threshold)))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _dealt(placed).mapInArrow(run, "a long, b long")


def _contracted(ids: np.ndarray, hits: Iterator[tuple]) -> Iterator[tuple[int, int]]:
    """Chains over the components of residents (*ids*) and of those that hit them."""
    label = np.arange(len(ids))
    others: dict[int, int] = {}  # of those that pass: a resident of their component
    for i, other, place, _ in hits:
        if not len(i):
            continue
        order = np.argsort(other, kind="stable")
        i, other = i[order], other[order]
        ends = np.flatnonzero(np.append(other[1:] != other[:-1], True)) + 1
        known = place[order] if place is not None else None
        start = 0
        for end in ends.tolist():
            labels = np.unique(label[i[start:end]])
            if known is not None:
                labels = np.unique(np.append(labels, label[known[start]]))
            else:
                others[int(other[start])] = int(i[start])
            if len(labels) > 1:
                label[np.isin(label, labels[1:])] = labels[0]
            start = end
    members: dict[int, list[int]] = {}
    for at, of in enumerate(label.tolist()):
        members.setdefault(of, []).append(int(ids[at]))
    for other, at in others.items():
        members[int(label[at])].append(other)
    for chain in members.values():
        chain.sort()
        yield from zip(chain, chain[1:], strict=False)
