"""Shared plumbing: Arrow maps over columns, and the staging of intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.staging import scratch, shared_dir, staged

__all__ = ["append_columns", "field", "give_back", "keeping_columns", "of_worker", "scratch", "shared_dir", "short_batches", "staged", "table"]

#: Rows of one Arrow batch.  Texts may be long, so batches are kept short.
ARROW_ROWS = "512"


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for batches of nothing but long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_columns(
    df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable[..., Sequence]], fields: Sequence[T.StructField], keep: Callable | None = None
) -> DataFrame:
    """*df* with columns that Python computes batch by batch.

    ``make()`` runs once in each task and returns a function from the input
    columns (Python lists) to one list for each of *fields*.  A column of *df*
    that has the name of a new field is replaced by it.  ``keep``, if given,
    gets the new lists and returns a list of booleans: which rows stay.
    """
    short_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    carried = [c for c in df.columns if c.lower() not in new]
    needed = {f"__in{i}": c for i, c in enumerate(inputs)}
    clash = {k: c for k, c in needed.items() if c not in carried}
    wide = df.select(*(F.col(f"`{c}`") for c in carried), *(F.col(f"`{c}`").alias(k) for k, c in clash.items()))
    names = [k if k in clash else c for k, c in needed.items()]
    schema = T.StructType([*(df.schema[c] for c in carried), *fields])
    types = [f.type for f in to_arrow_schema(T.StructType(list(fields)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            lists = compute(*(batch.column(n).to_pylist() for n in names))
            columns = [batch.column(c) for c in carried] + [pa.array(v, t) for v, t in zip(lists, types, strict=True)]
            out = pa.RecordBatch.from_arrays(columns, [*carried, *(f.name for f in fields)])
            yield out.filter(pa.array(keep(*lists), pa.bool_())) if keep else out

    return wide.mapInArrow(run, schema)


def keeping_columns(docs: DataFrame, made: Iterable[str], operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operate(docs)`` with the columns of *docs* alone; those named as what it makes (*made*) keep their values."""
    taken, names = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in {m.lower() for m in made}:
            names[c] = f"own_{c}"
            while names[c].lower() in taken:
                names[c] += "_"
            taken.add(names[c].lower())
    found = operate(docs.withColumnsRenamed(names))
    return found.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


_held: dict = {}


def of_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make()`` gave for *key*, held by this worker for its next tasks.

    Only the last key's is held, and the memory of the one before goes back to
    the system, so that a worker that goes from operator to operator does not
    gather the caches of all.
    """
    if key not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Memory that this process has freed goes to the system: what cycles held, Arrow's pool, the allocator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
