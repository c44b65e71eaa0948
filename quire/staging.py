"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables staged in the scopes that are open, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, as in local tests, a temporary folder of this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quire.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("quire.shared.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, keep: bool = False, compression: str | None = None) -> DataFrame:
    """*df*, written as Parquet into the shared folder and read back; its lineage ends there.

    With *keep* the table outlives the innermost ``scratch``.  *compression*
    ``none`` suits cells that are compressed already.
    """
    path = f"{shared_dir(df.sparkSession)}/quire/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """*df* dealt by *keys* to all shuffle partitions: for few bytes that much work follows, which adaptive plans would give to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables staged inside it and not kept.

    What leaves the scope may read kept tables only.
    """
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for where in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
