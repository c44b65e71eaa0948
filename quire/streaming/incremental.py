"""Incremental forms of the two stateful parts: vector collections and review logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.review import upsert


def append_new_vectors(
    stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", time: str | None = None, keep_for: str = "30 days", stored: DataFrame | None = None
) -> StreamingQuery:
    """Append a stream of vectors to a collection, of each document the first that arrives.

    Documents that were seen are state of the stream, dealt by *key*, so a batch
    costs what is new in it, and a stream that starts again goes on where its
    checkpoint ends.  With a *time* column a document is forgotten *keep_for*
    after its time, which bounds the state; without one it never is.  *stored*
    has the documents of a collection that was there before, which are left
    out.  Rows without a key stay out.  The stream is the only writer of *path*.
    """
    new = stream.filter(F.col(key).isNotNull())
    new = new.dropDuplicates([key]) if time is None else new.withWatermark(time, keep_for).dropDuplicatesWithinWatermark([key])
    if stored is not None:
        new = new.join(stored.select(key).distinct(), key, "left_anti")
    return _files(new, path, checkpoint)


def append_reviews(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append review results (file, …, ts) to a log; ``current_reviews`` reads what holds."""
    return _files(stream, path, checkpoint)


def _files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What is there, as Parquet files, each row once whatever is tried again."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_reviews(log: DataFrame) -> DataFrame:
    """Each file's last result."""
    return upsert(log)


def findings_per_window(found: DataFrame, time: str = "ts", length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Findings of a stream counted by rule and window; what comes later than *late* is left out."""
    return found.withWatermark(time, late).groupBy(F.window(time, length), "rule_id").agg(F.count(F.lit(1)).alias("n"))
