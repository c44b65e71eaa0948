"""The session that the engine's operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: caseSensitive: JSON keys that differ by case stay apart.  allowDuplicateKeys:
#: of a repeated JSON key the last value counts.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=CONF | conf)
    return (builder.master(master) if master else builder).getOrCreate()
