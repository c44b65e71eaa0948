"""Dense numbers and ranks over ordered rows, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.staging import staged


def dense_ids(df: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """*df* with its rank by *order*: ranges are sorted apart, and each is shifted by the rows before it."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = staged(placed.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "ordered")
    sizes = marked.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), F.min("__m").alias("__first"))
    earlier = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", "__first", earlier.alias("__s"))
    return marked.join(F.broadcast(starts), "__p").select(*df.columns, (F.col("__m") - F.col("__first") + F.col("__s") + 1).alias(out))


def hash_ranks(df: DataFrame, groups: list[str], order: Column, tie: str, buckets: int = 4096) -> DataFrame:
    """*df* with __rank and __size: each row's place in its group by *order* (hex digits of a hash), then *tie*.

    The hash's first digits deal a group's rows to buckets in order; buckets are
    counted, and rows are ranked inside a bucket only.
    """
    digits = df.withColumn("__o", order).withColumn("__b", F.floor(F.conv(F.substring("__o", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets))
    counted = digits.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*groups)
    earlier = F.coalesce(F.sum("__c").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)), F.col("__b").alias("__sb"), earlier.alias("__s"), F.sum("__c").over(whole).alias("__size"))
    same = F.col("__b") == F.col("__sb")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "__b").orderBy("__o", tie))
    return digits.join(starts, same).withColumn("__rank", inside + F.col("__s")).select(*df.columns, "__rank", "__size")
