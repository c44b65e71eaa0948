"""Relations between blocks: joins to both ends, pattern counts, files by relation type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def endpoints(rel: DataFrame, blocks: DataFrame) -> DataFrame:
    """Relations (file, src, tgt, …) with category1 and category2; those with an end missing go.

    Of blocks with the same id in a file the last one counts.
    """
    last = blocks.groupBy("file", "anno_id").agg(F.max_by("category", "pos").alias("category"))
    one = last.select("file", F.col("anno_id").alias("src"), F.col("category").alias("category1"))
    two = last.select("file", F.col("anno_id").alias("tgt"), F.col("category").alias("category2"))
    return rel.join(one, ["file", "src"]).join(two, ["file", "tgt"])


def patterns(ends: DataFrame) -> DataFrame:
    """relation_type, category1, category2, n, example (the least file)."""
    return ends.groupBy("relation_type", "category1", "category2").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("example"))


def totals(patterns_: DataFrame) -> DataFrame:
    """Per relation type: relations and distinct patterns."""
    return patterns_.groupBy("relation_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_patterns"))


def files_with(rel: DataFrame, types: list[str]) -> DataFrame:
    """Files that have a relation of one of the types."""
    return rel.filter(F.col("relation_type").isin(*types)).select("file").distinct()


def examples(ends: DataFrame, per_pattern: int = 5) -> DataFrame:
    """Up to so many files of each pattern, in name order."""
    keys = ["relation_type", "category1", "category2"]
    files = ends.select(*keys, "file").distinct()
    return files.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("file"))).filter(F.col("n") <= per_pattern)
