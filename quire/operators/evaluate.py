"""Comparison of recognised with given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import band, character_error_rate, is_blank, similarity


def compare(pairs: DataFrame, given: str = "gt_text", recognised: str = "ocr_text") -> DataFrame:
    """Pairs with a given text, their similarity and its band."""
    some = pairs.filter(~is_blank(F.coalesce(F.col(given), F.lit(""))))
    return some.withColumn("similarity", similarity(given, recognised)).withColumn("band", band("similarity"))


def with_cache(ann: DataFrame, cache: DataFrame) -> DataFrame:
    """Blocks with the recognised text stored for them, if any."""
    stored = cache.select(F.col("filename").alias("file"), "anno_id", "ocr_text", "similarity")
    return ann.join(stored, ["file", "anno_id"], "left")


def accuracy(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """One row: mean character error rate, share of exact matches, pairs."""
    return pairs.agg(
        F.avg(character_error_rate(reference, hypothesis)).alias("mean_cer"),
        F.avg((F.col(reference) == F.col(hypothesis)).cast("double")).alias("exact_match"),
        F.count(F.lit(1)).alias("n"),
    )
