"""Stratified and diversity-aware samples, and training splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.numbering import hash_ranks
from quire.plans import rules
from quire.staging import staged


def sample_size(total: Column, rate: float, min_per_type: int) -> Column:
    """The rate's share rounded up, at least the minimum, at most all."""
    return F.least(F.greatest(F.least(F.lit(min_per_type), total), F.ceil(total * F.lit(float(rate)))), total)


def _order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def stratified(files: DataFrame, stratum: str, key: str, rate: float, min_per_type: int = 1, seed: int = 42) -> DataFrame:
    """Rows drawn from each stratum, in an order fixed by the seed and the key.

    Raises ValueError for a rate outside (0, 1] or a minimum under 1.
    """
    if not 0 < rate <= 1 or min_per_type < 1:
        raise ValueError("rate must be in (0, 1] and min_per_type at least 1")
    ranked = hash_ranks(files, [stratum], _order(seed, key), key)
    return ranked.filter(F.col("__rank") <= sample_size(F.col("__size"), rate, min_per_type)).select(*files.columns)


def breakdown(files: DataFrame, sampled: DataFrame, stratum: str, names: DataFrame | None = None) -> DataFrame:
    """Per stratum: total, sampled, rate in percent (one decimal), and its name."""
    total = files.groupBy(stratum).agg(F.count(F.lit(1)).alias("total"))
    drawn = sampled.groupBy(stratum).agg(F.count(F.lit(1)).alias("sampled"))
    both = total.join(drawn, stratum, "left").na.fill(0, ["sampled"])
    out = both.withColumn("rate", F.round(F.col("sampled").cast("double") / F.col("total") * 100, 1))
    return out if names is None else out.join(F.broadcast(names.withColumnRenamed("doc_type", stratum)), stratum, "left")


def without_duplicates(files: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Files that are no member but the first of a cluster (id, size, is_rep) of two or more."""
    gone = clusters.filter("size > 1 AND NOT is_rep").select(F.col("id").alias(key))
    return files.join(gone, key, "left_anti")


def diverse(files: DataFrame, clusters: DataFrame | None, stratum: str, key: str, rate: float, min_per_type: int = 1, seed: int = 42) -> DataFrame:
    """A stratified sample of cluster representatives and unclustered files; without clusters a plain one."""
    kept = files if clusters is None else without_duplicates(files, clusters, key)
    return stratified(kept, stratum, key, rate, min_per_type, seed)


def diverse_or_plain(
    files: DataFrame, find_clusters: Callable[[], DataFrame], stratum: str, key: str, rate: float, min_per_type: int = 1, seed: int = 42
) -> tuple[DataFrame, str | None]:
    """A diverse sample, or a plain one where the clusters cannot be found, and then why.

    The clusters are staged here, so that their failure shows before the sample
    is used.  A wrong rate or minimum raises ValueError either way.
    """
    try:
        clusters, why = staged(find_clusters().select("id", "size", "is_rep"), "clusters"), None
    except Exception as e:  # whatever the search for clusters raises, the sample goes on without them
        clusters, why = None, f"{type(e).__name__}: {e}"
    return diverse(files, clusters, stratum, key, rate, min_per_type, seed), why


def train_split(rows: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """*rows* with split: exactly floor(n * share) are ``train``, in an order fixed by the seed."""
    ranked = hash_ranks(rows, [], _order(seed, key), key)
    train = F.col("__rank") <= F.floor(F.col("__size") * F.lit(float(share)))
    return ranked.select(*rows.columns, F.when(train, "train").otherwise("val").alias("split"))


def training_reason(category: Column, text: Column, width: Column, height: Column) -> Column:
    """Why a block gives no training pair, the first reason that holds; null if it gives one."""
    return (
        F.when(~category.isin(*rules.TRAINING_CATEGORIES), F.concat(F.lit("CAT_EXCLUDED("), category, F.lit(")")))
        .when(text.isNull() | (F.length(F.trim(text)) == 0), "TEXT_EMPTY")
        .when(width.isNull() | height.isNull() | (width <= 0) | (height <= 0), "CROP_EMPTY")
        .when((width < 5) | (height < 5), "TOO_SMALL")
        .when(width / height < 2.5, "LOW_ASPECT")
        .when(F.length(text) > 200, "TEXT_TOO_LONG")
    )


def skip_reasons(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def draws(item: str, key: str, k: int, seed: int = 42) -> Column:
    """An aggregate: min(k, rows) of a group's *item*, drawn with replacement by hashes of seed, draw and *key*.

    Each draw is the row with the least md5, so tasks keep k rows of a group,
    merging keeps the least, and no partitioning changes the sample.  Rows with
    the same key are one; nulls are not drawn.
    """
    of = lambda n: F.min_by(item, F.md5(F.concat(F.lit(f"{seed}|{n}|"), F.col(key).cast("string"))))
    return F.slice(F.array_compact(F.array(*map(of, range(k)))), F.lit(1), F.least(F.lit(k), F.count(key)).cast("int"))
