"""Outliers of text length and of box size against rule dimensions with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import extent


def with_rule(df: DataFrame, dims: DataFrame, values: list[str]) -> DataFrame:
    """*df* (doc_type, category) with the rule of its type, else of DEFAULT; rows without a rule go.

    Rules are a few dozen rows, sent to the rows.
    """
    own = dims.select("doc_type", "category", F.struct(*values).alias("__own"))
    base = dims.filter("doc_type = 'DEFAULT'").select("category", F.struct(*values).alias("__base"))
    both = df.join(F.broadcast(own), ["doc_type", "category"], "left").join(F.broadcast(base), "category", "left")
    rule = both.withColumn("__rule", F.coalesce("__own", "__base")).filter("__rule IS NOT NULL")
    return rule.select(*df.columns, *(F.col(f"__rule.{v}") for v in values))


def text_lengths(df: DataFrame, dims: DataFrame, doc_type: str | None = None) -> DataFrame:
    """Texts (doc_type, category, text) that are too short or too long; empty ones do not count."""
    some = df.filter(F.length("text") > 0)
    some = some.filter(F.col("doc_type") == doc_type) if doc_type else some
    ruled = with_rule(some, dims, ["min_len", "max_len"]).withColumn("length", F.length("text"))
    issue = F.when(F.col("length") < F.col("min_len"), "Too short").when(F.col("length") > F.col("max_len"), "Too long")
    return ruled.withColumn("issue", issue).filter("issue IS NOT NULL")


def box_sizes(df: DataFrame, dims: DataFrame, size: Column | None = None, doc_type: str | None = None) -> DataFrame:
    """Boxes (doc_type, category, poly, page_width, page_height) of odd share or aspect, with the reasons."""
    some = df.filter("page_width * page_height > 0")
    some = some.filter(F.col("doc_type") == doc_type) if doc_type else some
    some = some.filter(F.size("poly") > 0) if size is None else some
    measured = some.withColumn("__e", extent("poly") if size is None else size)
    ratio = F.col("__e.area") / (F.col("page_width") * F.col("page_height"))
    ruled = with_rule(measured.withColumns({"ratio": ratio, "aspect": F.col("__e.aspect")}).drop("__e"), dims, ["min_ratio", "max_ratio", "min_aspect", "max_aspect"])
    share = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    reason = F.concat_ws(
        ", ",
        F.when(F.col("ratio") < F.col("min_ratio"), F.concat(F.lit("Too small (<"), share("min_ratio"), F.lit(")"))),
        F.when(F.col("ratio") > F.col("max_ratio"), F.concat(F.lit("Too large (>"), share("max_ratio"), F.lit(")"))),
        F.when((F.col("aspect") < F.col("min_aspect")) | (F.col("aspect") > F.col("max_aspect")), F.concat(F.lit("Odd AspectRatio ("), F.format_string("%.2f", "aspect"), F.lit(")"))),
    )
    return ruled.withColumn("reason", reason).filter("reason <> ''").withColumn("area_percent", F.col("ratio") * 100)
