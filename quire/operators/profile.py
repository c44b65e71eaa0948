"""Profiles of annotation data: categories, keys, types, values, page info, characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import json_pieces
from quire.functions.text import col_of, shortened, strip
from quire.plans import rules

#: Python's names of JSON types.
TYPE_NAMES = {"STRING": "str", "BIGINT": "int", "DOUBLE": "float", "BOOLEAN": "bool", "VOID": "NoneType"}


def type_name(variant: str) -> Column:
    """Type of a VARIANT expression by Python's name; a decimal without fraction digits is an int."""
    kind = f"schema_of_variant({variant})"
    named = " ".join(f"WHEN {kind} = '{k}' THEN '{v}'" for k, v in TYPE_NAMES.items())
    return F.expr(f"CASE {named} WHEN {kind} LIKE 'DECIMAL%,0)' THEN 'int' WHEN {kind} LIKE 'DECIMAL%' THEN 'float' WHEN {kind} LIKE 'ARRAY%' THEN 'list' WHEN {kind} LIKE 'OBJECT%' THEN 'dict' ELSE 'NoneType' END")


def is_empty(variant: str) -> Column:
    """Null, '', [] and {} are empty; 0 and false are not."""
    return F.expr(f"is_variant_null({variant}) OR to_json({variant}) IN ('\"\"', '[]', '{{}}')")


def unpivot(df: DataFrame, variant: str, keep: list[str], max_depth: int | None = None) -> DataFrame:
    """*keep*, key (dotted), value: every key of an object, also of objects inside it.

    An object has a row of its own besides those of its keys.  A document is
    taken apart once, however deep it is; null and what is no object has no rows.
    """

    @F.pandas_udf("array<struct<key: string, value: string>>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"key": k, "value": v} for k, v in json_pieces.keys(t, max_depth)] if t else [] for t in batch], dtype=object)

    each = df.select(*keep, F.explode(pieces(F.to_json(variant))).alias("__p"))
    return each.select(*keep, "__p.key", F.parse_json("__p.value").alias("value"))


def category_profile(blocks: DataFrame) -> DataFrame:
    """category, location, key, n (uses), n_empty, first_file, n_blocks of blocks (file, location, category, ann).

    Flat keys and keys of nested objects with the same dotted name are one key.
    """
    keys = unpivot(blocks, "ann", ["file", "location", "category"])
    used = keys.groupBy("category", "location", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_empty("value").cast("long")).alias("n_empty"), F.min("file").alias("first_file")
    )
    sizes = blocks.groupBy("category", "location").agg(F.count(F.lit(1)).alias("n_blocks"))
    return used.join(sizes, ["category", "location"])


def key_remarks(profile: DataFrame) -> DataFrame:
    """category_profile's rows with always (the key is in as many uses as there are blocks) and a remark."""
    always = F.col("n") == F.col("n_blocks")
    remark = F.when(F.col("n_empty") == F.col("n"), "always empty").when(~always, F.format_string("found in only %d of %d", "n", "n_blocks"))
    return profile.withColumns({"always": always, "remark": remark})


def key_types(df: DataFrame, variant: str, keep: list[str]) -> DataFrame:
    """*keep*, key and the sorted names of the types that its values have."""
    keys = unpivot(df, variant, keep)
    return keys.groupBy(*keep, "key").agg(F.array_join(F.array_sort(F.collect_set(type_name("value"))), ",").alias("types"))


def category_report(blocks: DataFrame, longest: int | None = None) -> DataFrame:
    """Per category and location: blocks, its keys with their types, and the remarks, whole or cut at *longest* (a sheet's cell takes 32,000)."""
    profile = key_remarks(category_profile(blocks))
    types = key_types(blocks, "ann", ["category", "location"])
    both = profile.join(types, ["category", "location", "key"])
    list_of = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "; ")
    remarks = list_of(F.when(F.col("remark").isNotNull(), F.concat("key", F.lit(" "), "remark")))
    return both.groupBy("category", "location", "n_blocks").agg(
        list_of(F.concat("key", F.lit(": "), "types")).alias("key_types"),
        (remarks if longest is None else F.substring(remarks, 1, longest)).alias("remarks"),
        F.bool_or(F.contains("key", F.lit("merge_list"))).alias("has_merge_list"),
    )


def values_at(df: DataFrame, variant: str, path: list[str], keep: list[str]) -> DataFrame:
    """*keep*, value at a path; along it lists stand for their items, nulls and missing keys give no row."""
    spark = df.sparkSession
    now = df.select(*keep, F.col(variant).alias("value"))
    names = "".join(f"l.`{k}`, " for k in keep)

    def items(level: DataFrame) -> DataFrame:
        listed = spark.sql(f"SELECT {names} e.value AS value FROM {{level}} l, LATERAL variant_explode(CASE WHEN schema_of_variant(l.value) LIKE 'ARRAY%' THEN l.value END) e", level=level)
        return level.filter("schema_of_variant(value) NOT LIKE 'ARRAY%'").unionByName(listed)

    for key in path:
        now = items(now).withColumn("value", F.expr(f"variant_get(value, \"$['{key}']\", 'variant')")).filter("value IS NOT NULL")
    return items(now).filter("NOT is_variant_null(value)")


def shown(variant: str = "value") -> Column:
    """A value as text; booleans as True and False."""
    kind = f"schema_of_variant({variant})"
    return F.expr(f"CASE WHEN {kind} = 'BOOLEAN' THEN initcap(to_json({variant})) WHEN {kind} = 'STRING' THEN variant_get({variant}, '$', 'string') ELSE to_json({variant}) END")


def value_distribution(df: DataFrame, variant: str, paths: list[list[str]], example: str) -> DataFrame:
    """path, value, n, n_distinct and an example (the least) of the values at each path."""
    out = None
    for path in paths:
        counted = values_at(df, variant, path, [example]).groupBy(shown().alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(example).alias("example"))
        named = counted.withColumn("path", F.lit(".".join(path)))
        out = named if out is None else out.unionByName(named)
    distinct = out.groupBy("path").agg(F.count(F.lit(1)).alias("n_distinct"))
    return out.join(distinct, "path")


def value_counts(df: DataFrame, columns: list[str], keep_empty: bool = False) -> DataFrame:
    """key, value, n: typed columns unpivoted and counted in one pass; lists count by item."""
    cells = [F.struct(F.lit(c).alias("key"), (F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("string"))).cast("array<string>").alias("v")) for c in columns]
    each = df.select(F.explode(F.array(*cells)).alias("c")).select("c.key", F.explode("c.v").alias("value"))
    each = each if keep_empty else each.filter("value IS NOT NULL")
    return each.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def issues(special_issue: Column | str) -> Column:
    """A page's issues; none are the one issue ``None``."""
    c = col_of(special_issue)
    return F.when(c.isNull() | (F.size(c) == 0), F.array(F.lit("None"))).otherwise(c)


def share_by_group(df: DataFrame, group: str, unit: str, having: Column) -> DataFrame:
    """Per group the distinct units with a property, and their percentage of all units."""
    per = df.groupBy(group, unit).agg(F.bool_or(having).alias("has"))
    counted = per.groupBy(group).agg(F.sum(F.col("has").cast("long")).alias("n"), F.count(F.lit(1)).alias("total"))
    all_units = df.select(unit).distinct().count()
    return counted.withColumns({"percent": F.round(100.0 * F.col("n") / F.lit(float(max(all_units, 1))), 6)})


def table_layouts(ann: DataFrame, layout: str = "layout", examples: int = 3, shown_html: int = 500) -> DataFrame:
    """Tables by layout, with the first examples (file and cut markup); any layout counts."""
    sample = F.slice(F.array_sort(F.collect_list(F.struct("file", shortened("html", shown_html).alias("html")))), 1, examples)
    known = ann.filter(F.col(layout).isNotNull() & (F.col(layout) != ""))
    counts = known.groupBy(layout).agg(F.count(F.lit(1)).alias("n"))
    first = known.withColumn("__r", F.row_number().over(Window.partitionBy(layout).orderBy("file"))).filter(F.col("__r") <= examples)
    return counts.join(first.groupBy(layout).agg(sample.alias("examples")), layout)


def null_orders(ann: DataFrame, order: str = "order_no") -> DataFrame:
    """Blocks without an order, by category (N/A where missing)."""
    return ann.filter(F.col(order).isNull()).groupBy(F.coalesce("category", F.lit("N/A")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def file_metadata(ann: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per file: blocks, distinct categories, whether an image is there."""
    per = ann.groupBy("file").agg(F.count(F.lit(1)).alias("n_annotations"), F.array_sort(F.collect_set("category")).alias("categories"))
    if images is None:
        return per
    stems = images.select("stem").distinct().withColumn("has_image", F.lit(True))
    return per.withColumn("stem", F.regexp_replace("file", r"\.json$", "")).join(stems, "stem", "left").drop("stem").na.fill(False, ["has_image"])


# The characters that the recogniser knows besides letters, digits and Hangul syllables.
CHARSET_SPECIAL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ ·’“”‘•…–—°±×÷"
HANGUL = (0xAC00, 0xD7A3)


def in_charset(ch: Column | str, special: str = CHARSET_SPECIAL) -> Column:
    """Whether a character is a digit, a Latin letter, a Hangul syllable or one of *special*."""
    c = col_of(ch)
    inner = "".join("\\" + s if not s.isalnum() and s.isascii() and s != " " else s for s in special)
    return c.rlike(f"^[0-9a-zA-Z\\x{{{HANGUL[0]:x}}}-\\x{{{HANGUL[1]:x}}}{inner}]$")


def characters(df: DataFrame, text: str = "text") -> DataFrame:
    """ch, n and missing (not in the charset) of all characters of stripped texts.

    Characters are counted where the texts are read; only (ch, n) rows move.
    """
    each = df.select(F.explode(F.split(strip(F.coalesce(F.col(text), F.lit(""))), "")).alias("ch")).filter("ch <> ''")
    return each.groupBy("ch").agg(F.count(F.lit(1)).alias("n")).withColumn("missing", ~in_charset("ch"))


def missing_characters(chars: DataFrame, significant: int = 5, top: int | None = None) -> DataFrame:
    """The characters outside the charset, commonest first, all or the *top* ones, and whether each is common enough to add."""
    found = chars.filter("missing").withColumn("significant", F.col("n") >= significant).orderBy(F.desc("n"), "ch")
    return found if top is None else found.limit(top)


def extended_charset(chars: DataFrame, base: DataFrame, significant: int = 5) -> DataFrame:
    """The charset (ch) and the missing characters that are common, in code point order."""
    more = chars.filter(F.col("missing") & (F.col("n") >= significant)).select("ch")
    return base.select("ch").union(more).distinct().orderBy(F.hex(F.encode("ch", "UTF-32")))


def base_charset(df: DataFrame) -> DataFrame:
    """All characters of the charset."""
    spark = df.sparkSession
    plain = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + CHARSET_SPECIAL
    syllables = spark.range(HANGUL[0], HANGUL[1] + 1).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("ch"))
    return spark.createDataFrame([(c,) for c in plain], "ch string").union(syllables)


def category_counts(ann: DataFrame) -> DataFrame:
    """Blocks by category, of the categories whose characters are counted."""
    return ann.filter(F.col("category").isin(*rules.CHARSET_CATEGORIES)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
