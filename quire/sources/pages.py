"""Page JSON files as frames: pages, annotations, relations, sub-regions, nested blocks.

Pages stay VARIANT, so unknown keys and drifting types survive; the frames have
typed columns of what the operators use.  Ids are compared as JSON text, so the
number 5 and the string "5" differ, and a missing id is -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import json_pieces


def read_pages(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """path, file, page of each *.json file; page is null where the file is no JSON.

    *recursive* takes in all folders below, else only the given ones.  Without
    *paths* the folder is that of the session's ``quire.data.dir``, else ``data``.
    """
    paths = paths or (spark.conf.get("quire.data.dir", "data"),)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    reader = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", str(recursive).lower())
    text = reader.text(list(paths), wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("page"))


_held: dict[tuple, DataFrame] = {}


def cached_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """``read_pages``, read once in this session and kept on executors, in memory or on disk, until ``forget_pages``."""
    key = (spark.sparkContext.applicationId, paths or (spark.conf.get("quire.data.dir", "data"),))
    if key not in _held:
        _held[key] = read_pages(spark, *key[1]).persist()
    return _held[key]


def forget_pages() -> None:
    """Let go of what ``cached_pages`` keeps, so that changed files are read again."""
    while _held:
        _held.popitem()[1].unpersist()


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    """path, file, stem of image files, for batches without JSON."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}").load(list(paths))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")


def split_arrays(pages: DataFrame) -> DataFrame:
    """One row for each document of files that hold one document or an array of them, with its place."""
    return pages.sparkSession.sql(
        """SELECT p.path, p.file, CASE WHEN schema_of_variant(p.page) LIKE 'ARRAY%' THEN e.pos ELSE 0 END AS doc_pos,
                  CASE WHEN schema_of_variant(p.page) LIKE 'ARRAY%' THEN e.value ELSE p.page END AS page
           FROM {pages} p, LATERAL variant_explode_outer(
                  CASE WHEN schema_of_variant(p.page) LIKE 'ARRAY%' THEN p.page END) e""",
        pages=pages,
    )


def _has(path: str, of: str = "ann") -> Column:
    return F.expr(f"variant_get({of}, '{path}', 'variant') IS NOT NULL")


def _text(key: str, of: str = "ann") -> Column:
    return F.expr(f"CASE WHEN is_variant_null(variant_get({of}, '$.{key}', 'variant')) THEN NULL ELSE coalesce(try_variant_get({of}, '$.{key}', 'string'), to_json(variant_get({of}, '$.{key}', 'variant'))) END")


def typed(blocks: DataFrame) -> DataFrame:
    """Blocks (…, ann VARIANT) with the columns that operators use, defaults as for missing keys."""
    truthy = "coalesce(try_variant_get(ann, '{0}', 'boolean'), try_variant_get(ann, '{0}', 'double') <> 0, false)"
    strict = "coalesce(schema_of_variant(variant_get(ann, '{0}', 'variant')) = 'BOOLEAN' AND try_variant_get(ann, '{0}', 'boolean'), false)"
    keys = "coalesce(json_object_keys(to_json(variant_get(ann, '{0}', 'variant'))), array())"
    flag = "CASE WHEN coalesce(try_variant_get(ann, '$.attribute.{0}', 'boolean'), false) OR coalesce(try_variant_get(ann, '$.attribute.{0}', 'string'), '') NOT IN ('', 'false', '0') THEN '{0}' END"
    return blocks.withColumns(
        {
            "anno_id": F.when(_has("$.anno_id"), F.expr("to_json(variant_get(ann, '$.anno_id', 'variant'))")).otherwise("-1"),
            "category": F.when(_has("$.category_type"), _text("category_type")).otherwise("unknown"),
            "poly": F.expr("coalesce(try_variant_get(ann, '$.poly', 'array<double>'), flatten(try_variant_get(ann, '$.poly', 'array<array<double>>')), CAST(array() AS array<double>))"),
            "poly_len": F.expr("CASE WHEN variant_get(ann, '$.poly', 'variant') IS NULL THEN 0 ELSE size(try_variant_get(ann, '$.poly', 'array<variant>')) END"),
            "order_no": F.expr("try_variant_get(ann, '$.order', 'int')"),
            "text": _text("text"),
            "latex": _text("latex"),
            "html": _text("html"),
            "caption": _text("caption"),
            "ignored": F.expr(f"{truthy.format('$.ignore')} OR {strict.format('$.attribute.ignore')} OR {strict.format('$.attributes.ignore')}"),
            "raw_keys": F.expr("coalesce(json_object_keys(to_json(ann)), array())"),
            "attr_keys": F.expr(f"array_union({keys.format('$.attribute')}, {keys.format('$.attributes')})"),
            "flags": F.expr(f"array_compact(array({', '.join(flag.format(k) for k in ('include_photo', 'include_chart', 'include_table'))}))"),
        }
    )


def annotations(pages: DataFrame) -> DataFrame:
    """One row per top-level block: file, pos, ann and the typed columns."""
    blocks = pages.filter("page IS NOT NULL").select("file", F.posexplode(F.expr("try_variant_get(page, '$.layout_dets', 'array<variant>')")).alias("pos", "ann"))
    return typed(blocks)


def relations(pages: DataFrame) -> DataFrame:
    """One row per relation: file, rel_pos, src, tgt (parent and son where those keys are present), first_src,
    first_tgt (source_ and target_anno_id where present), relation_type.  Explicit nulls are null."""
    rel = pages.filter("page IS NOT NULL").select("file", F.posexplode(F.expr("try_variant_get(page, '$.extra.relation', 'array<variant>')")).alias("rel_pos", "r"))
    json = lambda k: F.expr(f"nullif(to_json(variant_get(r, '$.{k}', 'variant')), 'null')")
    pick = lambda a, b: F.when(_has(f"$.{a}", "r"), json(a)).otherwise(json(b))
    return rel.select(
        "file",
        "rel_pos",
        pick("parent", "source_anno_id").alias("src"),
        pick("son", "target_anno_id").alias("tgt"),
        pick("source_anno_id", "parent").alias("first_src"),
        pick("target_anno_id", "son").alias("first_tgt"),
        F.coalesce(F.expr("try_variant_get(r, '$.relation_type', 'string')"), F.lit("")).alias("relation_type"),
    )


def sub_regions(blocks: DataFrame) -> DataFrame:
    """file, anno_id of a block and sub_id of each region inside it."""
    inner = blocks.select("file", "anno_id", F.explode(F.expr("try_variant_get(ann, '$.sub_regions', 'array<variant>')")).alias("r"))
    return inner.select("file", "anno_id", F.expr("to_json(variant_get(r, '$.anno_id', 'variant'))").alias("sub_id"))


#: Lists of blocks inside blocks.
NESTED = ("merge_list", "line_with_spans")


_BLOCKS = T.ArrayType(T.StructType([T.StructField("location", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("ann", T.StringType())]))


@F.pandas_udf(_BLOCKS)
def _blocks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        found = [json_pieces.blocks(t, "layout_dets", NESTED) if t and t[0] == "{" else () for t in batch]
        yield pd.Series([[{"location": where, "depth": d, "ann": v} for where, d, v in f] for f in found], dtype=object)


def nested_blocks(pages: DataFrame) -> DataFrame:
    """Blocks at any depth: file, location (block, merge_list or line_with_spans), depth, ann.

    A page is taken apart once, however deep its blocks are.
    """
    each = pages.filter("page IS NOT NULL").select("file", F.explode(_blocks(F.to_json("page"))).alias("b"))
    return each.select("file", "b.location", "b.depth", F.parse_json("b.ann").alias("ann"))


def page_info(pages: DataFrame) -> DataFrame:
    """file, width, height, image_path, page_no and the page's attributes."""
    get = lambda k, t: F.expr(f"try_variant_get(page, '$.page_info.{k}', '{t}')")
    return pages.filter("page IS NOT NULL").select(
        "file",
        get("width", "double").alias("width"),
        get("height", "double").alias("height"),
        get("image_path", "string").alias("image_path"),
        get("page_no", "int").alias("page_no"),
        *(get(f"page_attribute.{k}", "string").alias(k) for k in ("data_source", "language", "layout")),
        F.expr("coalesce(try_variant_get(page, '$.page_info.page_attribute.special_issue', 'array<string>'), array_compact(array(try_variant_get(page, '$.page_info.page_attribute.special_issue', 'string'))))").alias("special_issue"),
    )


def resolve_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """*pages* (file, image_path) with the image found: by name, else by stem, else by the first two parts of the stem."""
    stem = F.regexp_replace("file", r"\.json$", "")
    wanted = pages.withColumns({"__name": F.element_at(F.split("image_path", "/"), -1), "__stem": stem, "__two": F.substring_index(stem, "_", 2)})
    least = lambda key: images.groupBy(key.alias("__k")).agg(F.min("file").alias("__hit"))
    keys = (("__name", F.col("file")), ("__stem", F.col("stem")), ("__two", F.substring_index("stem", "_", 2)))
    out = wanted
    for n, (left, right) in enumerate(keys):
        hits = least(right).select(F.col("__k").alias(f"__k{n}"), F.col("__hit").alias(f"__hit{n}"))
        out = out.join(hits, F.col(left) == F.col(f"__k{n}"), "left")
    return out.select(*pages.columns, F.coalesce("__hit0", "__hit1", "__hit2").alias("image_file"))
