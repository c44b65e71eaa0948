"""Annotation-shaped frames derived from plain tables, in SQL that Spark and other engines share.

Each text reads ``{documents}``; ids drive which traps a row holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE = "concat(substr('PPPRIRSKXX', CAST(1 + 2 * (CAST(floor(doc_id / 10.0) AS BIGINT) % 5) AS INT), 2), '_', CAST(CAST(floor(doc_id / 10.0) AS BIGINT) AS STRING), '.json')"

ANNOTATIONS = f"""
SELECT doc_id, {_FILE} AS file, CAST(doc_id % 10 AS INT) AS pos,
       CAST(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE doc_id % 10 END AS STRING) AS anno_id,
       CASE CAST(doc_id % 10 AS INT) WHEN 0 THEN 'title' WHEN 1 THEN 'text_block' WHEN 2 THEN 'table' WHEN 3 THEN 'figure' WHEN 4 THEN 'chart'
            WHEN 5 THEN 'text_block' WHEN 6 THEN 'header' WHEN 7 THEN 'table_caption' WHEN 8 THEN 'table' ELSE 'list_item' END AS category,
       CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 13 = 0 THEN NULL
            ELSE concat(text,
                 CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN ' x^2' WHEN 1 THEN ' 3 x 4' WHEN 2 THEN concat(' $a + ', chr(123), 'b$')
                      WHEN 3 THEN concat(' ', chr(92), 'alpha') WHEN 4 THEN ' $x]$ and $y$' WHEN 5 THEN ' a/b'
                      WHEN 6 THEN concat(' $ $ and $', chr(92), 'foo ', chr(92), 'frac$')
                      ELSE CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN concat(' $', chr(92), 'begin', chr(123), 'a', chr(125), ' x$') WHEN 1 THEN concat(' $', chr(92), 'left( x$')
                           WHEN 2 THEN concat(' $x ', chr(92), 'right)$') WHEN 3 THEN concat(' $', chr(92), 'sqrt[3]', chr(123), 'x', chr(125), ' ', chr(92), 'foo$')
                           WHEN 4 THEN concat(' $', chr(92), 'end', chr(123), 'a', chr(125), '$') ELSE '' END END) END AS text,
       CASE CAST(doc_id % 10 AS INT)
            WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE concat('<table><img src="anno_id_', CAST(doc_id % 14 AS STRING), '"></table> $$figure_', CAST(doc_id % 12 AS STRING), '$$') END
            WHEN 8 THEN concat('<img src="ANNO_ID 0', CAST(doc_id % 9 AS STRING), '">')
            WHEN 4 THEN CASE WHEN doc_id % 4 = 0 THEN '' ELSE '<p>x</p>' END ELSE NULL END AS html,
       CASE WHEN doc_id % 6 = 0 THEN concat('a + ', chr(123), 'b') ELSE NULL END AS latex,
       doc_id % 5 = 0 AS ignored,
       CASE WHEN doc_id % 17 = 0 THEN 4 WHEN doc_id % 19 = 0 THEN 7 ELSE 8 END AS poly_len,
       CASE WHEN doc_id % 10 IN (2, 3, 8) THEN 0.0 ELSE CAST((doc_id * 37) % 500 AS DOUBLE) END AS x1,
       CASE WHEN doc_id % 10 IN (2, 3, 8) THEN CAST((doc_id % 10) * 50 AS DOUBLE) ELSE CAST((doc_id * 53) % 700 AS DOUBLE) END AS y1,
       CASE WHEN doc_id % 10 IN (2, 3, 8) THEN 400.0 ELSE CAST(20 + (doc_id * 11) % 90 AS DOUBLE) END AS w,
       CASE WHEN doc_id % 10 IN (2, 3, 8) THEN 600.0 ELSE CAST((doc_id * 7) % 60 AS DOUBLE) END AS h,
       doc_id % 3 = 1 AS has_line, doc_id % 4 = 1 AS include_photo, doc_id % 6 = 2 AS include_chart,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 10 AS INT) END AS order_no
FROM {{documents}}
"""

RELATIONS = f"""
SELECT {_FILE} AS file, CAST(doc_id % 10 AS INT) AS rel_pos, CAST(doc_id % 10 AS STRING) AS src,
       CAST(CASE WHEN doc_id % 30 = 2 THEN doc_id % 10 ELSE (doc_id + 1 + doc_id % 3) % 10 END AS STRING) AS tgt,
       CASE CAST(doc_id % 4 AS INT) WHEN 1 THEN 'truncated' WHEN 2 THEN 'x_parent_son' ELSE 'parent_son' END AS relation_type
FROM {{documents}} WHERE doc_id % 10 IN (2, 3, 8)
"""


def sql_of(text: str) -> str:
    """The surrogate as SQL over the plain table."""
    return text.replace("{documents}", "documents")


def annotations(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The canonical annotation columns; polygons are upright rectangles cut to ``poly_len`` numbers."""
    base = spark.sql(ANNOTATIONS, documents=documents)
    x2, y2 = F.col("x1") + F.col("w"), F.col("y1") + F.col("h")
    eight = F.array("x1", "y1", x2, "y1", x2, y2, "x1", y2)
    keys = F.array_compact(F.array(F.lit("anno_id"), F.lit("category_type"), F.lit("poly"), F.lit("ignore"), F.when(F.col("html").isNotNull(), F.lit("html")), F.when(F.col("latex").isNotNull(), F.lit("latex"))))
    return base.withColumns(
        {
            "poly": F.slice(eight, 1, F.col("poly_len")),
            "raw_keys": keys,
            "attr_keys": F.when(F.col("has_line"), F.array(F.lit("line"), F.lit("language"))).otherwise(F.array().cast("array<string>")),
            "flags": F.array_compact(F.array(F.when(F.col("include_photo"), F.lit("include_photo")), F.when(F.col("include_chart"), F.lit("include_chart")))),
        }
    )


def relations(spark: SparkSession, documents: DataFrame) -> DataFrame:
    base = spark.sql(RELATIONS, documents=documents)
    return base.withColumns({"first_src": F.col("src"), "first_tgt": F.col("tgt")})


def sub_regions(ann: DataFrame) -> DataFrame:
    """Every figure of every third page holds block 4 as a region."""
    return ann.filter("category = 'figure' AND doc_id % 3 = 0").select("file", "anno_id", F.lit("4").alias("sub_id"))


#: A block as JSON text with optional keys of several types; {documents} as above.
BLOCKS_JSON = """
SELECT doc_id, concat('f', CAST(doc_id % 50 AS STRING)) AS file, lang AS category,
       concat('{{"category_type":"', lang, '","anno_id":', CAST(doc_id AS STRING),
              CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN ',"attribute":{{"line":"a","n":1}}' WHEN 1 THEN ',"attribute":{{"line":"","n":"x"}},"tags":["p","q"]'
                   ELSE ',"attribute":null,"tags":[]' END, '}}') AS j
FROM {documents}
"""


def blocks_json(documents: DataFrame) -> DataFrame:
    """doc_id, file, category, ann (VARIANT) of BLOCKS_JSON."""
    base = documents.sparkSession.sql(BLOCKS_JSON, documents=documents)
    return base.select("doc_id", "file", "category", F.parse_json("j").alias("ann"))
