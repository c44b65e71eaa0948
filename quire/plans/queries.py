"""The registered queries: operators applied to whole tables, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry, latex, rewrite, text
from quire.operators import crops, evaluate, outliers, profile, relations, review, sampling, text_index, validate, vector_index, vectors
from quire.plans import rules, surrogates
from quire.staging import shared_dir, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: SQL without the common tables before it.
BODIES: dict[str, str] = {}


def query(sql: str | None = None, **ctes: str) -> Callable[[Query], Query]:
    """Register a query under its function's name; *ctes* come before the SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            BODIES[f.__name__] = sql
            head = ", ".join(f"{k} AS ({v})" for k, v in ctes.items())
            SQL[f.__name__] = f"WITH {head} {sql}" if head else sql
        return f

    return add


ANN, REL = surrogates.sql_of(surrogates.ANNOTATIONS), surrogates.sql_of(surrogates.RELATIONS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.annotations(spark, table(spark, sf_dir, "documents"))


def rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.relations(spark, table(spark, sf_dir, "documents"))


def count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


# Projections and predicates


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS text
          FROM documents WHERE contains(lower(text), 'license')""")
def p1_text_search(spark, sf_dir):
    return text.search(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "License")


@query("""SELECT p.doc_id AS phrase_id, d.doc_id AS id FROM documents d
  JOIN (SELECT doc_id, lower(substr(text, CAST(floor(length(text) / 2) AS BIGINT) + 1, 20)) AS phrase FROM documents WHERE doc_id % 50 = 0) p ON length(phrase) > 0 AND contains(lower(d.text), phrase)""")
def p1_index_search(spark, sf_dir):
    """A phrase from the middle of every fiftieth document, in all documents, by an index written for it."""
    docs = table(spark, sf_dir, "documents")
    index = text_index.build(docs, f"{shared_dir(spark)}/quire/texts-{uuid.uuid4().hex}")
    middle = F.floor(F.length("text") / 2).cast("int") + 1
    return text_index.search(index, docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("phrase_id"), F.substring("text", middle, F.lit(20)).alias("phrase")))


@query("SELECT DISTINCT file FROM ann WHERE contains(lower(file), 'pp_1')", ann=ANN)
def p2_file_search(spark, sf_dir):
    return ann(spark, sf_dir).select("file").distinct().filter(text.contains_ci("file", "PP_1"))


_EMPTY_TEXT = """SELECT file, category, anno_id, 'empty_text' AS rule_id, CASE WHEN ignored THEN 'WARNING' ELSE 'ERROR' END AS severity, CAST(NULL AS VARCHAR) AS detail
  FROM ann WHERE trim(text) = '' AND category IN ('text_block','title','header','footer','list_item','table_caption','figure_caption','page_footnote')"""
_INVALID_POLY = """SELECT file, category, anno_id, 'invalid_poly' AS rule_id, 'ERROR' AS severity,
  CASE WHEN poly_len < 6 THEN 'fewer than three points' ELSE 'odd number of values' END AS detail FROM ann WHERE poly_len < 6 OR poly_len % 2 = 1"""
@query("""SELECT category, CAST(count(*) AS BIGINT) AS n FROM ann WHERE category IN ('text_block','title','list','list_item','header','footer','page_number','figure_caption','table_caption','page_footnote') GROUP BY category""", ann=ANN)
def p7_text_categories(spark, sf_dir):
    return profile.category_counts(ann(spark, sf_dir))


@query("""SELECT k AS key, CAST(sum(CAST(e AS INT)) AS BIGINT) AS n_empty FROM (
  SELECT 'attribute' AS k, doc_id % 3 = 2 AS e FROM documents UNION ALL
  SELECT 'attribute.line', doc_id % 3 = 1 FROM documents WHERE doc_id % 3 < 2 UNION ALL
  SELECT 'attribute.n', false FROM documents WHERE doc_id % 3 < 2 UNION ALL
  SELECT 'tags', doc_id % 3 = 2 FROM documents WHERE doc_id % 3 > 0 UNION ALL
  SELECT 'category_type', false FROM documents UNION ALL SELECT 'anno_id', false FROM documents) GROUP BY k""")
def p8_empty_values(spark, sf_dir):
    blocks = surrogates.blocks_json(table(spark, sf_dir, "documents"))
    keys = profile.unpivot(blocks, "ann", ["doc_id"])
    return keys.groupBy("key").agg(F.sum(profile.is_empty("value").cast("long")).alias("n_empty"))


@query("""SELECT doc_id, v AS value FROM (SELECT doc_id, unnest(['p', 'q']) AS v FROM documents WHERE doc_id % 3 = 1)""")
def p9_nested_values(spark, sf_dir):
    blocks = surrogates.blocks_json(table(spark, sf_dir, "documents"))
    return profile.values_at(blocks, "ann", ["tags"], ["doc_id"]).select("doc_id", profile.shown().alias("value"))


@query("""SELECT key, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN ['category_type','anno_id','attribute','attribute.line','attribute.n']
    WHEN 1 THEN ['category_type','anno_id','attribute','attribute.line','attribute.n','tags'] ELSE ['category_type','anno_id','attribute','tags'] END) AS key FROM documents) GROUP BY key""")
def p10_unpivot_keys(spark, sf_dir):
    return profile.unpivot(surrogates.blocks_json(table(spark, sf_dir, "documents")), "ann", ["doc_id"]).groupBy("key").agg(count())


@query("""SELECT file, anno_id, min_by(pos, pos) AS pos FROM ann WHERE anno_id = '1' GROUP BY file, anno_id""", ann=ANN)
def p11_first_by_id(spark, sf_dir):
    return ann(spark, sf_dir).filter("anno_id = '1'").groupBy("file", "anno_id").agg(F.min("pos").alias("pos"))


@query(r"SELECT page_id, regexp_replace(url, '[^\w\-_\. ]', '_', 'g') AS name FROM pages")
def p12_safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name("url").alias("name"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id AS INT) END AS page_no FROM documents""")
def p13_page_numbers(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a_"), "doc_id", F.lit(".json"))).otherwise(F.concat(F.lit("a_page_"), F.col("doc_id"), F.lit(".json")))
    return table(spark, sf_dir, "documents").select("doc_id", text.page_number(name).alias("page_no"))


@query(
    "SELECT c.category, color, CAST(('0x' || substr(color, 2, 2)) AS INT) AS r, CAST(('0x' || substr(color, 4, 2)) AS INT) AS g, CAST(('0x' || substr(color, 6, 2)) AS INT) AS b "
    "FROM (SELECT DISTINCT category FROM ann) x JOIN (VALUES ('title','#FF6347'),('text_block','#4169E1'),('figure','#2E8B57'),('table','#FFA500'),('chart','#343a40'),"
    "('header','#FF00FF'),('table_caption','#A52A2A'),('list_item','#343a40')) c(category, color) ON x.category = c.category",
    ann=ANN,
)
def p14_colors(spark, sf_dir):
    named = ann(spark, sf_dir).select("category").distinct().join(F.broadcast(rules.category_colors(spark)), "category", "left")
    full = named.withColumn("color", F.coalesce("color", F.lit(rules.CATEGORY_COLORS["default"]))).withColumn("c", text.rgb("color"))
    return full.select("category", "color", "c.r", "c.g", "c.b")


@query("SELECT file, CAST(count(*) AS BIGINT) AS n_annotations, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM ann GROUP BY file", ann=ANN)
def p15_file_metadata(spark, sf_dir):
    return profile.file_metadata(ann(spark, sf_dir)).withColumn("categories", F.array_join("categories", ","))


@query("""SELECT doc_id, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN '"x"' ELSE NULL END AS src FROM documents""")
def p16_relation_keys(spark, sf_dir):
    from quire.sources.pages import relations as read

    body = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('\"parent\":', doc_id, ',\"source_anno_id\":1') WHEN 1 THEN '\"source_anno_id\":\"x\"' ELSE '\"parent\":null,\"source_anno_id\":3' END")
    page = F.parse_json(F.concat(F.lit('{"extra":{"relation":[{'), body, F.lit("}]}}")))
    made = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), page.alias("page"))
    return read(made).select(F.col("file").alias("doc_id"), "src")


@query("SELECT DISTINCT file FROM rel WHERE relation_type IN ('truncated')", rel=REL)
def p17_files_with_relation(spark, sf_dir):
    return relations.files_with(rel(spark, sf_dir), ["truncated"])


@query("""SELECT issue, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'None' ELSE lang END AS issue FROM documents
  UNION ALL SELECT source FROM documents WHERE doc_id % 4 = 3) GROUP BY issue""")
def p18_issues(spark, sf_dir):
    listed = F.expr("CASE doc_id % 4 WHEN 0 THEN array() WHEN 3 THEN array(lang, source) ELSE array(lang) END")
    return table(spark, sf_dir, "documents").select(F.explode(profile.issues(listed)).alias("issue")).groupBy("issue").agg(count())


# Geometry


#: Blocks with the sides of their vertices' extent (eh) and their box: four numbers are a line, an odd polygon has no box.
_GEO = """SELECT *, CASE WHEN poly_len = 4 THEN 0.0 ELSE h END AS eh, CASE WHEN poly_len = 7 THEN 0.0 ELSE x1 END AS bx1, CASE WHEN poly_len = 7 THEN 0.0 ELSE y1 END AS by1,
  CASE WHEN poly_len = 7 THEN 0.0 ELSE x1 + w END AS bx2, CASE WHEN poly_len = 7 THEN 0.0 WHEN poly_len = 4 THEN y1 ELSE y1 + h END AS by2 FROM ann"""


@query("SELECT file, pos, w AS width, eh AS height, w * eh AS area, CASE WHEN eh > 0 THEN w / eh ELSE 0.0 END AS aspect FROM geo", ann=ANN, geo=_GEO)
def g1_extents(spark, sf_dir):
    return ann(spark, sf_dir).withColumn("e", geometry.extent("poly")).select("file", "pos", "e.width", "e.height", "e.area", "e.aspect")


@query("SELECT file, pos, bx1 AS x1, by1 AS y1, bx2 AS x2, by2 AS y2 FROM geo", ann=ANN, geo=_GEO)
def g2_boxes(spark, sf_dir):
    return ann(spark, sf_dir).withColumn("b", geometry.box("poly")).select("file", "pos", "b.*")


_CENTRE = "CASE WHEN {0}poly_len <> 7 THEN ({0}b{1}1 + {0}b{1}2) / 2 END"


@query(f"SELECT file, pos, {_CENTRE.format('', 'x')} AS x, {_CENTRE.format('', 'y')} AS y FROM geo", ann=ANN, geo=_GEO)
def g3_centres(spark, sf_dir):
    return ann(spark, sf_dir).withColumn("c", geometry.centre("poly")).select("file", "pos", "c.x", "c.y")


_PAIRS = """SELECT p.file, p.pos AS p_pos, c.pos AS c_pos,
  CASE WHEN p.poly_len = 8 AND c.poly_len = 8 AND c.w * c.h > 0 THEN greatest(0.0, least(p.x1 + p.w, c.x1 + c.w) - greatest(p.x1, c.x1)) * greatest(0.0, least(p.y1 + p.h, c.y1 + c.h) - greatest(p.y1, c.y1)) / (c.w * c.h) ELSE 0.0 END AS ioa
  FROM ann p JOIN ann c ON p.file = c.file AND p.category = 'figure' AND c.category = 'chart'"""


@query(f"SELECT file, p_pos, c_pos, round(ioa, 6) AS ioa FROM ({_PAIRS})", ann=ANN)
def g4_overlap(spark, sf_dir):
    a = ann(spark, sf_dir)
    p = a.filter("category = 'figure'").select("file", F.col("pos").alias("p_pos"), F.col("poly").alias("pp"))
    c = a.filter("category = 'chart'").select("file", F.col("pos").alias("c_pos"), F.col("poly").alias("cp"))
    return geometry.with_overlap(p.join(c, "file"), "pp", "cp").select("file", "p_pos", "c_pos", F.round("ioa", 6).alias("ioa"))


@query("""SELECT file, max(pos) AS pos FROM ann WHERE poly_len > 4 AND 200.5 > x1 AND 200.5 < x1 + w AND 300.5 > y1 AND 300.5 < y1 + h
  AND (poly_len = 8 OR (200.5 - x1) * h > (300.5 - y1) * w) GROUP BY file""", ann=ANN)
def g5_topmost_at_point(spark, sf_dir):
    hit = ann(spark, sf_dir).filter(geometry.has_point("poly", F.lit(200.5), F.lit(300.5)))
    return hit.groupBy("file").agg(F.max("pos").alias("pos"))


@query(f"""SELECT p.file, c.pos, p.bx1 <= c.bx1 AND p.by1 <= c.by1 AND p.bx2 >= c.bx2 AND p.by2 >= c.by2 AS inside,
  round(sqrt(power({_CENTRE.format('p.', 'x')} - {_CENTRE.format('c.', 'x')}, 2) + power({_CENTRE.format('p.', 'y')} - {_CENTRE.format('c.', 'y')}, 2)), 6) AS distance
  FROM geo p JOIN geo c ON p.file = c.file WHERE p.category = 'figure' AND c.category = 'chart'""", ann=ANN, geo=_GEO)
def g6_containment(spark, sf_dir):
    a = ann(spark, sf_dir).withColumns({"b": geometry.box("poly"), "m": geometry.centre("poly")})
    p = a.filter("category = 'figure'").select("file", F.col("b").alias("pb"), F.col("m").alias("pm"))
    both = p.join(a.filter("category = 'chart'"), "file")
    return both.select("file", "pos", geometry.contains_box(F.col("pb"), F.col("b")).alias("inside"), F.round(geometry.distance(F.col("pm"), F.col("m")), 6).alias("distance"))


@query("SELECT file, pos, greatest(0.0, bx1 - 50) AS x1, greatest(0.0, by1 - 50) AS y1, least(600.0, bx2 + 50) AS x2, least(800.0, by2 + 50) AS y2 FROM geo", ann=ANN, geo=_GEO)
def g7_crops(spark, sf_dir):
    cut = geometry.crop(geometry.box("poly"), 50.0, F.lit(600.0), F.lit(800.0))
    return ann(spark, sf_dir).withColumn("c", cut).select("file", "pos", "c.*")


@query("""SELECT file, pos, CAST(floor(bx1 / 1000.0 * 512) AS INT) AS x1, CAST(floor(by1 / 1400.0 * 512) AS INT) AS y1, CAST(floor(bx2 / 1000.0 * 512) AS INT) AS x2,
  CAST(floor(by2 / 1400.0 * 512) AS INT) AS y2 FROM geo""", ann=ANN, geo=_GEO)
def g8_canvas_boxes(spark, sf_dir):
    on = geometry.on_canvas(geometry.box("poly"), F.lit(0.0), F.lit(None).cast("double"))
    return ann(spark, sf_dir).withColumn("c", on).select("file", "pos", "c.*")


@query()
def g8_layout_vectors(spark, sf_dir):
    x, y = geometry.xs("poly"), geometry.ys("poly")
    corners = F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))
    on = geometry.on_canvas(corners, F.lit(0.0), F.lit(0.0))
    return geometry.layout_grid(ann(spark, sf_dir).filter("size(poly) >= 4 AND NOT ignored").select("file", on.alias("box")))


@query()
def g8_layout_canvases(spark, sf_dir):
    drawn = geometry.layout_canvas(ann(spark, sf_dir), F.lit(None).cast("double"), F.lit(0.0))
    return drawn.select("file", F.octet_length("pixels").alias("n_bytes"), F.sha2("pixels", 256).alias("sha256"))


#: Upright polygons as given and rectangles turned by a slope of 4 to 3, from any corner on.
_TURNED = """SELECT file, pos, false AS turned, poly_len, x1, y1, w, h, 0.0 AS a, 0.0 AS b FROM ann
  UNION ALL SELECT file, pos, true, 8, x1, y1, w, h, floor(w / 10) + 1, floor(h / 20) + 1 FROM ann"""
_QUADS = """SELECT file, pos, turned,
  CASE WHEN turned OR poly_len = 8 AND w * h * w * h > 9 * (w * w + h * h) THEN 'quad' WHEN poly_len = 8 THEN 'box' END AS kind,
  CASE WHEN turned THEN x1 - 4 * b ELSE x1 END AS left_x, CASE WHEN turned THEN y1 + 3 * b ELSE y1 END AS top_y,
  CASE WHEN turned THEN 5 * b ELSE w END AS qw, CASE WHEN turned THEN 5 * a ELSE h END AS qh,
  CASE WHEN turned THEN 0.8 ELSE 1.0 END AS c, CASE WHEN turned THEN 0.6 ELSE 0.0 END AS s FROM turned"""


@query(
    """SELECT file, pos, turned, kind, left_x AS x, top_y AS y, CAST(CASE kind WHEN 'quad' THEN qw ELSE qw + 1 END AS INT) AS width, CAST(CASE kind WHEN 'quad' THEN qh ELSE qh + 1 END AS INT) AS height,
  round(c * kx, 6) + 0.0 AS m0, round(-s * kx, 6) + 0.0 AS m1, round((s * top_y - c * left_x) * kx, 6) + 0.0 AS m2,
  round(s * ky, 6) + 0.0 AS m3, round(c * ky, 6) + 0.0 AS m4, round(-(s * left_x + c * top_y) * ky, 6) + 0.0 AS m5,
  CASE kind WHEN 'quad' THEN CAST(0 AS DOUBLE) END AS m6, CASE kind WHEN 'quad' THEN CAST(0 AS DOUBLE) END AS m7
  FROM (SELECT *, CASE kind WHEN 'quad' THEN (qw - 1) / qw END AS kx, CASE kind WHEN 'quad' THEN (qh - 1) / qh END AS ky FROM quads) WHERE kind IS NOT NULL""",
    ann=ANN,
    turned=_TURNED,
    quads=_QUADS,
)
def g9_quads(spark, sf_dir):
    a = ann(spark, sf_dir).select("file", "pos", "poly", "x1", "y1", (F.floor(F.col("w") / 10) + 1).alias("a"), (F.floor(F.col("h") / 20) + 1).alias("b"))
    x, y, p, q = F.col("x1"), F.col("y1"), F.col("a"), F.col("b")
    ring = F.array(*(v.cast("double") for v in (x, y, x + 3 * p, y + 4 * p, x + 3 * p - 4 * q, y + 4 * p + 3 * q, x - 4 * q, y + 3 * q)))
    first = 2 * F.pmod(F.col("pos"), F.lit(4))
    turned = F.concat(F.slice(ring, first + 1, 8 - first), F.slice(ring, F.lit(1), first))
    both = a.select("file", "pos", F.lit(False).alias("turned"), "poly").unionByName(a.select("file", "pos", F.lit(True).alias("turned"), turned.alias("poly")))
    found = both.withColumn("q", crops.quad("poly")).filter("q.kind IS NOT NULL")
    numbers = [(F.round(F.get("q.m", F.lit(i)), 6) + 0.0).alias(f"m{i}") for i in range(8)]
    return found.select("file", "pos", "turned", "q.kind", F.get("q.corners", F.lit(0)).alias("x"), F.get("q.corners", F.lit(1)).alias("y"), "q.width", "q.height", *numbers)


@query()
def g9_crops(spark, sf_dir):
    """Each block cut out of its page's drawn canvas, turned as in ``g9_quads``."""
    a = ann(spark, sf_dir)
    drawn = crops.layout_pictures(a, F.lit(None).cast("double"), F.lit(0.0))
    x, y = F.col("x1"), F.col("y1")
    ring = F.array(x, y, x + 60, y + 80, x - 20, y + 140, x - 80, y + 60).cast("array<double>")
    regions = a.select("file", "pos", F.when(F.col("pos") % 2 == 0, F.col("poly")).otherwise(ring).alias("poly"))
    found = crops.crops(drawn, regions, crops.layout_pixels, as_png=False)
    return found.select("file", "pos", "width", "height", F.sha2("content", 256).alias("sha256"), "error")


@query("""SELECT file, pos, round(x1 + 20 * cos(atan2(y1, x1) + 0.85 * pi()), 4) AS ax, round(y1 + 20 * sin(atan2(y1, x1) - 0.85 * pi()), 4) AS ay FROM ann""", ann=ANN)
def g10_arrow_heads(spark, sf_dir):
    start, end = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    made = ann(spark, sf_dir).withColumn("a", geometry.arrow_head(start, end))
    return made.select("file", "pos", F.round("a.x1", 4).alias("ax"), F.round("a.y2", 4).alias("ay"))


@query("SELECT file, pos, concat_ws(' ', CAST(CAST(x1 AS INT) AS VARCHAR), CAST(CAST(y1 AS INT) AS VARCHAR), CAST(CAST(x1 + 2 * w AS INT) AS VARCHAR), CAST(CAST(y1 + 3 * h AS INT) AS VARCHAR)) AS corners FROM ann", ann=ANN)
def g11_canvas_polygons(spark, sf_dir):
    poly = geometry.rect_poly(F.col("x1"), F.col("y1"), F.col("w"), F.col("h"), F.lit(2.0), F.lit(3.0))
    whole = F.transform(F.array(poly[0], poly[1], poly[4], poly[5]), lambda v: v.cast("int").cast("string"))
    return ann(spark, sf_dir).select("file", "pos", F.array_join(whole, " ").alias("corners"))


# Validation


@query("""SELECT file, category, anno_id, 'missing_key' AS rule_id, 'ERROR' AS severity, k AS detail FROM (
  SELECT *, unnest(CASE category WHEN 'table' THEN ['html','table_edit_status','attribute.line','attribute.table_layout','attribute.language']
    WHEN 'figure' THEN ['attribute.contains_elements','sub_regions'] ELSE ['html','attribute.chart_type','attribute.language','attribute.is_indexed'] END) AS k
  FROM ann WHERE category IN ('table','figure','chart'))
  WHERE NOT (k = 'html' AND html IS NOT NULL) AND NOT (k IN ('attribute.line','attribute.language') AND has_line)""", ann=ANN)
def v1_missing_keys(spark, sf_dir):
    return validate.missing_keys(ann(spark, sf_dir), rules.required_keys(spark))


@query(_INVALID_POLY, ann=ANN)
def v2_invalid_polys(spark, sf_dir):
    return validate.invalid_polys(ann(spark, sf_dir))


@query(_EMPTY_TEXT, ann=ANN)
def v3_empty_texts(spark, sf_dir):
    return validate.empty_texts(ann(spark, sf_dir))


@query("""SELECT file, category, anno_id, 'empty_html' AS rule_id, CASE WHEN category = 'table' AND NOT ignored THEN 'ERROR' ELSE 'WARNING' END AS severity, CAST(NULL AS VARCHAR) AS detail
  FROM ann WHERE (html IS NULL OR trim(html) = '') AND (category = 'table' OR html IS NOT NULL)""", ann=ANN)
def v4_empty_html(spark, sf_dir):
    return validate.empty_html(ann(spark, sf_dir))


_FORMULAS = """SELECT file, category, anno_id, f FROM (SELECT *, unnest(list_concat(list_concat(CASE WHEN latex IS NULL THEN [] ELSE [latex] END, regexp_extract_all(coalesce(text, ''), '(?s)\\$\\$(.+?)\\$\\$', 1)), regexp_extract_all(coalesce(text, ''), '\\$(.+?)\\$', 1))) AS f FROM ann)"""


#: What the planted formulas do not parse for, and where.
_FAULT = (
    "CASE WHEN contains(f, '+ ' || chr(123)) THEN concat(chr(123), ' is not closed at ', strpos(f, chr(123)) - 1) "
    + " ".join(
        f"WHEN contains(f, chr(92) || '{sign}') THEN concat(chr(92), '{what}', ' at ', strpos(f, chr(92) || '{sign}') - 1)".replace("<", "' || chr(123) || '").replace(">", "' || chr(125) || '").replace("^", "' || chr(92) || '")
        for sign, what in (("frac", "frac lacks an argument"), ("begin", "begin<a> is not closed"), ("left(", "left is not closed"), ("right)", "right without ^left"), ("end", "end<a> without ^begin<a>"))
    )
    + " END"
)


@query(
    f"""SELECT file, category, anno_id, rule_id, severity, detail FROM (
  SELECT *, 'latex_empty_formula' AS rule_id, 'ERROR' AS severity, CAST(NULL AS VARCHAR) AS detail FROM ({_FORMULAS}) WHERE trim(f) = ''
  UNION ALL SELECT *, 'latex_unmatched_braces', 'ERROR', NULL FROM ({_FORMULAS}) WHERE contains(f, '+ ' || chr(123))
  UNION ALL SELECT *, 'latex_unmatched_brackets', 'ERROR', NULL FROM ({_FORMULAS}) WHERE contains(f, 'x]')
  UNION ALL SELECT *, 'latex_invalid_command', 'ERROR', {_FAULT} FROM ({_FORMULAS}) WHERE {_FAULT} IS NOT NULL
  UNION ALL SELECT *, 'latex_invalid_command', 'WARNING', 'foo' FROM ({_FORMULAS}) WHERE contains(f, chr(92) || 'foo') AND {_FAULT} IS NULL)""",
    ann=ANN,
)
def v5_formula_findings(spark, sf_dir):
    return validate.formula_findings(ann(spark, sf_dir))


@query(r"""SELECT file, category, anno_id, 'missing_inlinelatex' AS rule_id, 'WARNING' AS severity,
  CASE WHEN regexp_matches(t, '[a-zA-Z][0-9]_[a-zA-Z0-9]') THEN regexp_extract(t, '[a-zA-Z][0-9]_[a-zA-Z0-9]')
       WHEN regexp_matches(t, '[a-zA-Z]\^[a-zA-Z0-9]') THEN regexp_extract(t, '[a-zA-Z]\^[a-zA-Z0-9]')
       WHEN regexp_matches(t, '\\[a-zA-Z]+') THEN regexp_extract(t, '\\[a-zA-Z]+')
       WHEN regexp_matches(t, '[0-9]+\s*[xX]\s*[0-9]+') THEN regexp_extract(t, '[0-9]+\s*[xX]\s*[0-9]+')
       ELSE regexp_extract(t, '[a-zA-Z0-9]+/[a-zA-Z0-9]+') END AS detail
  FROM (SELECT *, regexp_replace(text, '\$.*?\$', ' ', 'g') AS t FROM ann WHERE category IN ('text_block','table_caption','chart_caption') AND text <> '')
  WHERE regexp_matches(t, '[a-zA-Z][0-9]_[a-zA-Z0-9]|[a-zA-Z]\^[a-zA-Z0-9]|\\[a-zA-Z]+|[0-9]+\s*[xX]\s*[0-9]+|[a-zA-Z0-9]+/[a-zA-Z0-9]+')""", ann=ANN)
def v6_missing_inline_markup(spark, sf_dir):
    return validate.missing_inline_markup(ann(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def v7_duplicate_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("anno_id"))
    found = validate.duplicate_ids(lines)
    return found.select(F.col("file").alias("l_orderkey"), F.col("anno_id").cast("int").alias("l_linenumber"), F.col("detail").cast("long").alias("n"))


@query("SELECT file, 'relation' AS category, src AS anno_id, 'self_referencing_relation' AS rule_id, 'ERROR' AS severity, CAST(NULL AS VARCHAR) AS detail FROM rel WHERE src = tgt", rel=REL)
def v8_self_references(spark, sf_dir):
    return validate.self_references(rel(spark, sf_dir))


_LAST = "SELECT file, anno_id, max_by(category, pos) AS category FROM ann GROUP BY file, anno_id"


@query(
    f"""SELECT t.file, 'table' AS category, t.anno_id, 'table_include_attr_relation_mismatch' AS rule_id, 'ERROR' AS severity,
  concat(f.flag, CASE WHEN says THEN ' without relation' ELSE ' not set' END) AS detail
  FROM (SELECT a.*, flag, child, CASE flag WHEN 'include_photo' THEN include_photo WHEN 'include_chart' THEN include_chart ELSE false END AS says
        FROM ann a, (VALUES ('include_photo','figure'),('include_chart','chart'),('include_table','table')) v(flag, child) WHERE category = 'table') t
  JOIN (VALUES ('include_photo'),('include_chart'),('include_table')) f(flag) ON t.flag = f.flag
  WHERE says <> EXISTS (SELECT 1 FROM rel r JOIN ({_LAST}) b ON b.file = r.file AND b.anno_id = r.tgt WHERE r.file = t.file AND r.src = t.anno_id AND contains(r.relation_type, 'parent_son') AND b.category = t.child)""",
    ann=ANN,
    rel=REL,
)
def v9_include_mismatches(spark, sf_dir):
    return validate.include_mismatches(ann(spark, sf_dir), rel(spark, sf_dir))


@query(r"""SELECT file, 'table' AS category, anno_id, 'table_html_invalid_anno_ref' AS rule_id, 'ERROR' AS severity, ref AS detail FROM (
  SELECT DISTINCT doc_id, file, anno_id, ref FROM (SELECT doc_id, file, anno_id, CAST(CAST(unnest(list_concat(regexp_extract_all(html, '\$\$[^$]*_(\d+)\$\$', 1), regexp_extract_all(html, '(?i)anno_id(?:_|[^\d]*?)\s*(\d+)', 1))) AS INT) AS VARCHAR) AS ref
  FROM ann WHERE category = 'table')) x WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.file = x.file AND a.anno_id = x.ref)""", ann=ANN)
def v10_dangling_references(spark, sf_dir):
    return validate.dangling_references(ann(spark, sf_dir))


def _inside_sql(parent: str, children: str) -> str:
    return f"""SELECT p.file, p.category, p.anno_id, p.html, c.anno_id AS child FROM ann p JOIN ann c ON p.file = c.file AND p.anno_id <> c.anno_id
      WHERE p.category = '{parent}' AND c.category IN ({children}) AND p.poly_len = 8 AND c.poly_len = 8 AND c.w * c.h > 0
      AND greatest(0.0, least(p.x1 + p.w, c.x1 + c.w) - greatest(p.x1, c.x1)) * greatest(0.0, least(p.y1 + p.h, c.y1 + c.h) - greatest(p.y1, c.y1)) / (c.w * c.h) >= 0.9"""


@query(
    rf"""SELECT file, category, anno_id, 'table_html_missing_spatial_ref' AS rule_id, 'ERROR' AS severity, child AS detail FROM ({_inside_sql("table", "'figure','chart','table'")}) x
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT file, anno_id, CAST(CAST(unnest(regexp_extract_all(html, '(?i)anno_id(?:_|[^\d]*?)\s*(\d+)', 1)) AS INT) AS VARCHAR) AS ref FROM ann WHERE category = 'table') r
    WHERE r.file = x.file AND r.anno_id = x.anno_id AND r.ref = x.child)""",
    ann=ANN,
)
def v11_missing_table_references(spark, sf_dir):
    return validate.missing_table_references(ann(spark, sf_dir))


_FIGURE = f"""SELECT file, category, anno_id, 'missing_figure_dependency' AS rule_id, 'ERROR' AS severity, child AS detail FROM ({_inside_sql("figure", "'text_block','table','chart'")}) x
  WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.file = x.file AND r.src = x.anno_id AND r.tgt = x.child)
  AND NOT EXISTS (SELECT 1 FROM ann s WHERE s.category = 'figure' AND s.doc_id % 3 = 0 AND s.file = x.file AND s.anno_id = x.anno_id AND x.child = '4')"""


def _figures(spark, sf_dir):
    a = ann(spark, sf_dir)
    return a, rel(spark, sf_dir), surrogates.sub_regions(a)


@query(_FIGURE, ann=ANN, rel=REL)
def v12_missing_figure_dependencies(spark, sf_dir):
    return validate.missing_figure_dependencies(*_figures(spark, sf_dir))


_DUPLICATES = "SELECT file, 'document' AS category, anno_id, 'duplicate_anno_id' AS rule_id, 'ERROR' AS severity, CAST(count(*) AS VARCHAR) AS detail FROM ann GROUP BY file, anno_id HAVING count(*) > 1"
_ONE_RULE = (
    "v1_missing_keys", "v2_invalid_polys", "v3_empty_texts", "v4_empty_html", "v5_formula_findings", "v6_missing_inline_markup",
    "v8_self_references", "v9_include_mismatches", "v10_dangling_references", "v11_missing_table_references", "v12_missing_figure_dependencies",
)
_FINDINGS = " UNION ALL ".join(f"SELECT file, category, anno_id, rule_id, severity, detail FROM ({q})" for q in (_DUPLICATES, *(BODIES[name] for name in _ONE_RULE)))


def _findings(spark, sf_dir):
    return validate.findings(*_figures(spark, sf_dir))


@query(_FINDINGS, ann=ANN, rel=REL)
def v13_all_findings(spark, sf_dir):
    return _findings(spark, sf_dir)


@query(f"SELECT * FROM ({_FINDINGS}) WHERE severity IN ('ERROR') AND category IN ('title', 'header')", ann=ANN, rel=REL)
def p4_facets(spark, sf_dir):
    return validate.facets(_findings(spark, sf_dir), ["ERROR"], ["title", "header"])


@query(f"SELECT DISTINCT category FROM ({_FINDINGS})", ann=ANN, rel=REL)
def p5_facet_values(spark, sf_dir):
    return validate.facet_values(_findings(spark, sf_dir), "category")


@query("""SELECT a.file, a.pos, a.anno_id FROM ann a WHERE category = 'title' AND (a.file, a.anno_id) IN (SELECT (file, anno_id) FROM found UNION ALL SELECT (file, detail) FROM found WHERE rule_id IN ('table_html_missing_spatial_ref', 'missing_figure_dependency'))""", ann=ANN, rel=REL, found=_FINDINGS)
def p6_flagged_annotations(spark, sf_dir):
    return validate.flagged_annotations(ann(spark, sf_dir), _findings(spark, sf_dir), "title").select("file", "pos", "anno_id")


@query(f"SELECT file, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT detail, ',' ORDER BY detail) AS children FROM ({_FIGURE}) GROUP BY file", ann=ANN, rel=REL)
def v14_figure_check(spark, sf_dir):
    return validate.figure_check(*_figures(spark, sf_dir)).withColumn("children", F.array_join("children", ","))


@query(f"SELECT * FROM ({_FINDINGS}) WHERE file = 'PP_0.json' AND (anno_id = '1' OR detail = '1')", ann=ANN, rel=REL)
def v15_findings_of_block(spark, sf_dir):
    return validate.findings_of(_findings(spark, sf_dir), "PP_0.json", "1")


@query(f"SELECT file, CAST(count(*) AS BIGINT) AS n FROM ({_EMPTY_TEXT}) GROUP BY file", ann=ANN)
def v16_empty_text_files(spark, sf_dir):
    return validate.empty_texts(ann(spark, sf_dir)).groupBy("file").agg(count())


@query(r"SELECT file, pos, array_to_string(list_concat(regexp_extract_all(text, '(?s)\$\$(.+?)\$\$', 1), regexp_extract_all(text, '\$(.+?)\$', 1)), '|') AS formulas FROM ann WHERE contains(text, '$')", ann=ANN)
def l1_formulas(spark, sf_dir):
    return ann(spark, sf_dir).filter("contains(text, '$')").select("file", "pos", F.array_join(latex.formulas("text"), "|").alias("formulas"))


_WORST = f"CASE WHEN contains(f, 'x]') OR trim(f) = '' OR {_FAULT} IS NOT NULL THEN 2 WHEN contains(f, chr(92) || 'foo') THEN 1 ELSE 0 END"


@query(f"SELECT file, anno_id, CASE max(w) WHEN 2 THEN 'red' ELSE 'yellow' END AS badge FROM (SELECT *, {_WORST} AS w FROM ({_FORMULAS})) WHERE w > 0 GROUP BY file, anno_id", ann=ANN)
def l7_badges(spark, sf_dir):
    return latex.badge(validate.formula_findings(ann(spark, sf_dir)), ["file", "anno_id"])


@query(r"SELECT doc_id, CAST(strpos(text, '$') AS INT) AS start, substr(text, greatest(1, strpos(text, '$') - 39), CAST(least(40, strpos(text, '$')) + 41 AS INT)) AS around FROM documents WHERE contains(text, '$')")
def l8_snippets(spark, sf_dir):
    some = table(spark, sf_dir, "documents").filter("contains(text, '$')").withColumn("start", F.instr("text", "$"))
    return some.select("doc_id", "start", latex.snippet("text", F.col("start"), F.col("start") + 1).alias("around"))


# Outliers

_DIM = "(VALUES ('src0','en',400,5000),('src0','fr',300,4000),('DEFAULT','en',500,6000),('DEFAULT','de',700,3000),('DEFAULT','fr',100,9000)) d(doc_type, category, min_len, max_len)"
_LENGTHS = {"src0": {"en": (400, 5000), "fr": (300, 4000)}, "DEFAULT": {"en": (500, 6000), "de": (700, 3000), "fr": (100, 9000)}}


@query(f"""SELECT doc_id, source AS doc_type, lang AS category, CAST(length(text) AS INT) AS length, CASE WHEN length(text) < coalesce(o.min_len, b.min_len) THEN 'Too short' ELSE 'Too long' END AS issue
  FROM documents x LEFT JOIN (SELECT * FROM {_DIM}) o ON o.doc_type = x.source AND o.category = x.lang LEFT JOIN (SELECT * FROM {_DIM} WHERE doc_type = 'DEFAULT') b ON b.category = x.lang
  WHERE length(text) < coalesce(o.min_len, b.min_len) OR length(text) > coalesce(o.max_len, b.max_len)""")
def o1_text_outliers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc_type"), F.col("lang").alias("category"), "text")
    return outliers.text_lengths(docs, rules.text_length_rules(spark, _LENGTHS)).select("doc_id", "doc_type", "category", "length", "issue")


@query("""SELECT file, pos, category, round(w * eh / 1400000.0 * 100, 6) AS area_percent FROM geo a
  JOIN (VALUES ('title',0.01,0.2,2.0,15.0),('text_block',0.01,0.6,0.3,5.0),('figure',0.05,0.7,0.3,3.0),('table',0.05,0.8,0.3,5.0),('chart',0.05,0.7,0.5,3.0)) r(c, lo, hi, alo, ahi) ON r.c = a.category
  WHERE w * eh / 1400000.0 < lo OR w * eh / 1400000.0 > hi OR CASE WHEN eh > 0 THEN w / eh ELSE 0 END < alo OR CASE WHEN eh > 0 THEN w / eh ELSE 0 END > ahi""", ann=ANN, geo=_GEO)
def o2_box_outliers(spark, sf_dir):
    pages = ann(spark, sf_dir).withColumns(
        {"doc_type": text.type_by_first_token("file", [*rules.DOC_TYPES]), "page_width": F.lit(1000.0), "page_height": F.lit(1400.0)}
    )
    found = outliers.box_sizes(pages, rules.bbox_size_rules(spark))
    return found.select("file", "pos", "category", F.round("area_percent", 6).alias("area_percent"))


# Relations, profiles and counts

_ENDS = f"SELECT r.*, a.category AS category1, b.category AS category2 FROM rel r JOIN ({_LAST}) a ON a.file = r.file AND a.anno_id = r.src JOIN ({_LAST}) b ON b.file = r.file AND b.anno_id = r.tgt"


@query(f"SELECT relation_type, category1, category2, CAST(count(*) AS BIGINT) AS n, min(file) AS example FROM ({_ENDS}) GROUP BY relation_type, category1, category2", ann=ANN, rel=REL)
def a6_relation_patterns(spark, sf_dir):
    return relations.patterns(relations.endpoints(rel(spark, sf_dir), ann(spark, sf_dir)))


@query(f"SELECT relation_type, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_patterns FROM (SELECT relation_type, category1, category2, count(*) AS n FROM ({_ENDS}) GROUP BY ALL) GROUP BY relation_type", ann=ANN, rel=REL)
def j1_relation_totals(spark, sf_dir):
    return relations.totals(relations.patterns(relations.endpoints(rel(spark, sf_dir), ann(spark, sf_dir))))


_KEYS = """SELECT category, file, unnest(CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN ['category_type','anno_id','attribute','attribute.line','attribute.n']
  WHEN 1 THEN ['category_type','anno_id','attribute','attribute.line','attribute.n','tags'] ELSE ['category_type','anno_id','attribute','tags'] END) AS key, doc_id
  FROM (SELECT doc_id, lang AS category, concat('f', CAST(doc_id % 50 AS STRING)) AS file FROM documents)"""
_PROFILE = f"""SELECT k.category, 'block' AS location, key, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN (key IN ('attribute','tags') AND doc_id % 3 = 2) OR (key = 'attribute.line' AND doc_id % 3 = 1) THEN 1 ELSE 0 END) AS BIGINT) AS n_empty, min(file) AS first_file, any_value(n_blocks) AS n_blocks
  FROM ({_KEYS}) k JOIN (SELECT lang AS category, CAST(count(*) AS BIGINT) AS n_blocks FROM documents GROUP BY lang) b ON b.category = k.category GROUP BY k.category, key"""


def _blocks(spark, sf_dir):
    return surrogates.blocks_json(table(spark, sf_dir, "documents")).withColumn("location", F.lit("block"))


@query(_PROFILE)
def a1_category_profile(spark, sf_dir):
    return profile.category_profile(_blocks(spark, sf_dir))


@query(f"SELECT category, key, n = n_blocks AS always, CASE WHEN n_empty = n THEN 'always empty' WHEN n <> n_blocks THEN concat('found in only ', CAST(n AS VARCHAR), ' of ', CAST(n_blocks AS VARCHAR)) END AS remark FROM ({_PROFILE})")
def a2_key_remarks(spark, sf_dir):
    return profile.key_remarks(profile.category_profile(_blocks(spark, sf_dir))).select("category", "key", "always", "remark")


_TYPES = """SELECT lang AS category, key, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (
  SELECT lang, 'category_type' AS key, 'str' AS t FROM documents UNION ALL SELECT lang, 'anno_id', 'int' FROM documents
  UNION ALL SELECT lang, 'attribute', CASE WHEN doc_id % 3 = 2 THEN 'NoneType' ELSE 'dict' END FROM documents
  UNION ALL SELECT lang, 'attribute.line', 'str' FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT lang, 'attribute.n', CASE WHEN doc_id % 3 = 0 THEN 'int' ELSE 'str' END FROM documents WHERE doc_id % 3 < 2
  UNION ALL SELECT lang, 'tags', 'list' FROM documents WHERE doc_id % 3 > 0) GROUP BY lang, key"""


@query(_TYPES)
def a3_key_types(spark, sf_dir):
    return profile.key_types(_blocks(spark, sf_dir), "ann", ["category"])


@query(f"SELECT category, string_agg(concat(key, ': ', types), '; ' ORDER BY concat(key, ': ', types)) AS key_types FROM ({_TYPES}) GROUP BY category")
def a4_category_report(spark, sf_dir):
    return profile.category_report(_blocks(spark, sf_dir)).select("category", "key_types")


@query("""SELECT path, value, n, CAST(count(*) OVER (PARTITION BY path) AS BIGINT) AS n_distinct FROM (
  SELECT 'category_type' AS path, lang AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang
  UNION ALL SELECT 'attribute.n', CASE WHEN doc_id % 3 = 0 THEN '1' ELSE 'x' END, count(*) FROM documents WHERE doc_id % 3 < 2 GROUP BY 2
  UNION ALL SELECT 'tags', unnest(['p', 'q']), count(*) FROM documents WHERE doc_id % 3 = 1 GROUP BY 2)""")
def a5_value_distribution(spark, sf_dir):
    found = profile.value_distribution(_blocks(spark, sf_dir), "ann", [["category_type"], ["attribute", "n"], ["tags"]], "file")
    return found.select("path", "value", "n", "n_distinct")


@query("""SELECT 'lang' AS key, lang AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
  UNION ALL SELECT 'special_issue', i, count(*) FROM (SELECT unnest(CASE WHEN doc_id % 4 = 0 THEN ['None'] ELSE [lang, source] END) AS i FROM documents) GROUP BY i""")
def a7_page_info(spark, sf_dir):
    issue = profile.issues(F.expr("CASE WHEN doc_id % 4 = 0 THEN array() ELSE array(lang, source) END"))
    docs = table(spark, sf_dir, "documents").select("lang", "source", issue.alias("special_issue"))
    return profile.value_counts(docs, ["lang", "source", "special_issue"])


@query("""SELECT role, CAST(count(DISTINCT CASE WHEN contains(text, 'thro') THEN conv_id END) AS BIGINT) AS n, round(100.0 * count(DISTINCT CASE WHEN contains(text, 'thro') THEN conv_id END) / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS percent
  FROM conversations GROUP BY role""")
def a8_share_by_group(spark, sf_dir):
    return profile.share_by_group(table(spark, sf_dir, "conversations"), "role", "conv_id", F.contains("text", F.lit("thro"))).select("role", "n", "percent")


@query("""SELECT layout, CAST(max(c) AS BIGINT) AS n, string_agg(concat(file, ': ', CASE WHEN length(html) > 500 THEN concat(substr(html, 1, 500), '...') ELSE html END), chr(10) ORDER BY file) AS examples FROM (
  SELECT lang AS layout, CAST(doc_id AS VARCHAR) AS file, text AS html, count(*) OVER (PARTITION BY lang) AS c, row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR)) AS r
  FROM documents WHERE lang <> '') WHERE r <= 3 GROUP BY layout""")
def a9_table_layouts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("lang").alias("layout"), F.col("text").alias("html"))
    shown = F.transform("examples", lambda e: F.concat(e["file"], F.lit(": "), e["html"]))
    return profile.table_layouts(docs).select("layout", "n", F.array_join(shown, "\n").alias("examples"))


@query("SELECT category, CAST(count(*) AS BIGINT) AS n FROM ann WHERE order_no IS NULL GROUP BY category", ann=ANN)
def a10_null_orders(spark, sf_dir):
    return profile.null_orders(ann(spark, sf_dir))


@query("""SELECT 'severity' AS kind, severity AS value, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY severity
  UNION ALL SELECT 'category', category, count(*) FROM found WHERE severity = 'ERROR' GROUP BY category
  UNION ALL SELECT 'rule', rule_id, count(*) FROM found WHERE severity = 'ERROR' GROUP BY rule_id
  UNION ALL (SELECT 'files', file, count(*) AS n FROM found GROUP BY file ORDER BY n DESC, file LIMIT 10)""", ann=ANN, rel=REL, found=_FINDINGS)
def a11_validation_summary(spark, sf_dir):
    return validate.summary(_findings(spark, sf_dir))


@query("SELECT ch, n, ascii_ok FROM (SELECT ch, CAST(count(*) AS BIGINT) AS n, ch NOT BETWEEN ' ' AND '~' AND ch NOT IN ('·','’','“','”','‘','•','…','–','—','°','±','×','÷') AS ascii_ok FROM (SELECT unnest(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)".replace("ascii_ok", "missing"))
def a18_characters(spark, sf_dir):
    return profile.characters(table(spark, sf_dir, "documents"))


@query("SELECT ch, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch NOT BETWEEN ' ' AND '~' AND ch > ' ' AND ch NOT IN ('·','’','“','”','‘','•','…','–','—','°','±','×','÷') AND ch <> '' GROUP BY ch HAVING count(*) >= 5")
def u4_significant_missing(spark, sf_dir):
    chars = profile.characters(table(spark, sf_dir, "documents")).filter("ch > ' '")
    return profile.missing_characters(chars).filter("significant").select("ch", "n")


#: White space of any script, at both ends.
_OUTER = r"^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SPECIAL = "regexp_extract_all(' !\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~·’“”‘•…–—°±×÷0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '.')"


@query(f"""SELECT unnest({_SPECIAL}) AS ch UNION SELECT chr(CAST(i AS INT)) FROM generate_series(44032, 55203) AS s(i)
  UNION SELECT ch FROM (SELECT unnest(string_split(regexp_replace(text, '{_OUTER}|{_OUTER[1:]}$', '', 'g'), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch HAVING count(*) >= 5""")
def k10_extended_charset(spark, sf_dir):
    chars = profile.characters(table(spark, sf_dir, "documents"))
    return profile.extended_charset(chars, profile.base_charset(chars))


@query("SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN category NOT IN ('title','header','footer','page_number','figure_caption','table_caption','page_footnote','list_item') THEN concat('CAT_EXCLUDED(', category, ')') WHEN text IS NULL OR trim(text) = '' THEN 'TEXT_EMPTY' WHEN w <= 0 OR h <= 0 THEN 'CROP_EMPTY' WHEN w < 5 OR h < 5 THEN 'TOO_SMALL' WHEN w / h < 2.5 THEN 'LOW_ASPECT' WHEN length(text) > 200 THEN 'TEXT_TOO_LONG' END AS reason FROM ann) WHERE reason IS NOT NULL GROUP BY reason", ann=ANN)
def a19_skip_reasons(spark, sf_dir):
    reason = sampling.training_reason(F.col("category"), F.col("text"), F.col("w"), F.col("h"))
    return sampling.skip_reasons(ann(spark, sf_dir).withColumn("reason", reason))


@query(r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(concat(html, '<img src=anno_id_', page_id % 30, '> $$fig_', page_id % 7, '$$'), '(?i)anno_id(?:_|[^\d]*?)\s*(\d+)', 1))), ',') AS refs FROM pages")
def a23_html_references(spark, sf_dir):
    html = F.concat("html", F.lit("<img src=anno_id_"), (F.col("page_id") % 30).cast("string"), F.lit("> $$fig_"), (F.col("page_id") % 7).cast("string"), F.lit("$$"))
    refs = validate.html_references(html, validate.REFERENCE_MARKS[1:])
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(refs), ",").alias("refs"))


# Text


def _text_pairs(spark, sf_dir, a: str = "a", b: str = "b"):
    """Each document's text with that of the next."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias(a))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col(a).alias(b))
    return spread(docs, "doc_id").join(spread(following, "doc_id"), "doc_id")


@query()
def t1_similarity(spark, sf_dir):
    pairs = _text_pairs(spark, sf_dir, "gt_text", "ocr_text")
    return evaluate.compare(pairs).select("doc_id", F.round("similarity", 6).alias("similarity"), "band")


@query("SELECT lang, CASE WHEN s >= 0.9 THEN 'Pass' WHEN s >= 0.5 THEN 'Warning' ELSE 'Fail' END AS band, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, CAST(doc_id % 101 AS DOUBLE) / 100 AS s FROM documents) GROUP BY ALL")
def t3_bands(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("lang", text.band((F.col("doc_id") % 101).cast("double") / 100).alias("band"))
    return scored.groupBy("lang", "band").agg(count())


@query()
def t2_similarity_as_given(spark, sf_dir):
    pairs = _text_pairs(spark, sf_dir).withColumn("b", F.concat(F.col("b"), F.lit(" \n")))
    return pairs.select("doc_id", F.round(text.ratio_as_given("a", "b"), 6).alias("similarity"))


@query()
def t4_character_errors(spark, sf_dir):
    pairs = _text_pairs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("a")).alias("a"), "b")
    return pairs.select("doc_id", F.round(text.character_error_rate("a", "b"), 6).alias("cer"))


@query()
def a21_accuracy(spark, sf_dir):
    found = evaluate.accuracy(_text_pairs(spark, sf_dir), "a", "b")
    return found.select(F.round("mean_cer", 6).alias("mean_cer"), F.round("exact_match", 6).alias("exact_match"), "n")


@query()
def t8_rewrite_changes(spark, sf_dir):
    return rewrite.changes(ann(spark, sf_dir), ["file", "pos"], ["text", "html"])


@query("""SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '$abc$' WHEN 1 THEN '$A$의' WHEN 2 THEN '점 $...$' ELSE '' END AS found FROM documents""")
def t9_suspicious(spark, sf_dir):
    made = F.expr("CASE doc_id % 4 WHEN 0 THEN '$abc$ and $x$' WHEN 1 THEN '$A$의 $B$라' WHEN 2 THEN '점 $Q$ ' ELSE 'plain $y$' END")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rewrite.suspicious(made), "|").alias("found"))


@query(r"""SELECT page_id, concat('<p><span class="badge">ID ', CAST(page_id AS VARCHAR), '</span></p>') AS shown FROM pages""")
def t10_badge_preview(spark, sf_dir):
    html = F.concat(F.lit('<p><IMG src="anno_id_'), "page_id", F.lit('"></p>'))
    return table(spark, sf_dir, "pages").select("page_id", text.badge_preview(html).alias("shown"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(replace(concat(' $$', text, '$$ '), '$$', ''), '{_OUTER}', ''), '{_OUTER[1:]}$', '') AS shown FROM documents")
def t11_without_dollars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.without_dollars(F.concat(F.lit(" $$"), "text", F.lit("$$ "))).alias("shown"))


@query("SELECT doc_id, regexp_replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '^\\s+|\\s+$', '', 'g') AS line FROM documents")
def t12_flattened(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.flattened("text").alias("line"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def t13_joined_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return rows.select("conv_id", F.array_join("r.text", " ").alias("joined"))


@query("SELECT ch, concat('U+', upper(lpad(to_hex(unicode(ch)), 4, '0'))) AS label FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''")
def t14_code_labels(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").distinct()
    return chars.select("ch", text.code_label("ch").alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substr(replace(text, chr(10), ' '), 1, 100), '...') ELSE replace(text, chr(10), ' ') END AS shown FROM documents")
def t15_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("shown"))


# Vectors

THRESHOLD = 0.40
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_EDGES = f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {_COS} > {THRESHOLD}"
_CLUSTERS = f"""edges AS ({_EDGES}), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
  reach(id, far) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.far),
  found AS (SELECT id, cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS INT) AS pos, CAST(count(*) OVER (PARTITION BY cluster_id) AS BIGINT) AS size, id = cluster_id AS is_rep
            FROM (SELECT CAST(id AS BIGINT) AS id, CAST(min(far) AS BIGINT) AS cluster_id FROM reach GROUP BY id))"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")


def _best(k: int, of: str = "true") -> str:
    """The k best vectors of every fiftieth one."""
    return f"""SELECT query, vec_id, round(score, 6) AS score FROM (SELECT b.vec_id AS query, a.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS r
      FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b WHERE {of}) WHERE r <= {k}"""


@query(_best(5))
def d5_top_k(spark, sf_dir):
    return vectors.top_k_each(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query()
def d10_index_search(spark, sf_dir):
    """The ten vectors most like every fiftieth one, by an index of all vectors written for it."""
    index = vector_index.build(table(spark, sf_dir, "embeddings"), f"{shared_dir(spark)}/quire/index-{uuid.uuid4().hex}")
    return vector_index.search(index, _asked(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(_best(10, "a.label = 3"))
def d7_top_k_of_label(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.search({1: v, 3: v}, 3, _asked(spark, sf_dir), label=3).withColumn("score", F.round("score", 6))


@query(f"SELECT a, b FROM ({_EDGES})")
def j9_similar_pairs(spark, sf_dir):
    return vectors.similar_pairs(table(spark, sf_dir, "embeddings"), THRESHOLD).select("a", "b")


def _clusters(spark, sf_dir):
    return vectors.clusters(table(spark, sf_dir, "embeddings"), THRESHOLD)


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM found")
def d4_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(f"WITH RECURSIVE {_CLUSTERS}, o AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS n FROM found WHERE size > 1 AND is_rep) SELECT concat('CLUSTER_', lpad(CAST(n AS VARCHAR), 4, '0')) AS cluster, id, pos, size, CASE WHEN is_rep THEN 'Keep' ELSE 'Remove/Check' END AS action FROM found JOIN o USING (cluster_id) WHERE size > 1")
def d9_dedup_report(spark, sf_dir):
    return vectors.dedup_report(_clusters(spark, sf_dir))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CAST(is_rep AS INT)) AS BIGINT) AS unique_docs, CAST(count(*) - sum(CAST(is_rep AS INT)) AS BIGINT) AS duplicates, round(100.0 * (count(*) - sum(CAST(is_rep AS INT))) / count(*), 6) AS dup_rate, round(count(*) / CAST(sum(CAST(is_rep AS INT)) AS DOUBLE), 6) AS compression FROM found")
def a12_cluster_metrics(spark, sf_dir):
    return vectors.cluster_metrics(_clusters(spark, sf_dir))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT size, CAST(count(*) AS BIGINT) AS n_clusters FROM found WHERE is_rep AND size > 1 GROUP BY size")
def a13_size_histogram(spark, sf_dir):
    return vectors.size_histogram(_clusters(spark, sf_dir))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT CAST(label AS VARCHAR) AS doc_type, CAST(count(*) AS BIGINT) AS total, CAST(sum(CAST(is_rep AS INT)) AS BIGINT) AS unique_docs, round(100.0 * (count(*) - sum(CAST(is_rep AS INT))) / count(*), 6) AS dup_rate FROM found JOIN embeddings ON vec_id = id GROUP BY label ORDER BY total DESC, doc_type LIMIT 10")
def a14_type_statistics(spark, sf_dir):
    types = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("doc_type"))
    return vectors.type_statistics(_clusters(spark, sf_dir), types)


@query(f"WITH RECURSIVE {_CLUSTERS}, t AS (SELECT cluster_id FROM found WHERE is_rep AND size > 1 ORDER BY size DESC, cluster_id LIMIT 5) SELECT cluster_id, id, pos FROM found JOIN t USING (cluster_id) WHERE pos <= 4")
def w8_largest_clusters(spark, sf_dir):
    return vectors.largest_clusters(_clusters(spark, sf_dir)).select("cluster_id", "id", "pos")


@query("SELECT doc_id, vec_id FROM (SELECT vec_id % 100 AS doc_id, vec_id, row_number() OVER (PARTITION BY vec_id % 100 ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1")
def w1_first_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.col("vec_id") % 100)
    return vectors.first_per_document(v, "doc_id", "vec_id").select("doc_id", "vec_id")


# Sampling and review

_ORDERED = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat('42|', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents"
_SAMPLE = f"SELECT doc_id, source FROM ({_ORDERED}) WHERE r <= least(greatest(least(2, n), ceil(n * CAST(0.07 AS DOUBLE))), n)"


def _sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.07, 2)


@query(_SAMPLE)
def m1_stratified_sample(spark, sf_dir):
    return _sample(spark, sf_dir)


@query(f"SELECT source, CAST(count(*) AS BIGINT) AS total, CAST(count(s.doc_id) AS BIGINT) AS sampled, round(CAST(count(s.doc_id) AS DOUBLE) / count(*) * 100, 1) AS rate FROM documents d LEFT JOIN (SELECT doc_id FROM ({_SAMPLE})) s USING (doc_id) GROUP BY source")
def m2_breakdown(spark, sf_dir):
    return sampling.breakdown(table(spark, sf_dir, "documents"), _sample(spark, sf_dir), "source")


@query("""WITH c AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents), f AS (SELECT * FROM c WHERE doc_id = rep),
  o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat('42|', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM f)
  SELECT doc_id, source FROM o WHERE r <= least(greatest(least(1, n), ceil(n * CAST(0.2 AS DOUBLE))), n)""")
def m3_diverse_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    groups = hashed.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    same = hashed.join(groups, "h").select(F.col("doc_id").alias("id"), "size", (F.col("rep") == F.col("doc_id")).alias("is_rep"))
    return sampling.diverse(docs.select("doc_id", "source"), same, "source", "doc_id", 0.2)


def _reviewed(spark, sf_dir):
    results = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("file"), (F.col("quality") == 0).alias("is_error"), F.array(F.lit("quality"), F.lit("other")).alias("error_types"), F.lit("m").alias("memo"), F.lit(True).alias("reviewed")
    )
    sampled = _sample(spark, sf_dir).select(F.col("doc_id").alias("file"), F.col("source").alias("doc_type"))
    return review.with_results(sampled, results)


_REVIEWED = f"SELECT s.doc_id AS file, source AS doc_type, coalesce(quality = 0, false) AS is_error, l.doc_id IS NOT NULL AS reviewed FROM ({_SAMPLE}) s LEFT JOIN labels l USING (doc_id)"


@query(f"""WITH r AS ({_REVIEWED}), b AS (SELECT source AS doc_type, count(*) AS total FROM documents GROUP BY source), p AS (
  SELECT b.doc_type, CAST(total AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS sampled, CAST(sum(CAST(is_error AS INT)) AS BIGINT) AS errors FROM b JOIN r USING (doc_type) GROUP BY b.doc_type, total),
  u AS (SELECT * FROM p UNION ALL SELECT 'ALL', CAST(sum(total) AS BIGINT), CAST(sum(sampled) AS BIGINT), CAST(sum(errors) AS BIGINT) FROM p) SELECT *, round(CAST(errors AS DOUBLE) / sampled * 100, 1) AS error_rate FROM u""")
def a15_review_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = sampling.breakdown(docs, _sample(spark, sf_dir), "source").withColumnRenamed("source", "doc_type")
    return review.summary(parts, _reviewed(spark, sf_dir))


@query(f"SELECT CAST(sum(CAST(reviewed AS INT)) AS BIGINT) AS done, CAST(count(*) AS BIGINT) AS total, count(*) > 0 AND bool_and(reviewed) AS finished FROM ({_REVIEWED})")
def a16_session_progress(spark, sf_dir):
    return review.progress(_reviewed(spark, sf_dir))


@query(f"SELECT doc_type, CAST(sum(CAST(reviewed AS INT)) AS BIGINT) AS done, CAST(count(*) AS BIGINT) AS total, bool_and(reviewed) AS finished FROM ({_REVIEWED}) GROUP BY doc_type")
def a17_type_progress(spark, sf_dir):
    return review.progress(_reviewed(spark, sf_dir), ["doc_type"])


@query(f"SELECT CAST(coalesce(min(file), 0) AS BIGINT) AS next FROM ({_REVIEWED}) WHERE NOT reviewed AND file > 100")
def w4_next_unreviewed(spark, sf_dir):
    return review.next_unreviewed(_reviewed(spark, sf_dir), "file", 100)


@query("SELECT user_id AS file, max_by(event_type, (ts, event_id)) AS memo, true AS reviewed FROM events GROUP BY user_id")
def r2_upsert(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("memo"))
    return review.upsert(log)


@query(f"SELECT CAST(row_number() OVER (ORDER BY file) AS INT) AS no, file, doc_type, is_error, CASE WHEN reviewed THEN 'quality, other' ELSE '' END AS error_types, reviewed FROM ({_REVIEWED})")
def r4_review_details(spark, sf_dir):
    return review.details(_reviewed(spark, sf_dir)).select(F.col("no").cast("int").alias("no"), "file", "doc_type", "is_error", "error_types", "reviewed")


@query("SELECT file, CAST(greatest(max(CAST(anno_id AS BIGINT)), coalesce(max(CASE WHEN category = 'figure' AND doc_id % 3 = 0 THEN 4 END), 0)) + 1 AS BIGINT) AS next_id FROM ann GROUP BY file", ann=ANN)
def r6_next_ids(spark, sf_dir):
    a = ann(spark, sf_dir)
    return review.next_id(a, surrogates.sub_regions(a))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) <= floor((SELECT count(*) FROM documents) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM documents")
def e4_train_split(spark, sf_dir):
    return sampling.train_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS id, concat('images/', lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 7, '0'), '.jpg') AS image FROM documents")
def w6_label_numbers(spark, sf_dir):
    from quire.operators.numbering import dense_ids

    numbered = dense_ids(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return numbered.select("doc_id", "id", F.format_string("images/%07d.jpg", "id").alias("image"))


_DRAW = "min_by(doc_id, md5(concat('42|', {0}, '|', doc_id)))"


@query(f"""SELECT lang, source, CAST(count(*) AS BIGINT) AS n, array_to_string(list_slice([{", ".join(_DRAW.format(i) for i in range(3))}], 1, least(3, count(*))), ',') AS examples
  FROM documents GROUP BY lang, source""")
def w9_random_examples(spark, sf_dir):
    drawn = F.array_join(F.transform(sampling.draws("doc_id", "doc_id", 3), lambda v: v.cast("string")), ",")
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(count(), drawn.alias("examples"))


@query("SELECT source, c_lang AS lang, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM (SELECT source, lang AS c_lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL)")
def w5_shares(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(count())
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def u2_unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
