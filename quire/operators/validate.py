"""Validation rules over annotations and relations of pages.

Every rule gives rows (file, category, anno_id, rule_id, severity, detail), so
reports are a union of rules.  Rules that compare blocks of a page join on the
file, with the sides filtered by category first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry, latex
from quire.functions.text import is_blank
from quire.plans import rules
from quire.staging import staged

COLUMNS = ("file", "category", "anno_id", "rule_id", "severity", "detail")
#: Categories of findings about a whole page, by rule.
PAGE_RULES = {
    "duplicate_anno_id": "document",
    "self_referencing_relation": "relation",
    "table_include_attr_relation_mismatch": "table",
    "table_html_invalid_anno_ref": "table",
    "table_html_missing_spatial_ref": "table",
    "missing_figure_dependency": "figure",
    "file_load_error": "file",
}


def _found(df: DataFrame, rule: str, severity: str | Column = "ERROR", detail: Column | None = None, category: Column | None = None, anno_id: Column | None = None) -> DataFrame:
    return df.select(
        "file",
        (F.col("category") if category is None else category).alias("category"),
        (F.col("anno_id") if anno_id is None else anno_id).cast("string").alias("anno_id"),
        F.lit(rule).alias("rule_id"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def _eased() -> Column:
    return F.when(F.col("ignored"), "WARNING").otherwise("ERROR")


def missing_keys(ann: DataFrame, required: DataFrame) -> DataFrame:
    """Required keys of the category that a block has in no form.

    A dotted key is there as a flat key or, after its first dot, as a nested
    attribute; a plain key also where its text field is set.
    """
    need = ann.join(F.broadcast(required), "category")
    dotted = F.contains("required_key", F.lit("."))
    nested = F.array_contains("attr_keys", F.regexp_replace("required_key", r"^[^.]*\.", ""))
    there = F.array_contains("raw_keys", F.col("required_key")) | (dotted & nested)
    return _found(need.filter(~there), "missing_key", detail=F.col("required_key"))


def invalid_polys(ann: DataFrame) -> DataFrame:
    few = F.coalesce(F.col("poly_len"), F.lit(0)) < 6
    bad = few | (F.col("poly_len") % 2 == 1)
    return _found(ann.filter(bad), "invalid_poly", detail=F.when(few, "fewer than three points").otherwise("odd number of values"))


def empty_texts(ann: DataFrame) -> DataFrame:
    """Blank, not null, texts of categories that need one; warnings where the block is ignored."""
    return _found(ann.filter(F.col("category").isin(*rules.TEXT_REQUIRED) & is_blank("text")), "empty_text", _eased())


def empty_html(ann: DataFrame) -> DataFrame:
    none = F.col("html").isNull() | is_blank("html")
    table = F.col("category") == "table"
    rest = ~table & F.array_contains("raw_keys", F.lit("html"))
    return _found(ann.filter(none & (table | rest)), "empty_html", F.when(table, _eased()).otherwise("WARNING"))


def formula_findings(ann: DataFrame) -> DataFrame:
    gated = ann.filter(latex.needs_check(F.col("category"), F.col("latex"), F.col("text")))
    field = F.when(F.length("latex") > 0, F.array("latex")).otherwise(F.array().cast("array<string>"))
    each = gated.select("file", "category", "anno_id", F.explode(F.concat(field, latex.formulas("text"))).alias("formula"))
    return latex.violations(each).select(*COLUMNS)


def missing_inline_markup(ann: DataFrame) -> DataFrame:
    hit = ann.filter(F.col("category").isin(*rules.INLINE_CHECKED) & (F.length("text") > 0)).withColumn("__m", latex.missing_markup("text"))
    return _found(hit.filter("__m IS NOT NULL"), "missing_inlinelatex", "WARNING", F.col("__m.matched"))


def annotation_rules(ann: DataFrame, required: DataFrame) -> DataFrame:
    found = [missing_keys(ann, required), invalid_polys(ann), empty_texts(ann), empty_html(ann), formula_findings(ann), missing_inline_markup(ann)]
    return reduce(DataFrame.unionByName, found)


def duplicate_ids(ann: DataFrame, keys: tuple[str, ...] = ("file", "anno_id")) -> DataFrame:
    """One finding for each id that a file has twice or more; blocks without the key do not count."""
    have = ann.filter(F.array_contains("raw_keys", F.lit("anno_id"))) if "raw_keys" in ann.columns else ann
    twice = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _found(twice, "duplicate_anno_id", detail=F.col("n"), category=F.lit("document"))


def self_references(rel: DataFrame) -> DataFrame:
    return _found(rel.filter("src = tgt"), "self_referencing_relation", category=F.lit("relation"), anno_id=F.col("src"))


def last_blocks(ann: DataFrame) -> DataFrame:
    """file, anno_id and the category of the last block with that id."""
    return ann.groupBy("file", "anno_id").agg(F.max_by("category", "pos").alias("category"))


def include_mismatches(ann: DataFrame, rel: DataFrame) -> DataFrame:
    """Tables whose include flags and parent-son relations to such children disagree."""
    spark = ann.sparkSession
    flags = F.broadcast(spark.createDataFrame([*rules.INCLUDE_FLAGS.items()], "flag string, child_category string"))
    tables = ann.filter("category = 'table'").select("file", "pos", "anno_id", "category", F.explode(F.array(*map(F.lit, rules.INCLUDE_FLAGS))).alias("flag"), "flags").join(flags, "flag")
    sons = rel.filter(F.contains("relation_type", F.lit("parent_son"))).select("file", F.col("first_src").alias("anno_id"), F.col("first_tgt").alias("child_id"))
    blocks = last_blocks(ann).select("file", F.col("anno_id").alias("child_id"), F.col("category").alias("child_category"))
    linked = sons.join(blocks, ["file", "child_id"]).select("file", "anno_id", "child_category").distinct().withColumn("linked", F.lit(True))
    both = tables.join(linked, ["file", "anno_id", "child_category"], "left")
    says, has = F.array_contains("flags", F.col("flag")), F.coalesce("linked", F.lit(False))
    detail = F.concat(F.col("flag"), F.when(says, " without relation").otherwise(" not set"))
    return _found(both.filter(says != has), "table_include_attr_relation_mismatch", detail=detail)


# References to annotations in table markup.
REFERENCE_MARKS = (r"\$\$[^$]*_(\d+)\$\$", r"(?i)anno_id(?:_|[^\d]*?)\s*(\d+)")


def html_references(html: Column | str, marks: tuple[str, ...] = REFERENCE_MARKS) -> Column:
    """Distinct numbers that markup refers to, without leading zeros."""
    h = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    found = F.flatten(F.array(*(F.regexp_extract_all(h, F.lit(m), 1) for m in marks)))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")))


def dangling_references(ann: DataFrame) -> DataFrame:
    refs = ann.filter("category = 'table' AND html <> ''").select("file", "category", "anno_id", F.explode(html_references("html")).alias("ref_id"))
    ids = ann.select("file", F.col("anno_id").alias("ref_id"))
    return _found(refs.join(ids, ["file", "ref_id"], "left_anti"), "table_html_invalid_anno_ref", detail=F.col("ref_id"))


def _inside(parents: DataFrame, children: DataFrame, least: float) -> DataFrame:
    """Pairs on a page of which the parent covers the child by *least* or more; boxes that do not meet are left out first.

    A page with many blocks is cut into cells, a box goes to all cells that it
    touches, and a pair is made in the first cell that both touch, so that no
    page is one task's.
    """
    p = parents.filter("poly_len >= 6").select("file", "category", "anno_id", F.col("poly").alias("p_poly"), geometry.box("poly").alias("p_box"))
    c = children.filter("poly_len >= 6").select("file", F.col("anno_id").alias("child_id"), F.col("poly").alias("c_poly"), geometry.box("poly").alias("c_box"))
    boxes = p.select("file", F.col("p_box").alias("b")).union(c.select("file", "c_box"))
    side = F.least(F.lit(CELLS), F.ceil(F.sqrt(F.count(F.lit(1)) / CELL_BOXES))).cast("int")
    pages = boxes.groupBy("file").agg(side.alias("side"), F.min("b.x1").alias("x0"), F.min("b.y1").alias("y0"), F.max("b.x2").alias("xn"), F.max("b.y2").alias("yn"))
    keys = ["file", "cx", "cy"]
    pairs = _in_cells(p.join(pages, "file"), "p_box").join(_in_cells(c.join(pages, "file"), "c_box").drop("category"), keys)
    meets = (F.col("p_box.x1") < F.col("c_box.x2")) & (F.col("c_box.x1") < F.col("p_box.x2")) & (F.col("p_box.y1") < F.col("c_box.y2")) & (F.col("c_box.y1") < F.col("p_box.y2"))
    first = (F.col("cx") == F.greatest("p_box_cx", "c_box_cx")) & (F.col("cy") == F.greatest("p_box_cy", "c_box_cy"))
    pairs = pairs.filter((F.col("anno_id") != F.col("child_id")) & meets & first)
    pairs = pairs.select("file", "category", "anno_id", "p_poly", "child_id", "c_poly")
    return geometry.with_overlap(pairs, "p_poly", "c_poly").filter(F.col("ioa") >= least)


#: Cells of a page along one side at most, and boxes of a cell, about.
CELLS, CELL_BOXES = 16, 32


def _in_cells(rows: DataFrame, box: str) -> DataFrame:
    """*rows* (.., *box*, side, x0, y0, xn, yn) once for each cell (cx, cy) that the box touches, with its first cell."""

    def cell(of: str, lo: str, hi: str) -> Column:
        share = F.try_divide((F.col(f"{box}.{of}") - F.col(lo)) * F.col("side"), F.col(hi) - F.col(lo))
        return F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0))).cast("int"), F.lit(0)), F.col("side") - 1)

    along = F.explode(F.sequence(cell("x1", "x0", "xn"), cell("x2", "x0", "xn"))).alias("cx")
    down = F.explode(F.sequence(F.col(f"{box}_cy"), F.col("__last"))).alias("cy")
    kept = [c for c in rows.columns if c not in ("side", "x0", "y0", "xn", "yn")]
    first = rows.select(*kept, cell("x1", "x0", "xn").alias(f"{box}_cx"), cell("y1", "y0", "yn").alias(f"{box}_cy"), cell("y2", "y0", "yn").alias("__last"), along)
    return first.select(*kept, f"{box}_cx", f"{box}_cy", "cx", down)


def missing_table_references(ann: DataFrame, least: float = rules.SPATIAL_OVERLAP) -> DataFrame:
    """Figures, charts and tables that lie in a table whose markup does not refer to them by annotation id."""
    pairs = _inside(ann.filter("category = 'table'"), ann.filter("category IN ('figure', 'chart', 'table')"), least)
    refs = ann.filter("category = 'table'").select("file", "anno_id", F.explode(html_references("html", REFERENCE_MARKS[1:])).alias("child_id"))
    return _found(pairs.join(refs, ["file", "anno_id", "child_id"], "left_anti"), "table_html_missing_spatial_ref", detail=F.col("child_id"))


def missing_figure_dependencies(ann: DataFrame, rel: DataFrame, sub: DataFrame, least: float = rules.SPATIAL_OVERLAP) -> DataFrame:
    """Texts, tables and charts that lie in a figure and are neither its sub-regions nor its sons by any relation."""
    pairs = _inside(ann.filter("category = 'figure'"), ann.filter("category IN ('text_block', 'table', 'chart')"), least)
    linked = sub.select("file", "anno_id", F.col("sub_id").alias("child_id")).union(rel.select("file", "src", "tgt"))
    return _found(pairs.join(linked, ["file", "anno_id", "child_id"], "left_anti"), "missing_figure_dependency", detail=F.col("child_id"))


def page_rules(ann: DataFrame, rel: DataFrame, sub: DataFrame) -> DataFrame:
    found = [duplicate_ids(ann), self_references(rel), include_mismatches(ann, rel), dangling_references(ann), missing_table_references(ann), missing_figure_dependencies(ann, rel, sub)]
    return reduce(DataFrame.unionByName, found)


def findings(ann: DataFrame, rel: DataFrame, sub: DataFrame) -> DataFrame:
    """All findings about blocks and about pages of them."""
    return annotation_rules(ann, rules.required_keys(ann.sparkSession)).unionByName(page_rules(ann, rel, sub))


def load_errors(pages: DataFrame) -> DataFrame:
    return _found(pages.filter("page IS NULL"), "file_load_error", category=F.lit("file"), anno_id=F.lit("N/A"))


def validate(pages: DataFrame) -> DataFrame:
    """All findings of all pages; a file that cannot be read has one finding and does not stop others."""
    from quire.sources import pages as source

    ann, rel = source.annotations(pages), source.relations(pages)
    return findings(ann, rel, source.sub_regions(ann)).unionByName(load_errors(pages))


def facets(found: DataFrame, severities: list[str], categories: list[str] = (), rule_ids: list[str] = (), files: list[str] = ()) -> DataFrame:
    """Findings of the given severities and, where given, categories, rules and files."""
    out = found.filter(F.col("severity").isin(*severities))
    for name, wanted in (("category", categories), ("rule_id", rule_ids), ("file", files)):
        out = out.filter(F.col(name).isin(*wanted)) if wanted else out
    return out


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias(column)).dropna().distinct().orderBy(column)


def flagged_annotations(ann: DataFrame, found: DataFrame, category: str | None = None) -> DataFrame:
    """Blocks with a finding of their own or named in one about their page, of one category if given."""
    bad = found.filter("severity IN ('ERROR', 'WARNING')")
    named = bad.select("file", "anno_id").union(bad.filter("rule_id IN ('table_html_missing_spatial_ref', 'missing_figure_dependency')").select("file", "detail"))
    hit = ann.join(named, ["file", "anno_id"], "left_semi")
    return hit.filter(F.col("category") == category) if category else hit


def findings_of(found: DataFrame, file: str, anno_id: str) -> DataFrame:
    """Findings on one page about one block."""
    return found.filter((F.col("file") == file) & ((F.col("anno_id") == anno_id) | (F.col("detail") == anno_id)))


def summary(found: DataFrame, top: int = 10) -> DataFrame:
    """kind, value, n: totals by severity; errors by category and by rule; the files with most findings.

    Findings are counted in one pass, and the counts staged.
    """
    error = F.col("severity") == "ERROR"
    kind = lambda name, value: F.struct(F.lit(name).alias("kind"), F.col(value).alias("value"))
    kinds = F.array_compact(F.array(kind("severity", "severity"), F.when(error, kind("category", "category")), F.when(error, kind("rule", "rule_id")), kind("files", "file")))
    counted = staged(found.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n")), "summary")
    return counted.filter("kind <> 'files'").unionByName(counted.filter("kind = 'files'").orderBy(F.desc("n"), "value").limit(top))


def figure_check(ann: DataFrame, rel: DataFrame, sub: DataFrame) -> DataFrame:
    """Per file how many blocks of figures are not linked."""
    return missing_figure_dependencies(ann, rel, sub).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("detail")).alias("children"))
