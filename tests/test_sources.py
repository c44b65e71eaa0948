import json

import pytest
from pyspark.sql import functions as F

from quire.operators import profile, relations, validate
from quire.plans import rules
from quire.sources import pages as source
from quire.sources import sinks, tables

SQUARE = [0, 0, 100, 0, 100, 100, 0, 100]


def page(blocks, relation=(), **info):
    return json.dumps({"page_info": {"width": 1000, "height": 1400, **info}, "layout_dets": blocks, "extra": {"relation": list(relation)}})


def block(anno_id=1, category="text_block", poly=SQUARE, **more):
    return {"anno_id": anno_id, "category_type": category, "poly": poly, "ignore": False, **more}


@pytest.fixture
def load(spark, tmp_path):
    def run(**files):
        folder = tmp_path / "pages"
        folder.mkdir(exist_ok=True)
        for name, body in files.items():
            (folder / f"{name}.json").write_text(body, encoding="utf-8")
        return source.read_pages(spark, str(folder))

    return run


def found(pages, rule):
    return sorted((r["file"], r["anno_id"], r["severity"], r["detail"]) for r in validate.validate(pages).filter(F.col("rule_id") == rule).collect())


def test_defaults_and_explicit_nulls(load):
    rows = source.annotations(load(a=page([{}, {"anno_id": None, "category_type": None, "text": 5, "poly": None}]))).orderBy("pos").collect()
    assert (rows[0]["anno_id"], rows[0]["category"], rows[0]["poly"], rows[0]["ignored"]) == ("-1", "unknown", [], False)
    assert (rows[1]["anno_id"], rows[1]["category"], rows[1]["text"], rows[1]["poly_len"]) == ("null", None, "5", None)


def test_attribute_forms(load):
    made = load(a=page([block(1, "table", **{"attribute.line": "x"}), block(2, "table", attribute={"line": "x"}), block(3, "table", attributes={"line": "x"}), block(4, "table", attribute="no")]))
    assert {r[1] for r in found(made, "missing_key") if r[3] == "attribute.line"} == {"4"}


def test_missing_keys_of_a_table(load):
    made = load(a=page([block(1, "table"), {"category_type": "text_block", "poly": SQUARE}]))
    assert len(found(made, "missing_key")) == 5
    assert found(made, "empty_html") == [("a.json", "1", "ERROR", None)]


def test_bad_polygons(load):
    made = load(a=page([block(1, poly=[1, 2, 3, 4]), block(2, poly=[1, 2, 3, 4, 5, 6, 7]), block(3, poly=[[0, 0], [1, 0], [1, 1], [0, 1]]), block(4, poly=None), block(5)]))
    assert [(r[1], "odd" in r[3]) for r in found(made, "invalid_poly")] == [("1", False), ("2", True), ("3", False), ("4", False)]


def test_blank_texts(load):
    made = load(a=page([block(1, text=""), block(2, text="  "), block(3, text="　"), block(4, text=None), block(5, text="", ignore=True), block(6, text="", attribute={"ignore": True})]))
    assert [(r[1], r[2]) for r in found(made, "empty_text")] == [("1", "ERROR"), ("2", "ERROR"), ("3", "ERROR"), ("5", "WARNING"), ("6", "WARNING")]


def test_blank_markup(load):
    made = load(a=page([block(1, "table", html=None), block(2, "chart", html=""), block(3, "chart"), block(4, "chart", html=None)]))
    assert [(r[1], r[2]) for r in found(made, "empty_html")] == [("1", "ERROR"), ("2", "WARNING"), ("4", "WARNING")]


def test_duplicate_ids_and_self_references(load):
    made = load(a=page([block(1), block(1), block(1), block(2)], [{"source_anno_id": 1, "target_anno_id": 1}, {"parent": 2, "son": 2}, {"parent": None, "son": None, "source_anno_id": 1, "target_anno_id": 1}]))
    assert [r[1] for r in found(made, "duplicate_anno_id")] == ["1"]
    assert [r[1] for r in found(made, "self_referencing_relation")] == ["1", "2"]


def test_include_flags(load):
    t = lambda i, **a: block(i, "table", attribute=a)
    rel = [{"parent": 2, "son": 9, "relation_type": "parent_son"}, {"parent": 3, "son": 9, "relation_type": "parent_son"}]
    made = load(a=page([t(1, include_photo=True), t(2), t(3, include_photo=True), block(4, "table", **{"attribute.include_photo": True}), block(9, "figure")], rel))
    assert [(r[1], r[3]) for r in found(made, "table_include_attr_relation_mismatch")] == [("1", "include_photo without relation"), ("2", "include_photo not set")]


def test_dangling_references(load):
    html = '$$figure_01$$ <img src="anno_id_5"> ANNO_ID 7'
    made = load(a=page([block(1, "table", html=html, poly=[0, 0, 1, 0, 1, 1, 0, 1]), block("5", poly=[5, 5, 6, 5, 6, 6, 5, 6])]))
    assert [r[3] for r in found(made, "table_html_invalid_anno_ref")] == ["5", "7"]


def test_overlap_of_tables_and_figures(load):
    inside, most, exactly = [10, 10, 20, 10, 20, 20, 10, 20], [-11, 0, 89, 0, 89, 50, -11, 50], [-10, 50, 90, 50, 90, 60, -10, 60]
    blocks = [block(1, "table", html="x"), block(2, "figure", inside), block(3, "chart", most), block(4, "chart", exactly), block(5, "table", html="x")]
    made = load(a=page(blocks))
    hits = {(r[1], r[3]) for r in found(made, "table_html_missing_spatial_ref")}
    assert {("1", "2"), ("1", "4"), ("1", "5"), ("5", "1")} <= hits and ("1", "3") not in hits
    fig = [block(1, "figure"), block(2, "text_block", inside), block(3, "chart", inside), block(4, "table", inside, html="x")]
    fig[0]["sub_regions"] = [{"anno_id": 3}]
    made = load(a=page([]), b=page(fig, [{"source_anno_id": 1, "target_anno_id": 4, "relation_type": "any"}]))
    assert [r[3] for r in found(made, "missing_figure_dependency")] == ["2"]


def test_formulas(load):
    texts = ["$$y$$", r"\$5", "${$", "$}}$", "$[$", "$ $", r"$\foo$"]
    made = load(a=page([block(i, text=t) for i, t in enumerate(texts)]))
    assert [r[1] for r in found(made, "latex_unmatched_braces")] == ["2", "3", "3"]
    assert [r[1] for r in found(made, "latex_unmatched_brackets")] == ["4"]
    assert [r[1] for r in found(made, "latex_empty_formula")] == ["5"]
    assert [(r[1], r[3]) for r in found(made, "latex_invalid_command")] == [("2", "{ is not closed at 0"), ("3", "} without { at 0"), ("6", "foo")]


def test_markup_that_is_missing(load):
    texts = ["H2_O", "x^2", r"\alpha", "3 x 4", "a/b", "$a/b$"]
    made = load(a=page([block(i, text=t) for i, t in enumerate(texts)]))
    assert [r[1] for r in found(made, "missing_inlinelatex")] == ["0", "1", "2", "3", "4"]


def test_a_broken_file_stops_no_other(load):
    made = load(a='{"layout_dets": [', b=page([block(1, poly=[])]), c='{"layout_dets": [], "layout_dets": [{"poly": []}]}')
    assert [r[0] for r in found(made, "file_load_error")] == ["a.json"]
    assert [r[0] for r in found(made, "invalid_poly")] == ["b.json", "c.json"]


def test_relations_take_the_last_block(load):
    made = load(a=page([block(1, "title"), block(1, "table"), block(2, "chart")], [{"parent": 1, "son": 2, "relation_type": "parent_son"}, {"parent": 1, "son": 8}]))
    rows = relations.patterns(relations.endpoints(source.relations(made), source.annotations(made))).collect()
    assert [(r["category1"], r["category2"], r["n"]) for r in rows] == [("table", "chart", 1)]


def test_nested_blocks(load):
    deep = block(1, merge_list=[block(2, merge_list=[block(3)], line_with_spans=[{"text": "x"}])])
    made = source.typed(source.nested_blocks(load(a=page([deep]))))
    counts = {r["location"]: r["count"] for r in made.groupBy("location").count().collect()}
    assert counts == {"block": 1, "merge_list": 2, "line_with_spans": 1}
    assert profile.category_report(made).count() == 3


def test_split_write_and_read_again(spark, load, tmp_path):
    many = json.dumps([{"page_info": {"image_path": "x/one.jpg"}, "layout_dets": []}, {"layout_dets": [block(4)]}])
    parts = sinks.split_pages(source.split_arrays(load(a=many, b=page([block(7)]))))
    sinks.write_files(parts, f"file://{tmp_path}/out")
    again = source.read_pages(spark, f"{tmp_path}/out")
    assert sorted(r["file"] for r in again.collect()) == ["annotation_00000.json", "annotation_00001.json", "one.json"]


def test_images_by_name_stem_and_two_parts(spark):
    pages = spark.createDataFrame([("PP1_2_x.json", "a/q.jpg"), ("PP3_4_x.json", None), ("PP5_6_x.json", "a/none.jpg")], "file string, image_path string")
    images = spark.createDataFrame([("q.jpg", "q"), ("PP3_4_x.png", "PP3_4_x"), ("PP5_6_y.jpg", "PP5_6_y")], "file string, stem string")
    rows = {r["file"]: r["image_file"] for r in source.resolve_images(pages, images).collect()}
    assert rows == {"PP1_2_x.json": "q.jpg", "PP3_4_x.json": "PP3_4_x.png", "PP5_6_x.json": "PP5_6_y.jpg"}


def test_label_file_and_ocr_cache(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a.jpg\tx\ty\nbroken\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_label_file(spark, str(tmp_path / "l.txt")).collect()] == [("a.jpg", "x\ty")]
    (tmp_path / "o.csv").write_text("filename,anno_id,category,gt_text,ocr_text,similarity,timestamp\nf,1,t,a,b,0.5,1\nf,1,t,a,c,0.7,2\n", encoding="utf-8")
    assert [r["ocr_text"] for r in tables.read_ocr_cache(spark, str(tmp_path / "o.csv")).collect()] == ["c"]


def test_sessions(spark, tmp_path):
    good = {"batch": "b", "sampled_files": ["x"], "review_results": {"x": {"is_error": True, "error_types": ["t"], "memo": "m", "reviewed": True}}}
    (tmp_path / "s.json").write_text(json.dumps(good), encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    sessions = tables.read_sessions(spark, str(tmp_path))
    assert [r["batch"] for r in sessions.collect()] == ["b"]
    assert [(r["file"], r["is_error"]) for r in tables.session_results(sessions).collect()] == [("x", True)]


def test_draw_list_and_manifest(spark, load):
    made = load(a=page([block(1, "title"), block(2, "odd", [200, 200, 300, 200, 300, 300, 200, 300])], [{"parent": 1, "son": 2, "relation_type": "parent_son"}]))
    rows = sinks.draw_list(source.annotations(made), source.relations(made), rules.category_colors(spark)).collect()
    assert sorted((r["shape"], r["color"]) for r in rows) == [("arrow", "#FF00FF"), ("polygon", "#343a40"), ("polygon", "#FF6347")]
    manifest = sinks.copy_manifest(made, F.lit("a/b"), F.col("path"), "/out").collect()
    assert manifest[0]["dst"] == "/out/a_b/a.json"
