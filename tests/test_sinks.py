import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.operators import review, sampling
from quire.plans import rules
from quire.sources import sinks, tables, workbook


def test_long_markdown_fails(spark):
    rows = spark.range(5)
    assert sinks.markdown("all", rows, limit=5).count("\n") == 9
    with pytest.raises(ValueError, match="more than 4 rows"):
        sinks.markdown("cut", rows, limit=4)


def test_long_workbook_fails(spark, tmp_path):
    rows = spark.range(5)
    with pytest.raises(ValueError, match="more than 4 rows"):
        sinks.write_xlsx({"cut": rows}, f"{tmp_path}/cut.xlsx", limit=4)


def parts_of(path):
    import xml.etree.ElementTree as tree
    import zipfile

    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as book:
        for name in book.namelist():
            tree.fromstring(book.read(name))  # all parts are well-formed
        names = [s.get("name") for s in tree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{space['m']}}}sheet")]
        sheets = []
        for n in range(1, len(names) + 1):
            rows = tree.fromstring(book.read(f"xl/worksheets/sheet{n}.xml")).findall(".//m:row", space)
            sheets.append([[(c.findtext("m:is/m:t", None, space) or c.findtext("m:v", None, space), int(c.get("s"))) for c in r] for r in rows])
    return dict(zip(names, sheets, strict=True))


def test_workbook(spark, tmp_path):
    rows = spark.createDataFrame([("a<b>&\x01", 1, [1, 2], None), ("한", 2, [], 2.5)], "t string, n int, l array<int>, d double")
    sinks.write_xlsx({"one": rows, "two": rows.limit(0)}, f"{tmp_path}/book.xlsx")
    found = parts_of(f"{tmp_path}/book.xlsx")
    assert [[v for v, _ in r] for r in found["one"]] == [["t", "n", "l", "d"], ["a<b>& ", "1", "[1, 2]", None], ["한", "2", "[]", "2.5"]]
    assert len(found["two"]) == 1 and workbook.column_name(27) == "AB"


def test_review_and_validation_sheets(spark, tmp_path):
    summary = spark.createDataFrame([("ALL", None, 9, 3, 1, 33.3), ("PR", "x", 4, 1, 0, 0.0), ("PP", None, 5, 2, 1, 50.0)], "doc_type string, name string, total long, sampled long, errors long, error_rate double")
    details = spark.createDataFrame([(2, "b", "PP", "x", False, "", "", False), (1, "a", "PP", "x", True, "q", "m", True), (3, "c", "PR", None, False, "", "", True)], "no long, file string, doc_type string, name string, is_error boolean, error_types string, memo string, reviewed boolean")
    found = spark.createDataFrame([("a", "ERROR"), ("a", "WARNING"), ("b", "ERROR")], "file string, severity string")
    sheets = sinks.review_sheets({"납품 배치": "x", "난수 시드": 42}, summary, details) + sinks.validation_sheets(found, 7)
    sinks.write_bytes(spark, workbook.to_bytes([*sheets[:2], sheets[2]]), f"{tmp_path}/review.xlsx")
    book = parts_of(f"{tmp_path}/review.xlsx")
    assert [r[0][0] for r in book["요약"] if r] == ["납품 배치", "난수 시드", "문서 유형", "PP", "PR", "합계"]
    assert [[v for v, _ in r][4] for r in book["검수결과"]] == ["오류 여부", "오류", "정상", "정상"]
    styles = [r[0][1] for r in book["검수결과"]]
    assert styles[0] == 1 and styles[2] == 0 and len({*styles}) == 4
    assert [tuple(r) for r in sheets[3].rows[1:]] == [("총 이슈", 3), ("오류 (ERROR)", 2), ("경고 (WARNING)", 1), ("스캔한 파일", 7)]


def test_pictures(spark, tmp_path):
    ann = spark.createDataFrame([("a.json", "1", "title", [0.0, 0.0, 9.0, 0.0, 9.0, 9.0]), ("a.json", "2", "x<y", [20.0, 20.0, 30.0, 30.0]), ("b.json", "1", "title", [])], "file string, anno_id string, category string, poly array<double>")
    rel = spark.createDataFrame([("a.json", "1", "2", "parent_son")], "file string, src string, tgt string, relation_type string")
    info = spark.createDataFrame([("a.json", 100.0, 200.0, "a&b.png"), ("b.json", None, None, None)], "file string, width double, height double, image_path string")
    pictures = sinks.page_pictures(sinks.draw_list(ann, rel, rules.category_colors(spark)), info)
    import xml.etree.ElementTree as tree

    drawn = {r["name"]: tree.fromstring(r["content"]) for r in pictures.collect()}
    tags = [e.tag.rsplit("}")[-1] for e in drawn["a.svg"]]
    assert tags == ["image", "polygon", "text", "polygon", "text", "path"] and drawn["a.svg"].get("viewBox") == "0 0 100.0 200.0"
    assert drawn["a.svg"][0].get("href") == "a&b.png" and len(drawn["b.svg"]) == 0
    sinks.write_files(pictures, f"file://{tmp_path}/pictures")
    assert (tmp_path / "pictures/a.svg").exists()


def test_counts_of_a_manifest(spark):
    files = spark.createDataFrame([("x/a.json", "i/1"), ("x/b.json", "i/1"), ("y/c.json", "j")], "path string, issue string")
    manifest = sinks.copy_manifest(files, F.col("issue"), F.col("path"), "out")
    assert {r["folder"]: r["n"] for r in sinks.group_counts(manifest).collect()} == {"i_1": 2, "j": 1}


def test_sessions_and_reviews(spark, tmp_path):
    (tmp_path / "s.json").write_text("{}")
    folder = str(tmp_path)
    assert tables.session_exists(spark, folder, "s.json") and not tables.session_exists(spark, folder, "t.json")
    assert tables.delete_session(spark, folder, "s.json") and not tables.delete_session(spark, folder, "s.json")
    results = spark.createDataFrame([("a", True, ["q"], "m", True)], f"file string, {review.RESULT}")
    (one,), (none,) = (review.result_of(results, f).collect() for f in "ab")
    assert (one["is_error"], one["memo"], one["reviewed"]) == (True, "m", True)
    assert (none["file"], none["is_error"], none["error_types"], none["memo"], none["reviewed"]) == ("b", False, [], "", False)
    ann = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3")], "file string, anno_id string")
    log = spark.createDataFrame([("a", "1", True, ["기타"], "n", "r", 1), ("a", "1", True, [], "late", "r", 2), ("a", "2", False, ["기타"], "n", "r", 1)], "file string, anno_id string, verified boolean, issues array<string>, notes string, reviewer string, ts long")
    found = {r["anno_id"]: tuple(r)[2:] for r in review.formula_reviews(ann, log).collect()}
    assert found == {"1": (True, [], "late", "r", 2), "2": (False, [], "", "r", 1), "3": (False, [], "", "", None)}


def test_sample_without_clusters(spark):
    files = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, kind long")
    clusters = spark.createDataFrame([(i, 40, i == 0) for i in range(40)], "id long, size long, is_rep boolean")

    def broken():
        raise RuntimeError("no collection")

    few, why = sampling.diverse_or_plain(files, lambda: clusters, "kind", "id", 0.5)
    assert [r["id"] for r in few.collect()] == [0] and why is None
    plain, why = sampling.diverse_or_plain(files, broken, "kind", "id", 0.5)
    assert plain.count() == 20 and why == "RuntimeError: no collection"
    with pytest.raises(ValueError):
        sampling.diverse_or_plain(files, broken, "kind", "id", 0.0)


def test_canvas(spark):
    blocks = [("a", 0, "Title", [0.0, 0.0, 500.0, 0.0, 500.0, 700.0, 0.0, 700.0], False), ("a", 1, "table", [250.0, 350.0, 1000.0, 1400.0], False), ("a", 2, "text", [0.0, 0.0, 9.0, 9.0], True), ("b", 0, "x", [1.0, 2.0], False)]
    ann = spark.createDataFrame(blocks, "file string, pos int, category string, poly array<double>, ignored boolean")
    (row,) = geometry.layout_canvas(ann, F.lit(None).cast("double"), F.lit(0.0)).collect()
    pixels = np.frombuffer(row["pixels"], np.uint8).reshape(512, 512, 3)
    expected = np.full((512, 512, 3), 255, np.uint8)
    expected[:257, :257] = (100, 100, 100)
    expected[128:, 128:] = (173, 216, 230)
    assert (pixels == expected).all()


def test_canvases_come_in_small_batches():
    """A batch of any number of pages is drawn a few at a time."""
    box = {"x1": 1, "y1": 2, "x2": 30, "y2": 40}
    pages = pa.RecordBatch.from_pydict({"file": [str(i) for i in range(100)], "b": [[{"pos": 0, "category": "title", "box": box}]] * 100})
    drawn = list(geometry.canvases([pages]))
    assert max(b.num_rows for b in drawn) <= geometry.CANVASES
    assert [f for b in drawn for f in b.column(0).to_pylist()] == [str(i) for i in range(100)]
    assert all(p == geometry.drawn_canvas([{"category": "title", "box": box}]).tobytes() for b in drawn for p in b.column(1).to_pylist())
