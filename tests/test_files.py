"""Readers, sinks and the command line on folders of files."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluate, review
from quire.plans import cli
from quire.sources import pages, sinks, tables


def page(i, **more):
    block = {"anno_id": i, "category_type": "title", "text": f"text {i}", "poly": [0, 0, 9, 0, 9, 9, 0, 9], "order": None}
    return {"layout_dets": [block, {**block, "anno_id": i + 1, "text": " "}], "page_info": {"image_path": f"img/p{i}.png", "page_no": i}, **more}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "pages/below").mkdir(parents=True)
    for i, where in enumerate(("a.json", "b.json", "below/c.json")):
        (tmp_path / "pages" / where).write_text(json.dumps(page(i)), encoding="utf-8")
    (tmp_path / "pages/bad.json").write_text("{")
    (tmp_path / "pages/x.PNG").write_bytes(b"abc")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/d.json").write_text(json.dumps(page(9)))
    return tmp_path


def names(df):
    return sorted(r["file"] for r in df.collect())


def test_listings(spark, folder):
    where, other = f"file://{folder}/pages", f"file://{folder}/other"
    assert names(pages.read_pages(spark, where)) == ["a.json", "b.json", "bad.json", "c.json"]
    assert names(pages.read_pages(spark, where, recursive=False)) == ["a.json", "b.json", "bad.json"]
    assert names(pages.read_pages(spark, where, other)) == ["a.json", "b.json", "bad.json", "c.json", "d.json"]
    assert [(r["file"], r["stem"], r["length"]) for r in pages.read_images(spark, where).collect()] == [("x.PNG", "x", 3)]
    assert pages.read_pages(spark, where).filter("page IS NULL").count() == 1


def test_default_folder_and_cache(spark, folder):
    spark.conf.set("quire.data.dir", f"file://{folder}/other")
    try:
        assert names(pages.read_pages(spark)) == ["d.json"]
        held = pages.cached_pages(spark)
        assert held.count() == 1 and pages.cached_pages(spark) is held and held.is_cached
        (folder / "other/e.json").write_text(json.dumps(page(4)))
        assert names(pages.cached_pages(spark)) == ["d.json"]
        pages.forget_pages()
        assert names(pages.cached_pages(spark)) == ["d.json", "e.json"]
    finally:
        pages.forget_pages()
        spark.conf.unset("quire.data.dir")


def test_batches(spark, tmp_path):
    for name in ("1_delivery_x/json", "1_delivery_x/img", "2_final_y", "none"):
        (tmp_path / "base" / name).mkdir(parents=True)
    (tmp_path / "base/2_final_y/p.JPG").write_bytes(b"")
    bases = [f"file://{tmp_path}/absent", f"file://{tmp_path}/base"]
    assert tables.batches(spark, bases) == ["2_final_y", "1_delivery_x"]
    assert tables.batch_dirs(spark, bases, "1_delivery_x") == (f"{bases[1]}/1_delivery_x/json", f"{bases[1]}/1_delivery_x/img")
    assert tables.batch_dirs(spark, bases, "2_final_y") == (f"{bases[1]}/2_final_y/json", f"{bases[1]}/2_final_y")
    assert tables.batch_dirs(spark, bases, "3") == (f"{bases[1]}/3/json", f"{bases[1]}/3/img")


def test_reports_vectors_and_csv(spark, tmp_path):
    (tmp_path / "report.csv").write_text('filename,field,original,converted\na.json,text,"x, y",z\nb.json,text\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_conversion_report(spark, f"file://{tmp_path}/report.csv").collect()] == [("a.json", "text", "x, y", "z")]
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "doc_id string, embedding array<double>")
    where = f"file://{tmp_path}/vectors"
    sinks.append_vectors(vectors, where)
    sinks.append_vectors(vectors.union(spark.createDataFrame([("c", [3.0])], vectors.schema)), where, tables.read_vectors(spark, where))
    assert sorted(r["doc_id"] for r in tables.read_vectors(spark, where).collect()) == ["a", "b", "c"]
    sinks.write_csv(spark.createDataFrame([("한", 1)], "name string, n int").coalesce(1), f"file://{tmp_path}/csv", bom=True)
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_bytes() == "﻿name,n\n한,1\n".encode()


def test_pages_are_written_and_changes_found(spark, folder, tmp_path):
    before = pages.read_pages(spark, f"file://{folder}/pages").filter("page IS NOT NULL")
    sinks.write_files(sinks.page_json(before), f"file://{tmp_path}/copy")
    assert {p.name: json.loads(p.read_text()) for p in (tmp_path / "copy").iterdir()} == {"a.json": page(0), "b.json": page(1), "c.json": page(2)}
    (tmp_path / "copy/b.json").write_text(json.dumps(page(1, more=1)))
    after = pages.read_pages(spark, f"file://{tmp_path}/copy")
    assert names(sinks.changed_pages(after, before)) == ["b.json"]


def test_lines_entries_and_copies(spark, folder, tmp_path):
    pairs = spark.createDataFrame([("b", "two"), ("a", "one")], "key string, text string")
    assert sorted(tuple(r) for r in sinks.label_lines(pairs).select("image", "line").collect()) == [("images/0000001.jpg", "images/0000001.jpg\tone"), ("images/0000002.jpg", "images/0000002.jpg\ttwo")]
    entries = {r["k"]: r["v"] for r in sinks.key_value_entries(pairs).collect()}
    assert entries == {"image-000000001": "a", "label-000000001": "one", "image-000000002": "b", "label-000000002": "two", "num-samples": "2"}
    files = spark.createDataFrame([(f"file://{folder}/pages/a.json", "x/y")], "path string, issue string")
    manifest = sinks.copy_manifest(files, F.col("issue"), F.col("path"), f"file://{tmp_path}/issues")
    sinks.copy_files(manifest)
    sinks.copy_files(manifest)  # again changes nothing
    assert json.loads((tmp_path / "issues/x_y/a.json").read_text()) == page(0)
    sinks.write_charset(spark.createDataFrame([("a",), ("한",)], "ch string"), f"file://{tmp_path}/charset")
    (part,) = (tmp_path / "charset").glob("part-*")
    assert part.read_text(encoding="utf-8") == "a\n한\n"


def test_sessions_and_stored_results(spark):
    sampled = spark.createDataFrame([("a.json",), ("b.json",)], "file string")
    assert sorted(tuple(r) for r in review.new_session(sampled).collect()) == [("a.json", False, [], "", False), ("b.json", False, [], "", False)]
    ann = spark.createDataFrame([("a.json", "1"), ("a.json", "2")], "file string, anno_id string")
    cache = spark.createDataFrame([("a.json", "1", "read", 0.5)], "filename string, anno_id string, ocr_text string, similarity double")
    assert sorted((r["anno_id"], r["ocr_text"]) for r in evaluate.with_cache(ann, cache).collect()) == [("1", "read"), ("2", None)]


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    where = f"file://{folder}/pages"
    monkeypatch.setattr(cli, "session", lambda: spark)
    for what in ("categories", "key-distributions", "relations", "page-info", "merge-list", "null-order"):
        cli.main(["analyze", what, where])
    printed = capsys.readouterr().out
    assert "title" in printed and "category_type" in printed
    monkeypatch.setattr(cli, "PRINTED", 1)
    cli.main(["validate", where])
    assert "1 of " in capsys.readouterr().out
    cli.main(["validate", where, "--out", f"file://{tmp_path}/found"])
    rows = spark.read.csv(f"file://{tmp_path}/found", header=True)
    assert {"empty_text", "file_load_error"} <= {r["rule_id"] for r in rows.collect()}
    (tmp_path / "big.json").write_text(json.dumps([page(0), page(5)]))
    cli.main(["data", "split-json", f"file://{tmp_path}/big.json", "--out", f"file://{tmp_path}/split"])
    assert sorted(p.name for p in (tmp_path / "split").iterdir()) == ["p0.json", "p5.json"]
