from quire.operators import models


def load_embedding():
    return lambda data: [len(data), 1 // len(data)]


def load_regions():
    return lambda data: [("stamp", (0, 0, 2, 2), [1.0]), ("logo", (0, 0, 2, 2), [1.0]), ("table", (1, 1, 1, 4), [1.0])] if data else 1 // 0


def test_stages_and_report(spark):
    images = spark.createDataFrame([("a", b"xxx"), ("b", b"")], "doc_id string, content binary")
    vectors, report = models.run_stages(images, {1: load_embedding, 3: load_regions})
    assert [r["doc_id"] for r in vectors[1].collect()] == ["a"]
    assert [(r["doc_id"], r["label"]) for r in vectors[3].collect()] == [("a", "stamp")]
    rows = {r["doc_id"]: r for r in report.collect()}
    assert (rows["a"]["stage_1"], rows["a"]["stage_3"], rows["a"]["error_1"]) == (1, 1, None)
    assert rows["b"]["stage_1"] == 0 and "ZeroDivisionError" in rows["b"]["error_1"]


def test_recognition(spark):
    crops = spark.createDataFrame([("k", b"ab")], "key string, content binary")
    assert [r["ocr_text"] for r in models.recognise(crops, lambda: lambda d: list(d.decode())).collect()] == ["a b"]


def load_wide_regions():
    return lambda data: [("Stamp", (-5, -5, 20, 4), [3.0, 4.0]), ("table", (90, 1, 120, 4), [1.0]), ("signature", (2, 2, 1, 9), [1.0])]


def test_regions_are_kept_inside_the_picture(spark):
    images = spark.createDataFrame([("a", b"x", 10, 8)], "doc_id string, content binary, w int, h int")
    (found,) = models.regions(images, load_wide_regions, size=("w", "h")).collect()
    assert (found["label"], found["box"]) == ("stamp", [0.0, 0.0, 10.0, 4.0])
    assert abs(sum(x * x for x in found["embedding"]) - 1) < 1e-5
    assert models.regions(images, load_wide_regions).count() == 2
