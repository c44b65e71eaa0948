import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry, rewrite, text
from quire.operators import review, sampling, vectors


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abé한", max_size=12), st.text("abé한", max_size=12))
def test_ratio(a, b):
    expected = 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0
    assert text.ratio(a, b) == expected == text.ratio(b, a)


def test_similarity_of_blank_texts(spark):
    rows = spark.createDataFrame([("", "x"), (" ", " "), ("abc", "abd"), (None, "x")], "a string, b string")
    assert [round(r[0], 4) for r in rows.select(text.similarity("a", "b")).collect()] == [0.0, 1.0, 0.6667, 0.0]


def test_character_errors(spark):
    rows = spark.createDataFrame([("a b", "ab"), ("", ""), ("", "x"), ("가나", "가다")], "a string, b string")
    assert [r[0] for r in rows.select(text.character_error_rate("a", "b")).collect()] == [0.0, 0.0, 1.0, 0.5]


@pytest.mark.parametrize(
    ("parent", "child", "share"),
    [
        ([0, 0, 10, 0, 10, 10, 0, 10], [2, 2, 4, 2, 4, 4, 2, 4], 1.0),
        ([0, 0, 10, 0, 10, 10, 0, 10], [5, 5, 15, 5, 15, 15, 5, 15], 0.25),
        ([0, 0, 10, 0, 0, 10], [0, 0, 10, 0, 10, 10, 0, 10], 0.5),
        ([0, 0, 10, 0, 10, 10, 5, 5, 0, 10], [0, 0, 10, 0, 10, 10, 0, 10], 0.75),
        ([0, 0, 10, 0, 10, 10, 0, 10], [1, 1, 1, 1, 1, 1], 0.0),
        ([0, 0, 10, 0, 10, 10, 0, 10, 3], [1, 1, 2, 1, 2, 2], 0.0),
        ([0, 0, 10, 10, 10, 0, 0, 10], [0, 0, 10, 0, 10, 10, 0, 10], 0.5),
    ],
)
def test_polygon_overlap(parent, child, share):
    assert geometry.polygon_overlap(parent, child) == pytest.approx(share)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=6, max_size=12), st.lists(st.integers(0, 20), min_size=6, max_size=12))
def test_overlap_is_a_share(a, b):
    assert -1e-9 <= geometry.polygon_overlap(a, b) <= 1 + 1e-9


def test_both_ways_of_overlap_agree(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(50):
        (x, y, u, v), (w, h, s, t) = rng.integers(0, 50, 4).tolist(), rng.integers(1, 60, 4).tolist()
        rows.append(([float(n) for n in (x, y, x + w, y, x + w, y + h, x, y + h)], [float(n) for n in (u, v, u + s, v, u + s, v + t, u, v + t)]))
    df = spark.createDataFrame(rows, "p array<double>, c array<double>")
    for r in geometry.with_overlap(df, "p", "c").collect():
        assert r["ioa"] == pytest.approx(geometry.polygon_overlap(r["p"], r["c"]))


@pytest.mark.parametrize(
    ("plain", "marked"),
    [
        ("H₂O", "$H_2O$"),
        ("α+1", r"$\alpha+1$"),
        ("(67개)³)", "(67개)³)"),
        ("3/4", r"$\frac{3}{4}$"),
        ("http://a/b", "http://a/b"),
        ("km/h", "$km/h$"),
        ("25℃", r"25$^\circ C$"),
        ("10m", "10$m$"),
        ("값 x 는", "값 $x$ 는"),
        ("A형", "A형"),
        ("p. 8", "p. 8"),
        ("R&D", "R&D"),
        ("", ""),
        (None, None),
    ],
)
def test_rewriting(plain, marked):
    assert rewrite.rewritten(plain) == marked


def test_sample_sizes(spark):
    rows = [(f"{t}{i}", t) for t, n in {"a": 1, "b": 2, "c": 7, "d": 20, "e": 100}.items() for i in range(n)]
    files = spark.createDataFrame(rows, "f string, t string")
    size = lambda rate: {r["t"]: r["count"] for r in sampling.stratified(files, "t", "f", rate, 2).groupBy("t").count().collect()}
    assert size(0.15) == {"a": 1, "b": 2, "c": 2, "d": 3, "e": 15}
    assert size(0.07) == {"a": 1, "b": 2, "c": 2, "d": 2, "e": 8}
    with pytest.raises(ValueError):
        sampling.stratified(files, "t", "f", 0)


def test_clusters_of_a_chain(spark):
    angle = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(0, angle(0)), (1, angle(15)), (2, angle(30)), (3, angle(120))]
    found = vectors.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).orderBy("id").collect()
    assert [(r["cluster_id"], r["pos"], r["size"], r["is_rep"]) for r in found] == [(0, 1, 3, True), (0, 2, 3, False), (0, 3, 3, False), (3, 1, 1, True)]


def test_pruned_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6))
    v = np.vstack([centres[i % 8] + 0.15 * rng.normal(size=6) for i in range(300)])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T > 0.97, 1))
    ours = sorted((r["a"], r["b"]) for r in vectors.similar_pairs(df, 0.97).collect())
    assert ours == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_samples_are_representatives(spark):
    files = spark.createDataFrame([(i, "x") for i in range(20)], "id long, t string")
    same = files.select("id", F.lit(2).alias("size"), (F.col("id") % 2 == 0).alias("is_rep"))
    assert all(r["id"] % 2 == 0 for r in sampling.diverse(files, same, "t", "id", 0.5).collect())


def test_review_of_unknown_types_counts(spark):
    parts = spark.createDataFrame([("ETC", 5, 2), ("PP", 4, 0)], "doc_type string, total long, sampled long")
    seen = spark.createDataFrame([("ETC", True), ("ETC", False)], "doc_type string, is_error boolean")
    rows = {r["doc_type"]: (r["errors"], r["error_rate"]) for r in review.summary(parts, seen).collect()}
    assert rows == {"ETC": (1, 50.0), "PP": (0, 0.0), "ALL": (1, 50.0)}


def test_edits_and_relations(spark):
    ann = spark.createDataFrame([("f", "1", "a"), ("f", "2", "b")], "file string, anno_id string, text string")
    edits = spark.createDataFrame([("f", "2", "c")], "file string, anno_id string, text string")
    assert sorted(r["text"] for r in review.edited(ann, edits, ["text"]).collect()) == ["a", "c"]
    rel = spark.createDataFrame([("f", "1", "2", "p")], "file string, src string, tgt string, relation_type string")
    added = spark.createDataFrame([("f", "1", "2", "p"), ("f", "1", "3", "p")], rel.schema)
    assert review.with_relations(rel, added).count() == 2


def test_streams_append_and_upsert(spark, tmp_path):
    from quire.streaming import incremental

    schema = "doc_id string, embedding array<double>"
    for i, rows in enumerate(([("a", [1.0]), ("b", [2.0])], [("b", [2.0]), ("c", [3.0])])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        incremental.append_new_vectors(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2 + i
