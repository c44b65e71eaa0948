"""Queries see whole texts and all blocks."""

import random

import numpy as np
import pytest

from quire.functions import text
from quire.operators import vectors
from quire.plans import queries


@pytest.fixture
def small(spark, tmp_path):
    """A folder whose documents table holds the given (doc_id, text) rows."""

    def made(rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return made


def test_similarity_of_whole_texts(spark, small):
    where = small([(1, "a" * 300), (2, "a" * 200 + "한" * 100), (3, "b")])
    found = {r["doc_id"]: r["similarity"] for r in queries.QUERIES["t1_similarity"](spark, where).collect()}
    assert found == {1: 0.666667, 2: 0.0}


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_edits_equal_the_plain_table():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc한") for _ in range(rng.randint(0, 70))) for _ in "ab")
        assert text.edits(a, b) == plain_edits(a, b)
        assert text.edits(a, a[:10] + "x" + a[12:]) == plain_edits(a, a[:10] + "x" + a[12:])


def test_errors_of_whole_texts(spark, small):
    """t4 and a21 see all characters; a reference may be empty."""
    rows = [(1, "ab " * 200), (2, "ab " * 199 + "한 x"), (3, None), (4, ""), (9, "y"), (10, "z z")]
    where = small(rows)
    found = {r["doc_id"]: r["cer"] for r in queries.QUERIES["t4_character_errors"](spark, where).collect()}
    plain = [t.replace(" ", "") if t else "" for _, t in rows]
    assert found == {1: round(plain_edits(plain[0], plain[1]) / 400, 6), 2: 1.0, 3: 0.0, 9: 1.0}
    (row,) = queries.QUERIES["a21_accuracy"](spark, where).collect()
    assert (row["n"], row["mean_cer"]) == (4, round((found[1] + 1 + 0 + 2) / 4, 6))


def test_similarity_as_given(spark, small):
    where = small([(1, " ab "), (2, "ab"), (3, ""), (4, "q")])
    found = {r["doc_id"]: r["similarity"] for r in queries.QUERIES["t2_similarity_as_given"](spark, where).collect()}
    assert found == {1: 0.75, 2: 0.0, 3: 0.0}


def test_best_vectors_of_many_queries(spark):
    """In blocks and parts, with ties, equal to all products."""
    rng = np.random.default_rng(0)
    m = rng.integers(-2, 3, (400, 4)).astype(float)
    stored = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int").repartition(5)
    asked = stored.filter("vec_id % 7 = 0")
    unit = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    for label, held in ((None, 20_000), (1, 9)):
        found = {}
        for r in vectors.top_k_each(stored, asked, 6, label, held=held).collect():
            found.setdefault(r["query"], []).append((-round(r["score"], 9), r["vec_id"]))
        for q in range(0, 400, 7):
            some = sorted((-round(float(unit[i] @ unit[q]), 9), i) for i in range(400) if label is None or i % 3 == label)
            assert [s for s, _ in sorted(found[q])] == pytest.approx([s for s, _ in some[:6]])
    assert vectors.search({}, 3, asked) is None and vectors.search({1: stored}, 2, asked).count() == 0
    assert vectors.top_k_each(stored, asked.limit(0)).count() == 0 == vectors.top_k_each(stored.limit(0), asked).count()


def test_annotations_of_whole_texts(spark, small):
    given = "word " * 400 + "$a + {b$ and $q$ then x^2"
    where = small([(1, given)])
    changed = {r["field"]: r["original"] for r in queries.QUERIES["t8_rewrite_changes"](spark, where).collect()}
    assert changed["text"].startswith(given)
    found = queries.QUERIES["v13_all_findings"](spark, where).filter("rule_id = 'latex_unmatched_braces'")
    assert found.count() == 1


def test_all_blocks_count(spark, small):
    """Block 38 has seven polygon numbers."""
    where = small([(i, "text") for i in range(30, 40)])
    found = queries.QUERIES["v13_all_findings"](spark, where)
    of_38 = found.filter("anno_id = '8' AND rule_id IN ('table_include_attr_relation_mismatch', 'table_html_invalid_anno_ref')")
    assert of_38.count() > 0
    alone = f"{where}/alone"
    spark.createDataFrame([(38, "text")], "doc_id long, text string").write.parquet(f"{alone}/documents.parquet")
    (vector,) = queries.QUERIES["g8_layout_vectors"](spark, alone).collect()
    assert sum(vector["embedding"]) > 0
