import shutil

import numpy as np
import pytest

from quire.operators import metric, vector_index, vectors
from quire.plans import queries


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, row.tolist(), i % 3) for i, row in enumerate(m)], "vec_id long, embedding array<double>, label int").repartition(3)


def crowd(seed, n, size=6, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, size))
    return np.vstack([centres[i % 9] + spread * rng.normal(size=size) for i in range(n)])


def plain_pairs(m, threshold):
    unit = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    i, j = np.nonzero(np.triu(unit @ unit.T > threshold, 1))
    return set(zip(i.tolist(), j.tolist(), strict=True))


def plain_labels(n, pairs):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in sorted(pairs):
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.97, 0.6, -0.2])
def test_cells_lose_no_pair_and_tell_none_twice(spark, monkeypatch, threshold):
    for name, value in (("CELL", 20), ("RESIDENTS", 15), ("VISITS", 40), ("STEP", 7)):
        monkeypatch.setattr(metric, name, value)
    m = np.vstack([crowd(1, 260), np.zeros((2, 6)), crowd(1, 30)])  # thirty copies and two zeros
    df = frame(spark, m)
    found = [(r["a"], r["b"]) for r in vectors.similar_pairs(df, threshold).collect()]
    expected = plain_pairs(m, threshold)
    assert len(found) == len(set(found)) and set(found) == expected
    clusters = {r["id"]: r["cluster_id"] for r in vectors.clusters(df, threshold).collect()}
    assert [clusters[i] for i in range(len(m))] == plain_labels(len(m), expected)


def test_copies_and_crowds_give_rows_in_proportion(spark, monkeypatch):
    """Copies of one vector give no pair, and vectors that are all alike a chain for each task."""
    same = frame(spark, np.tile([[0.3, 0.4, 0.5]], (3000, 1)))
    pairs, members = vectors.similar_classes(same, 0.95)
    assert pairs.count() == 0 and members.count() == 3000 and {r["rep"] for r in members.select("rep").distinct().collect()} == {0}
    sizes = {r["size"] for r in vectors.clusters(same, 0.95).collect()}
    assert sizes == {3000}
    monkeypatch.setattr(metric, "RESIDENTS", 500)
    rng = np.random.default_rng(0)
    near = frame(spark, np.array([1.0, 1.0, 1.0]) + 0.01 * rng.normal(size=(2000, 3)))
    reps = metric.distinct(near, 0.95, "vec_id").select("id", "v")
    edges = metric.edges(reps, 0.95)
    assert edges.count() < 4 * 2000 and metric.pairs(reps, 0.95).count() == 2000 * 1999 // 2
    assert {r["size"] for r in vectors.clusters(near, 0.95).collect()} == {2000}


def test_empty_and_single(spark):
    none = frame(spark, np.ones((1, 3))).limit(0)
    assert vectors.similar_pairs(none, 0.9).count() == 0 == vectors.clusters(none, 0.9).count()
    assert [tuple(r) for r in vectors.clusters(frame(spark, np.ones((1, 3))), 0.9).select("id", "size").collect()] == [(0, 1)]


def test_index_finds_what_a_full_search_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL", 40)
    m = np.vstack([crowd(2, 900, 16, 0.4), np.tile(crowd(3, 1, 16), (100, 1)), np.zeros((1, 16))])
    df = frame(spark, m)
    asked = df.filter("vec_id % 10 = 0")
    made = vector_index.build(df, f"file://{tmp_path}/index", keep=("label",))
    index = vector_index.load(spark, made.path)
    assert np.allclose(index.centres, made.centres) and len(index.centres) == 25
    assert spark.read.parquet(f"{made.path}/codes").count() == len(m)
    exact = vectors.top_k_each(df, asked, 10)
    found = vector_index.search(index, asked, 10)
    scores = {(r["query"], r["vec_id"]): r["score"] for r in vectors.top_k_each(df, asked, len(m)).collect()}
    rows = found.collect()
    assert all(r["score"] == pytest.approx(scores[r["query"], r["vec_id"]]) for r in rows) and len(rows) == 10 * asked.count()
    assert vector_index.recall(found, exact) >= 0.95
    whole = vector_index.search(index, asked, 10, probes=1.0, candidates=20, held=37)
    assert vector_index.recall(whole, exact) >= 0.999
    some = vector_index.search(index, asked, 5, where="label = 1", probes=1.0, candidates=20)
    assert vector_index.recall(some, vectors.top_k_each(df, asked, 5, label=1)) >= 0.999
    assert vector_index.search(index, asked.limit(0)).count() == 0


def test_one_query_reads_few_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL", 40)
    df = frame(spark, crowd(4, 800, 8))
    index = vector_index.build(df, f"file://{tmp_path}/index")
    one = df.filter("vec_id = 7")
    found = {tuple(r) for r in vector_index.search(index, one, 5, probes=0.1).collect()}
    # cells that the query does not read are gone: it finds the same
    cells = sorted(tmp_path.glob("index/codes/cell=*"))
    near = np.argsort(-(vectors._exact_unit([one.first()["embedding"]]) @ index.centres.T)[0], kind="stable")[:2]
    for c in cells:
        if int(c.name.split("=")[1]) not in near:
            shutil.rmtree(c)
    assert len(cells) == 20 and {tuple(r) for r in vector_index.search(index, one, 5, probes=0.1).collect()} == found
    assert max(s for *_, s in found) == pytest.approx(1.0)


def test_query_recall(spark):
    """The registered search against all products, for every fiftieth vector."""
    for sf_dir in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        found = queries.QUERIES["d10_index_search"](spark, sf_dir)
        v = queries.table(spark, sf_dir, "embeddings")
        exact = vectors.top_k_each(v, v.filter("vec_id % 50 = 0"), 10)
        assert vector_index.recall(found, exact) >= 0.9
