import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import minhash
from quire.llm.decontaminate import words


def brute(texts, common=minhash.COMMON):
    """Classes by comparing all pairs with plain multisets of shingles."""
    bags = {}
    for i, t in texts.items():
        w = words(t)
        n = min(minhash.SHINGLE, len(w))
        bags[i] = Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else Counter()
    df = Counter(s for b in bags.values() for s in b)
    n = len(texts)
    least = max(2, int(np.ceil(common * n)))
    idf = {s: minhash.idf_of(k, n, common) if k >= least else 1.0 for s, k in df.items()}
    weights = {i: {s: c * idf[s] for s, c in b.items()} for i, b in bags.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = weights[a], weights[b]
            low = sum(min(v, y[s]) for s, v in x.items() if s in y)
            high = sum(x.values()) + sum(y.values()) - low
            if high and low / high >= minhash.SIMILARITY - 1e-9:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, bands string").repartition(4)


def ours(df):
    return {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}


def test_documents(spark, documents, texts):
    assert ours(documents.select("doc_id", "text")) == brute(texts)


def test_a_large_group_of_near_copies_and_chains(spark):
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for i in range(60):  # near copies of one text
        t = base[:]
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(120)] = rng.choice(vocabulary)
        texts[i] = " ".join(t)
    chain = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(100, 106):  # each like the one before, not like the first
        texts[i] = " ".join(chain)
        at = (i - 100) * 20
        chain[at : at + 4] = [rng.choice(vocabulary) for _ in range(4)]
    for i in range(200, 230):
        texts[i] = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))
    assert ours(frame(spark, texts)) == brute(texts)


def test_many_texts_around_one_passage(spark):
    """Large buckets of texts that are not alike, and some that are."""
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(5000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = {}
    for i in range(80):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(10, 40))]
        texts[2 * i] = " ".join(passage + own)
        if i % 4 == 0:
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts[2 * i + 1] = " ".join(passage + own)
    assert ours(frame(spark, texts)) == brute(texts)


def test_thousands_of_unlike_texts_around_one_passage(spark):
    """Pairs of which many share no bucket but those of the passage, with weight 1 for its shingles."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(130)]
    own = lambda i, n: [f"o{i}x{j}" for j in range(n)]
    texts = {i: " ".join(passage + own(i, rng.randint(20, 22))) for i in range(3000)}
    for i in range(1000):  # as long as the text before, with nine or ten words of it
        texts[5000 + i] = " ".join((passage + own(i, 20))[: 139 + i % 2] + own(5000 + i, 11))
    texts[9000] = "without the passage, so that no shingle is in all texts"
    expected = {i: i for i in texts}
    for i in range(1000):
        expected[5000 + i] = brute({i: texts[i], 5000 + i: texts[5000 + i]}, 2.0)[5000 + i]
    assert sum(expected[5000 + i] == i for i in range(1000)) > 300
    assert brute({i: texts[i] for i in range(100, 140)}, 2.0) == {i: i for i in range(100, 140)}
    found = {r["doc_id"]: r["class_id"] for r in minhash.classes(frame(spark, texts), common=1.0).collect()}
    assert found == expected


def test_sampling_agrees_with_the_similarity():
    rng = np.random.default_rng(0)
    shingles = rng.integers(0, 2**63, 300).astype(np.uint64)
    shingles.sort()
    a, b = shingles[:220], shingles[60:]
    wa, wb = rng.choice([0.5, 1.0, 2.0], len(a)), rng.choice([0.5, 1.0, 2.0], len(b))
    agree = np.mean(minhash.signature(a, wa, 2000) == minhash.signature(b, wb, 2000))
    assert agree == pytest.approx(minhash.similarity(a, wa, b, wb), abs=0.04)
    plain = np.mean(minhash.signature(a, np.ones(len(a)), 2000) == minhash.signature(b, np.ones(len(b)), 2000))
    assert plain == pytest.approx(160 / 300, abs=0.04)


def test_common_shingles_both_ways(spark, documents):
    a, b = (minhash.common_shingles(documents, candidates=n) for n in (2_000_000, 0))
    assert a[0].tolist() == b[0].tolist() and np.allclose(a[1], b[1]) and len(a[0])


def test_components(spark):
    edges = [(2, 1), (3, 2), (9, 8), (7, 8), (5, 3), (20, 1), (30, 20), (41, 40)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["label"] for r in minhash.components(df).collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 20: 1, 30: 1, 7: 7, 8: 7, 9: 7, 40: 40, 41: 40}


def test_rows_that_share_an_id(spark):
    """Of rows with one doc_id the one with the least md5 of its text counts, however they are dealt."""
    import hashlib

    shared = ["one text of some words that is here to stay", "another text of quite different words for the same id"]
    first = min(shared, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    rows = [(1, first, "a"), (2, shared[0], "b"), (2, shared[1], "c"), (2, shared[1], "a"), (3, shared[0], "d"), (4, None, "e"), (4, None, "d")]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, p string").repartition(parts, "p")
        assert ours(df) == {1: 1, 2: 1, 3: 3 if first != shared[0] else 1, 4: 4}
        left = {r["doc_id"]: (r["text"], r["p"]) for r in minhash.kept(df).collect()}
        assert left[1] == (first, "a") and left[4] == (None, "d") and 2 not in left
    alone = spark.createDataFrame(rows[2:], "doc_id long, text string, p string")
    assert {r["p"] for r in minhash.kept(alone).filter("doc_id = 2").collect()} <= {"a"}


def test_hot_keys_are_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 3), (3, 1), (4, 2)) for i in range(n)], "k long, i long")
    table = spark.createDataFrame([(1, 40, "x"), (2, 3, "y"), (3, 1, "z")], "k long, n long, v string")
    found = sorted(tuple(r) for r in minhash._joined(rows, table, ["k"], 46).select("k", "i", "v").collect())
    assert found == sorted([(1, i, "x") for i in range(40)] + [(2, i, "y") for i in range(3)] + [(3, 0, "z")])


def test_nothing_but_the_result_stays_staged(spark, documents):
    import glob

    from quire.llm.common import shared_dir

    where = shared_dir(spark).removeprefix("file://") + "/quire/*"
    before = set(glob.glob(where))
    minhash.classes(documents.select("doc_id", "text")).collect()
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(where)) - before}
    assert left <= {"common-candidates", "signatures", "texts", "labels"}


def test_defined_results(nasty, nothing):
    rows = {r["doc_id"]: r["class_id"] for r in minhash.classes(nasty).collect()}
    assert rows[7] == 6 and rows[6] == 6 and rows[None] is None
    assert all(rows[i] == i for i in (1, 2, 3, 4, 5, 8, 9, 11))
    kept = [r["doc_id"] for r in minhash.kept(nasty).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, 9, 10, None, 11]))
    assert set(minhash.kept(nasty).columns) == set(nasty.columns)
    assert minhash.classes(nothing).count() == 0 and minhash.kept(nothing).count() == 0
