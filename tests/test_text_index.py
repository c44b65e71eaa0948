import random

import numpy as np

from quire.operators import text_index

WORDS = "Alpha beta GAMMA delta ämter 日本語 😀 x 12 ab".split()


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(-50, 10**12) if i % 3 else i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))) for i in range(n)]


def plain(docs, phrases):
    return {(p, i) for p, phrase in phrases for i, t in docs if phrase and t is not None and i is not None and phrase.lower() in t.lower()}


def test_packed_lists_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lists = [np.unique(rng.integers(-(2**40), 2 ** int(rng.integers(1, 60)), int(rng.integers(1, 40)))) for _ in range(int(rng.integers(1, 20)))]
        counts = np.array([len(x) for x in lists])
        ids = np.concatenate(lists)
        data, ends = text_index.packed(ids.copy(), np.cumsum(counts) - counts)
        assert (text_index.unpacked(data, counts) == ids).all() and ends[-1] == len(data)
    close = np.arange(1000, 2000)
    assert len(text_index.packed(close, np.array([0]))[0]) < 1010


def test_search_equals_contains(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "HELD", 300)
    docs = rows(1, 400) + [(None, "alpha"), (7, None), (8, ""), (8, "second row of eight: Alpha beta")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    phrases = [(1, "alpha BETA"), (2, "ämter 日"), (3, "😀 x"), (4, "nowhere"), (5, ""), (6, None), (7, "x"), (8, "12"), (9, "a b"), (10, "gamma delta gamma"), (11, "a" * 500), (12, "delta"), (13, "beta alpha alpha beta")]
    asked = spark.createDataFrame(phrases, "phrase_id int, phrase string")
    index = text_index.build(df, f"file://{tmp_path}/index")
    expected = plain(docs, phrases)
    for looked_up in (1, 4, 100):
        assert {tuple(r) for r in text_index.search(index, asked, looked_up).collect()} == expected
    monkeypatch.setattr(text_index, "SENT", 3)
    assert {tuple(r) for r in text_index.search(index, asked).collect()} == expected and len({p for p, _ in expected}) > 6
    assert text_index.search(index, asked.limit(0)).count() == 0


def test_scan_skips_other_trigrams(spark, tmp_path):
    df = spark.createDataFrame(rows(2, 50), "doc_id long, text string")
    index = text_index.build(df, f"file://{tmp_path}/index")
    postings = spark.read.parquet(f"{index.path}/postings")
    wanted = spark.createDataFrame([(int(t),) for t in text_index.trigrams("alp")], "tri long")
    plan = text_index._of(postings, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(tri" in plan or "PushedFilters: [In(tri" in plan or "IsNotNull(tri)" in plan


def test_empty_table(spark, tmp_path):
    index = text_index.build(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/index")
    assert text_index.search(index, spark.createDataFrame([(1, "abc"), (2, "a")], "phrase_id int, phrase string")).count() == 0


def shuffled(plan):
    """Rows that the exchanges of an executed plan wrote."""
    name, more = plan.getClass().getSimpleName(), []
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    rows = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    children = plan.children()
    return rows + sum(shuffled(children.apply(i)) for i in range(children.size()))


def test_no_row_stands_for_a_phrase_and_a_text_but_results(spark, tmp_path):
    # all texts have all trigrams of all phrases, but each phrase is in one text
    letters = [f"{a}{b}" for a in "abcd" for b in "efgh"]
    texts = [" ".join(random.Random(i).sample(letters, 16)) + " " + " ".join(f"{a} {b}" for a in letters for b in letters) for i in range(400)]
    phrases = [(i, texts[i][:23]) for i in range(0, 400, 2)]
    index = text_index.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), f"file://{tmp_path}/index")
    found = text_index.search(index, spark.createDataFrame(phrases, "phrase_id int, phrase string"))
    assert {tuple(r) for r in found.collect()} == plain(list(enumerate(texts)), phrases)
    assert shuffled(found._jdf.queryExecution().executedPlan()) < 400 * 200 / 8


def test_grams_of_a_phrase_are_those_of_its_texts():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("abß語😀 ") for _ in range(rng.randrange(90)))
        a = rng.randrange(len(text) + 1)
        phrase = text[a : a + rng.randrange(60)]
        assert set(text_index.keys(phrase)) <= set(text_index.keys(text))
        assert (len(text_index.grams(phrase)) > 0) == (len(phrase) >= text_index.GRAM + text_index.WINDOW - 1)
