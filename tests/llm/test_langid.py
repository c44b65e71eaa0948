import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from quire.llm import langid, queries


def forward(word, pieces, p):
    w = "▁" + word
    total = [1.0] + [0.0] * len(w)
    for e in range(1, len(w) + 1):
        for b in range(e):
            if w[b:e] in pieces:
                total[e] += total[b] * p[pieces[w[b:e]]]
            elif e == b + 1:
                total[e] += total[b] * langid.UNKNOWN
    return total[-1]


PIECES = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])}


def test_forward_sums_all_segmentations():
    p = np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.2, 0.1])
    words = ["a", "ab", "aba", "bab", "xq", "bbbbbbbb"]
    lattice = langid.Lattice(words, langid.beginnings(PIECES))
    totals = lattice.totals(lattice.forward(np.log(np.append(p, langid.UNKNOWN))[:, None]))[:, 0]
    assert np.allclose(np.exp(totals), [forward(w, PIECES, p) for w in words])


def exact_log(word, p):
    """The same sum as an exact fraction, for words of any length."""
    w = "▁" + word
    q, unknown = [Fraction(x) for x in p], Fraction(langid.UNKNOWN)
    total = [Fraction(1)]
    for e in range(1, len(w) + 1):
        some = Fraction(0)
        for b in range(max(0, e - 3), e):
            if w[b:e] in PIECES:
                some += total[b] * q[PIECES[w[b:e]]]
            elif e == b + 1:
                some += total[b] * unknown
        total.append(some)
    n, d = total[-1].numerator, total[-1].denominator
    bits = lambda x: x.bit_length() * math.log(2) + math.log(x / (1 << x.bit_length()))
    return bits(n) - bits(d)


def test_long_words_are_summed_whole():
    """A word of 5,000 letters has all its segmentations summed, those across any place too."""
    p = np.array([0.125, 0.25, 0.125, 0.0625, 0.125, 0.25, 0.0625])
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abq"), 5000, p=[0.5, 0.45, 0.05])), "ab" * 20, "a"]
    scorer = langid.Scorer(langid.Model(["a", "b"], PIECES, np.column_stack([p, p])))
    scorer.learn([words])
    found = [scorer.rows[scorer.place[w], 0] for w in words]
    assert np.allclose(found, [exact_log(w, p) for w in words], rtol=1e-9)


def test_passes_hold_all_words_and_few_places():
    words = ["a" * n for n in (1, 5, 2, 100_000, 3, 40_000, 40_000)] + ["b"] * 50_000
    some = list(langid.passes(words))
    assert sorted(i for s in some for i in s) == list(range(len(words)))
    assert all(len(s) == 1 or len(s) * (max(len(words[i]) for i in s) + 2) <= langid.PASS_PLACES for s in some)


def test_query_equals_a_plain_learner(spark, tmp_path):
    """op2_language_id on a small table against a learner and scorer in plain Python."""
    rng = np.random.default_rng(1)
    vocabulary = {k: ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(40)] for k, letters in (("xx", "abcde"), ("yy", "defgh"))}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 12)), lang) for i, lang in enumerate(["xx", "yy"] * 15)]
    rows += [(100, None, "xx"), (101, "12 34", "yy"), (102, rows[0][1], None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = langid.vocabulary()
    longest = max(map(len, pieces))

    def sums(w, p):
        total = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            for b in range(max(0, e - longest), e):
                q = p[pieces[w[b:e]]] if w[b:e] in pieces else langid.UNKNOWN if e == b + 1 else 0.0
                total[e] += total[b] * q
        return total

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    models = {}
    for lang in ("xx", "yy"):
        counts = Counter(w for i, t, k in rows if k == lang and t and not held(i) for w in t.split() if w.isalpha())
        p = np.full(len(pieces), 1 / len(pieces))
        for _ in range(langid.ROUNDS):
            expected = np.full(len(pieces), langid.SMOOTHING)
            for word, n in counts.items():
                w = "▁" + word
                left, right = sums(w, p), [1.0 if e == len(w) else 0.0 for e in range(len(w) + 1)]
                for b in range(len(w) - 1, -1, -1):
                    for e in range(b + 1, min(len(w), b + longest) + 1):
                        right[b] += (p[pieces[w[b:e]]] if w[b:e] in pieces else langid.UNKNOWN if e == b + 1 else 0.0) * right[e]
                for b in range(len(w)):
                    for e in range(b + 1, min(len(w), b + longest) + 1):
                        if w[b:e] in pieces:
                            k = pieces[w[b:e]]
                            expected[k] += n * left[b] * p[k] * right[e] / left[-1]
            p = expected / expected.sum()
        models[lang] = p
    for r in queries.op2_language_id(spark, str(tmp_path)).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        words = [w for w in (text or "").split() if w.isalpha()]
        assert r["held_out"] == held(r["doc_id"])
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = {k: sum(math.log(sums("▁" + w, p)[-1]) for w in words) for k, p in models.items()}
        best = max(logs, key=logs.get)
        assert r["lang_pred"] == best
        assert np.isclose(r["score"], 1 / sum(math.exp(v - logs[best]) for v in logs.values()))


def test_expected_counts_are_derivatives():
    """d log P / d log p is the expected number of uses."""
    p, words, counts = np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.2, 0.1]), ["aba", "ab", "bab"], np.array([2.0, 1.0, 3.0])
    expected = langid.Lattice(words, langid.beginnings(PIECES)).expected(p, counts)
    loss = lambda q: sum(n * math.log(forward(w, PIECES, q)) for w, n in zip(words, counts, strict=True))
    for i in range(len(p)):
        up, down = p.copy(), p.copy()
        up[i] *= 1 + 1e-6
        down[i] *= 1 - 1e-6
        assert np.isclose(expected[i], (loss(up) - loss(down)) / 2e-6, atol=1e-4)


def test_each_round_raises_the_likelihood():
    counts = {"aba": 5, "abab": 3, "b": 2}
    score = lambda p: sum(n * math.log(forward(w, PIECES, p)) for w, n in counts.items())
    scores = [score(langid.fit_pieces(counts, PIECES, r)) for r in (1, 2, 4, 8)]
    assert all(b >= a - 0.1 for a, b in zip(scores, scores[1:], strict=False)) and scores[-1] > scores[0]


def test_held_out_accuracy(spark):
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    row = out.join(lang, "doc_id").filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert row[0] > 0.97 and row[1] > 100


def test_defined_results(spark, nasty, nothing):
    model = langid.learn(nasty)
    rows = {r["doc_id"]: r for r in langid.identify(nasty, model).collect()}
    assert {rows[i]["lang_pred"] for i in (2, 3, 4, 10)} == {"und"} and rows[2]["lang_score"] == 0.0
    assert rows[5]["lang_pred"] == "en" and rows[8]["lang_pred"] == "de"
    assert langid.identify(nasty, model).count() == nasty.count()
    assert langid.identify(nothing, model).count() == 0
    empty = langid.learn(nothing)
    assert {r["lang_pred"] for r in langid.identify(nasty, empty).collect()} == {"und"}
    chosen = langid.accepted(nasty, model)
    assert chosen.columns == nasty.columns and {r["lang_pred"] for r in chosen.collect()} == {"clash"}


def test_long_words_do_not_underflow(spark):
    model = langid.Model(["a", "b"], PIECES, np.full((len(PIECES), 2), 1e-5))
    assert langid.Scorer(model).predict(["ab" * 50_000])[1] == [0.5]


def test_lattice_looks_up_all_places_at_once():
    class Unasked(langid.Beginnings):
        def get(self, *_):
            raise AssertionError("a look-up for a single place")

    pieces = {p: i for i, p in enumerate(["▁", "▁a", "ab", "abc", "b", "bca", "語"])}
    words = ["abcab", "b", "語abc", "x", "abcabca" * 9]
    lattice = langid.Lattice(words, Unasked(langid.beginnings(pieces)))
    expected = []
    for w, marked in enumerate("▁" + x for x in words):
        for b in range(len(marked)):
            expected += [(w, b, e, pieces[marked[b:e]]) for e in range(b + 1, len(marked) + 1) if marked[b:e] in pieces]
            expected += [] if marked[b] in pieces else [(w, b, b + 1, -1)]
    arcs = zip(lattice.word.tolist(), lattice.begin.tolist(), lattice.end.tolist(), lattice.piece.tolist(), strict=True)
    assert sorted(arcs) == sorted(expected)


def test_the_driver_gives_back_what_learning_took(spark, monkeypatch):
    given = []
    monkeypatch.setattr(langid, "give_back", lambda: given.append(True))
    rows = [(i, f"wort satz nummer {i}" if i % 2 else f"word phrase number {i}", "de" if i % 2 else "en") for i in range(20)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"] and given == [True]
