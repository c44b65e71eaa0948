import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import queries, toxicity


def test_folding():
    assert toxicity.fold("ST­UPID Іd1оt tr@sh l0ser 2024 5th can't") == ["stupid", "idiot", "trash", "loser", "2024", "sth", "can", "t"]
    assert toxicity.fold(None) == toxicity.fold("") == []


def brute(model, text):
    words = toxicity.fold(text)
    s = f" {' '.join(words)} "
    spans = lambda k: [(i, i + len(k) - 1) for i in range(len(s)) if s.startswith(k, i)]
    excused = [x for p in model.exceptions for x in spans(f" {' '.join(toxicity.fold(p))} ")]
    return sum(w for k, w in model.lexicon.items() for a, b in spans(k) if not any(x <= a and b <= y for x, y in excused)) if words else 0.0


def test_weights_and_exceptions():
    model = toxicity.Model({" trash": 2.0, " idiot ": 3.0, " sc": 1.0})
    for t in ("Put the trash in the trash can", "idiots, an idiot! 1d10t", "take out the trash, idiot", "scum trashy", "", None, "trash can idiot trash can"):
        assert model.weight(toxicity.fold(t)) == brute(model, t)


def test_many_hits_and_exceptions_at_once():
    model = toxicity.Model({" trash": 2.0, " idiot ": 3.0, " can ": 1.0, " the ": 0.5}, ("trash can", "take out the trash", "the idiot can the"))
    rng = random.Random(0)
    for _ in range(200):
        text = " ".join(rng.choice(["trash", "can", "take", "out", "the", "idiot", "trashy"]) for _ in range(rng.randint(0, 25)))
        assert math.isclose(model.weight(toxicity.fold(text)), brute(model, text), abs_tol=1e-9)
    assert model.weight(["trash", "can"] * 200_000) == 0.0


def test_query_equals_a_plain_learner(spark, tmp_path):
    """op6_toxicity on a small table: lexicon, learned exceptions, curve and scores in plain Python."""
    rng = random.Random(3)
    prose = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(prose) for _ in range(20)]
        kind = i % 4
        if kind == 0:
            words[5] = rng.choice(["loser", "l0ser", "losers"])
        elif i % 16 == 1:
            words[5:7] = ["sore", "loser"]  # harmless
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == 0)))
    rows += [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = spark.createDataFrame([(i,) for i, _ in labels if zlib.crc32(str(i).encode()) % 5], "doc_id long")
    curve = {r[0] for r in seen.filter(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0).collect()}
    texts, kinds = dict(rows), dict(labels)
    ids = {r[0] for r in seen.collect()}
    teach = {texts[i]: kinds[i] for i in ids - curve}
    n = Counter(teach.values())
    odds = lambda t, c: (t + 0.1) / (n[1] + 0.2) / ((c + 0.5) / (n[0] + 1))

    def counts(of):
        found = {}
        for text, kind in teach.items():
            for e in of(toxicity.fold(text)):
                found.setdefault(e, [0, 0])[kind] += 1
        return found

    telling = [(e, t, odds(t, c)) for e, (c, t) in counts(toxicity.stems).items() if t >= toxicity.LEAST_DOCUMENTS and odds(t, c) >= toxicity.LEAST_ODDS]
    lexicon = toxicity.choose(telling)

    def around(words):
        s = f" {' '.join(words)} "
        hit = {len(s[: i + 1].split()) for e in lexicon for i in range(len(s)) if s.startswith(e, i)}
        return {" ".join(words[j : j + 2]) for i in hit for j in (i - 1, i) if 0 <= j < len(words) - 1}

    learned = [e for e, (c, t) in counts(around).items() if c >= toxicity.EXCEPTION_DOCUMENTS and odds(t, c) <= toxicity.EXCEPTION_ODDS]
    assert "sore loser" in learned
    model = toxicity.Model(lexicon, (*toxicity.EXCEPTIONS, *learned))
    fitted = [(model.figures(toxicity.fold(texts[i])), kinds[i]) for i in sorted(ids & curve)]
    model.curve = toxicity.fit_curve([f for f, _ in fitted], [k for _, k in fitted], [1.0] * len(fitted))
    for r in queries.op6_toxicity(spark, str(tmp_path)).collect():
        assert math.isclose(r["score"], model.score(texts[r["doc_id"]]), rel_tol=1e-5)
        assert r["predicted"] == (r["score"] >= 0.5) and (r["doc_id"] > 400 or r["predicted"] == kinds[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    out = queries.op6_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = out.join(labels, "doc_id").filter("held_out")
    right, positive, caught = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.sum("toxic"), F.sum(F.col("predicted") * F.col("toxic"))).first()
    assert right > 0.97 and caught > 0.85 * positive


def test_defined_results(spark, nasty, nothing):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, None), (None, 1), (6, 0), (8, 0)], "doc_id long, toxic int")
    model = toxicity.learn(nasty, labels)
    rows = toxicity.score(nasty, model).collect()
    assert len(rows) == nasty.count() and all(0 <= r["toxic_score"] <= 1 for r in rows)
    none = toxicity.learn(nothing, labels.limit(0))
    assert none.lexicon == {} and toxicity.score(nothing, none).count() == 0


def test_folding_of_random_runs_and_long_ones():
    """Equal to one pattern that is tried from every place; a million signs, digits and letters take a moment."""
    mixed = re.compile(r"[0-9@$!]*[^\W\d_][^\W_@$!]*(?:[0-9@$!]+[^\W_]+)+|[0-9@$]+[^\W\d_]+")
    rng = random.Random(0)
    for _ in range(20_000):
        text = "b4d " + "".join(rng.choice("aZé١²1405@$!_ -.") for _ in range(rng.randrange(14)))
        folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
        assert toxicity.fold(text) == re.findall(r"[^\W_]+", mixed.sub(lambda m: m[0].translate(toxicity._STAND), folded))
    started = time.perf_counter()
    for long in ("a" * 500_000 + "!" * 500_000, "1" * 1_000_000, "!" * 1_000_000, "a" * 1_000_000, "a1!" * 300_000, "1a_" * 300_000):
        toxicity.fold("b4d " + long)
    assert time.perf_counter() - started < 20
