import hashlib
import random
import re
import time

from quire.llm import decontaminate, queries
from tests.oracle import both

EDGE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(t):
    return EDGE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        if w and i is not None:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def ours(found):
    return sorted((tuple(r) for r in decontaminate.digest(found).collect()), key=str)


def test_query(spark, sf_dir, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = sorted((tuple(r) for r in queries.op10_decontaminate(spark, sf_dir).collect()), key=str)
    assert found == brute(texts.items(), items) and any(r[-1] for r in found)


def test_defined_results(spark, nasty, nothing):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    items = [(1, "quick BROWN fox"), (2, None), (3, ""), (None, "second line"), (4, "word0 token0 word1 token1 word2 token2 word3 token3 word4 token4 word5"), (5, "größe"), (5, "schön"), (6, "SAME text")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string")
    assert ours(decontaminate.find_contamination(nasty, bench)) == brute(rows, items)
    assert ours(decontaminate.find_contamination(nasty, bench.limit(0))) == brute(rows, [])
    assert ours(decontaminate.find_contamination(nothing, bench)) == []
    clean = decontaminate.decontaminated(nasty, bench)
    assert clean.columns == nasty.columns and {r["spans"] for r in clean.collect()} == {"clash"}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r[0]) for r in brute(rows, items) if not r[-1])


def test_sql(spark, sf_dir):
    a, b = both(spark, sf_dir, queries.op10_decontaminate, decontaminate.ORACLE_SQL)
    assert a == b and any("True" in r for r in a)


def test_spans_are_places_in_the_text(spark):
    docs = spark.createDataFrame([(1, "Say: The--Quick, brown FOX! again")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    row = decontaminate.find_contamination(docs, bench).first()
    assert [row["text"][s["start"] : s["end"]] for s in row["spans"]] == ["The--Quick, brown FOX"]


def test_items_that_share_words_and_shifts(spark):
    """Few words, so that anchors are common, windows overlap and items repeat each other."""
    rng = random.Random(0)
    for letters in ("ab", "abcd", "abcdefghijkl"):
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 9, 10, 11, 30])))) for i in range(25)]
        docs = []
        for i in range(60):
            found = [rng.choice(letters + "z") for _ in range(rng.randrange(40))]
            for _ in range(rng.randrange(3)):
                part = rng.choice(items)[1].split()
                a = rng.randrange(len(part))
                found[(k := rng.randrange(len(found) + 1)) : k] = part[a : a + rng.randrange(1, 16)]
            docs.append((i, " ".join(found)))
        scanner = decontaminate.Scanner(decontaminate.pack(items))
        expected = {r[0]: (r[2], r[3]) for r in brute(docs, items)}
        for i, t in docs:
            hit, item = scanner.scan(decontaminate.words(t))
            assert (len(hit), len(item)) == expected[i]


def test_a_large_benchmark_is_one_automaton(spark):
    """Beyond 8 MiB of items: few nodes for each window, built in moments, one scan in the plan."""
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(30_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=120))) for i in range(10_000)]
    assert sum(len(t) for _, t in items) > 8 << 20
    started = time.perf_counter()
    packed = decontaminate.pack(items)
    scanner = decontaminate.Scanner(packed)
    assert time.perf_counter() - started < 60
    windows = sum(len(t.split()) - 9 for _, t in items)
    assert scanner.automaton.get_stats()["nodes_count"] < 0.8 * windows
    part = items[77][1].split()
    text = ["x"] * 5 + part[30:45] + ["y"] + part[50:59]
    assert scanner.scan([w.encode() for w in text]) == (set(range(5, 20)), {"77"})
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    found = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found.first()["item_ids"] == ["77"]
