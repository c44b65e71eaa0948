import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import line_dedup, queries
from tests.oracle import both

SPACE = " \t\n\v\f\r"


def brute(rows, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=str)


def test_sql(spark, sf_dir):
    a, b = both(spark, sf_dir, queries.op5_line_dedup, line_dedup.ORACLE_SQL)
    assert a == b and a


def test_defined_results_both_ways(nasty, nothing):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    index = line_dedup.build(nasty, least=2)
    assert ours(line_dedup.apply(index, nasty)) == brute(rows, 2) == ours(line_dedup.apply(index, nasty, broadcast_keys=0))
    assert set(nasty.columns) <= set(line_dedup.apply(index, nasty).columns)
    assert ours(line_dedup.apply(line_dedup.build(nothing), nothing)) == []
    assert ours(line_dedup.apply(line_dedup.build(nothing), nasty)) == brute(rows, 99)


def test_joined_and_broadcast_results_are_equal(spark, monkeypatch):
    """With string ids and columns that clash with what the operator might call its own."""
    rows = [(f"d{i % 7}", f"line {i % 3}\nown {i}\n\nline {i % 2}" if i % 5 else None, i, f"h{i}", float(i), "m", [i], "k") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, id int, h string, __h double, m string, place array<int>, text_digest string").repartition(3)
    docs = docs.withColumns({"n_lines": F.lit("clash"), "dropped_places": F.col("id"), "k1": F.lit(None).cast("int"), "n_dropped": F.lit(1)})
    index = line_dedup.build(docs, least=4)
    one, two = (line_dedup.apply(index, docs, broadcast_keys=n) for n in (1000, 0))
    assert one.columns == two.columns and set(docs.columns) <= set(one.columns)
    values = lambda df: sorted(map(str, df.collect()))
    assert values(one) == values(two)
    found = {r["id"]: r for r in two.collect()}
    assert ours(two) == brute([(r[0], r[1]) for r in rows], 4)
    assert all((found[i]["doc_id"], found[i]["h"], found[i]["__h"], found[i]["place"], found[i]["text_digest"]) == (r[0], r[3], r[4], r[6], r[7]) for i, r in enumerate(rows))


def test_index_is_dealt_anew_as_it_grows(spark, documents, monkeypatch):
    docs = documents.select("doc_id", "text")
    few, rest = docs.filter("doc_id < 5"), docs.filter("doc_id >= 5")
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 50)
    grown = line_dedup.insert(line_dedup.build(few, least=3), rest)
    assert grown.shards == line_dedup.build(docs, least=3).shards > 2 * line_dedup.build(few, least=3).shards
    assert grown.counts.filter(f"shard <> pmod(k1, {grown.shards})").count() == 0
    assert ours(line_dedup.apply(grown, docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 3)


def test_insertions_and_deletions_undo_each_other(spark, documents):
    docs = documents.select("doc_id", "text")
    a, b = docs.filter("doc_id % 3 > 0"), docs.filter("doc_id % 3 = 0")
    first = line_dedup.build(a, least=3)
    grown = line_dedup.insert(first, b)
    back = line_dedup.delete(grown, b)
    counts = lambda ix: sorted(tuple(r) for r in ix.counts.select("k1", "k2", "n").collect())
    assert counts(grown) == counts(line_dedup.build(docs, least=3)) and counts(back) == counts(first)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ours(line_dedup.apply(grown, docs)) == brute(rows, 3)
    assert ours(line_dedup.apply(back, docs)) == ours(line_dedup.apply(first, docs)) != ours(line_dedup.apply(grown, docs))


def test_cuckoo_filter():
    rng = random.Random(0)
    keys = list({(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(5000)})
    found = line_dedup.CuckooFilter.of(keys[:4000])
    assert all(found.contains(*k) for k in keys[:4000])
    assert sum(found.contains(*k) for k in keys[4000:]) < 10
    assert all(found.delete(*k) for k in keys[:2000]) and all(found.contains(*k) for k in keys[2000:4000])
    again = line_dedup.CuckooFilter.from_bytes(found.to_bytes())
    assert again.n == found.n == 2000 and all(again.contains(*k) for k in keys[2000:4000])
    full = line_dedup.CuckooFilter(4)
    before = [k for k in keys if full.insert(*k)]
    assert all(full.contains(*k) for k in before)
