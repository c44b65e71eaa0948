import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from quire.llm import divergence, queries
from tests.oracle import both

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=10, top=10):
    """rows: (text, lang, source)"""
    counts, df = {}, Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        df.update((lang, t) for t in set(found))
    out = []
    for lang, groups in counts.items():
        kept = [t for (of, t), n in df.items() if of == lang and n >= least]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, found, ranks in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found[:ranks], 1)]
    return sorted(out)


def ours(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def of_table(df):
    return [tuple(r) for r in df.select("text", "lang", "source").collect()]


def test_query(spark, sf_dir, documents):
    found = ours(queries.op11_source_divergence(spark, sf_dir))
    assert found == brute(of_table(documents)) and {r[2] for r in found} == {"pair", "term"}


def test_sql(spark, sf_dir):
    a, b = both(spark, sf_dir, queries.op11_source_divergence, divergence.ORACLE_SQL)
    assert a == b and a


def test_many_chunks_and_counts_passed_on_early(spark, documents, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 7)
    monkeypatch.setattr(divergence, "HELD_TERMS", 100)
    some = documents.limit(60)
    assert ours(divergence.audit(some, least=2, top=3)) == brute(of_table(some), 2, 3)


def test_defined_results(spark, nasty, nothing):
    source = F.when(F.col("doc_id") % 2 == 0, F.lit("a")).when(F.col("doc_id") % 3 == 0, F.lit("ß"))
    wide = nasty.withColumn("source", source).withColumns({c: F.lit("clash") for c in ("term", "n", "df", "part", "seq", "ids", "total", "groups")})
    for least in (1, 2, 100):
        assert ours(divergence.audit(wide, least)) == brute(of_table(wide), least)
    assert ours(divergence.audit(nothing.withColumn("source", F.lit("a")))) == []


def test_counts_beyond_64_bits_of_product():
    counts = np.array([[10**11, 3], [0, 10**12]])
    totals = counts.sum(axis=1)
    found = divergence.shares(counts, totals[:, None], 2)
    assert found.tolist() == [[1 + 10**9 * (int(c) + 2) // (int(t) + 4) for c in row] for row, t in zip(counts, totals, strict=True)]
    assert divergence._summed(np.array([0, 1]), np.array([(1 << 60) + 1, 5]), 3).tolist() == [(1 << 60) + 1, 5, 0]
