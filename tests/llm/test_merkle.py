import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from quire.llm import merkle, queries
from tests.oracle import both


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest("".join(found[-1][i : i + 3])) for i in range(0, len(found[-1]), 3)])
    return found


def climb(of, at, h, proof):
    for level in of[:-1]:
        a, run = at % 3, level[at - at % 3 : at - at % 3 + 3]
        proof += run[:a] + run[a + 1 :]
        h = digest("".join(run[:a] + [h] + run[a + 1 :]))
        at //= 3
    return h


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = levels([plain_leaf(r) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            t = r[4]
            if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                t = t.replace("\n", "")
            proof = []
            h = climb(trees[s], i, plain_leaf((*r[:4], t)), proof)
            h = climb(top, n, h, proof)
            out.append((r[0], plain_leaf(r), trees[s][-1][0], top[-1][0], digest("".join(proof)), h, h == top[-1][0]))
    return sorted(out, key=str)


def ours(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def of_table(df):
    return [tuple(r) for r in df.select(*merkle.FIELDS).collect()]


def test_query(spark, sf_dir, documents):
    found = ours(queries.op13_merkle_manifest(spark, sf_dir))
    assert found == brute(of_table(documents)) and {r[-1] for r in found} == {True, False}


def test_sql(spark, sf_dir):
    a, b = both(spark, sf_dir, queries.op13_merkle_manifest, merkle.ORACLE_SQL)
    assert a == b and a


def test_trees_of_every_size(spark):
    """Sources of one leaf to several tiers, so that blocks end at, before and after a level."""
    sizes = [1, 2, 3, 4, 5, 9, 10, 80, 81, 82, 242, 243, 244, 245, 486, 487, 2000]
    rows = [(100_000 * n + i, f"s{n}", "en", i, f"text {i}\nof {n}") for n, size in enumerate(sizes) for i in range(size)]
    rows += [(10_000_000 + i, f"many{i}", None, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert ours(merkle.audit(df)) == brute(rows)


def test_defined_results(spark, nasty, nothing):
    wide = nasty.withColumns({"source": F.when(F.col("doc_id") % 2 == 0, F.lit("süd")).when(F.col("doc_id") % 3 == 0, F.lit("")), "n_chars": F.length("text").cast("long")})
    wide = wide.withColumns({c: F.lit("clash") for c in ("tree", "pos", "total", "leaf", "path", "root", "block", "digest", "h", "p1", "name")})
    found = ours(merkle.audit(wide))
    assert found == brute(of_table(wide)) and len(found) == wide.count()
    empty = nothing.withColumns({"source": F.lit("a"), "n_chars": F.lit(1)})
    assert ours(merkle.audit(empty)) == []


def test_a_proof_is_the_document_s_alone(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.build(df.select("doc_id", "source", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf")))
    found = merkle.proofs(m).select("doc_id", (merkle.folded("leaf", "path") == F.col("root")).alias("own"), (merkle.folded(F.sha2(F.lit("x"), 256), "path") == F.col("root")).alias("other"))
    assert {(r["own"], r["other"]) for r in found.collect()} == {(True, False)}
