from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm.decontaminate import words
from tests.llm import test_decontaminate, test_line_dedup, test_minhash, test_packing


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    (_, language), (_, lines), (_, near), (_, leaks), (_, packed) = corpus_pipeline.STAGES

    def after(stage, docs, at):
        path = f"{corpus_pipeline.staged.__globals__['shared_dir'](spark)}/pipeline-{at}"
        out = stage(spark, docs, sf_dir)
        out.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    one = after(language, docs, 1)
    assert one.columns == columns and docs.count() >= one.count() >= 0.97 * docs.count()
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    assert all(any(w.isalpha() for w in t) for t in rows.values())

    two = after(lines, one, 2)
    expected = {r[0]: r[3] for r in test_line_dedup.brute(rows.items(), 10)}
    import hashlib

    assert two.columns == columns and {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in two.collect()} == expected
    rows = {r["doc_id"]: r["text"] for r in two.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = after(near, two, 3)
    classes = test_minhash.brute(rows)
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == sorted(set(classes.values()))
    rows = {r["doc_id"]: r["text"] for r in three.collect()}

    four = after(leaks, three, 4)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in test_decontaminate.brute(rows.items(), items) if not r[-1]}
    assert four.columns == columns and {r["doc_id"] for r in four.collect()} == clean

    test_packing.check(after(packed, four, 5).collect(), {k: v for k, v in rows.items() if k in clean})
    assert words("x")


def odd_rows(nasty):
    """The odd rows, with the columns of documents besides."""
    return nasty.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


def test_stages_on_odd_and_empty_tables(spark, sf_dir, nasty, nothing):
    """Nulls, empty and long texts, repeated rows and columns with the operators' own names."""
    docs = odd_rows(nasty)
    given = docs.collect()
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns
            kept = {c for r in rows for c in ("spans", "n_lines", "lang_pred", "rep") if r[c] != "clash"}
            assert not kept
        ids = sorted(str(r["doc_id"]) for r in rows)
        every = sorted(str(r["doc_id"]) for r in given)
        if k == 0:
            assert not {"2", "3", "4", "10"} & set(ids) and {"5", "8"} <= set(ids)
        elif k == 1:
            assert ids == every and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in rows)
        elif k == 2:
            assert ids == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, 9, 10, None, 11]))
        elif k == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            clean = [str(r[0]) for r in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in given], items) if not r[-1]]
            assert ids == sorted(clean)
        else:
            assert set(ids) == set(every) and sum(i == "6" for i in ids) == 2


def test_run_is_the_stages_in_turn(spark, sf_dir, nasty, tmp_path):
    """On odd rows among clean ones, equal to each stage written and read again."""
    where = str(tmp_path)
    few = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = odd_rows(nasty).select(*few.columns).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    few.unionByName(odd).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{where}/benchmark.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(f"{where}/after-{n}")
        docs = spark.read.parquet(f"{where}/after-{n}")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = corpus_pipeline.run(spark, where)
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, docs.select(columns).collect()))
    places = {(r["sequence_id"], r["offset"]) for r in found.collect()}
    assert len(places) == found.count() > 40
