"""Streams: restarts, state that is forgotten, logs and windows."""

import datetime as dt

from quire.streaming import incremental

SCHEMA = "doc_id string, embedding array<double>, ts timestamp"


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


def put(spark, where, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)


def source(spark, where, schema=SCHEMA):
    return spark.readStream.schema(schema).parquet(where)


def test_a_restarted_stream_adds_nothing_twice(spark, tmp_path):
    incoming, path, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    put(spark, incoming, [("a", [1.0], at(1)), ("b", [2.0], at(1)), ("a", [3.0], at(2)), (None, [9.0], at(2))])
    run = lambda: incremental.append_new_vectors(source(spark, incoming), path, checkpoint).awaitTermination()
    run()
    docs = lambda: sorted(r["doc_id"] for r in spark.read.parquet(path).collect())
    assert docs() == ["a", "b"]
    run()
    assert docs() == ["a", "b"]
    put(spark, incoming, [("b", [5.0], at(3)), ("c", [6.0], at(3))])
    run()
    assert docs() == ["a", "b", "c"]
    first = {r["doc_id"]: r["embedding"] for r in spark.read.parquet(path).collect()}
    assert first["b"] == [2.0] and first["a"] in ([1.0], [3.0])


def test_stored_documents_and_state_that_ends(spark, tmp_path):
    incoming, path, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    stored = spark.createDataFrame([("old",)], "doc_id string")
    put(spark, incoming, [("old", [1.0], at(1)), ("a", [2.0], at(1))])
    run = lambda: incremental.append_new_vectors(source(spark, incoming), path, checkpoint, time="ts", keep_for="2 hours", stored=stored).awaitTermination()
    run()
    put(spark, incoming, [("a", [3.0], at(2)), ("b", [4.0], at(2))])
    run()
    count = lambda: spark.read.parquet(path).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in count()} == {"a": 1, "b": 1}
    put(spark, incoming, [("z", [0.0], at(1, day=3))])  # time goes on; a is forgotten
    run()
    put(spark, incoming, [("a", [5.0], at(2, day=3))])
    run()
    assert {r["doc_id"]: r["count"] for r in count()} == {"a": 2, "b": 1, "z": 1}


def test_review_log(spark, tmp_path):
    schema = "file string, is_error boolean, error_types array<string>, memo string, reviewed boolean, ts timestamp"
    incoming, path, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    put(spark, incoming, [("f", True, ["x"], "m", True, at(1)), ("g", False, [], "", True, at(1))], schema)
    incremental.append_reviews(source(spark, incoming, schema), path, checkpoint).awaitTermination()
    put(spark, incoming, [("f", False, [], "better", True, at(2))], schema)
    incremental.append_reviews(source(spark, incoming, schema), path, checkpoint).awaitTermination()
    log = spark.read.parquet(path)
    assert log.count() == 3 and {(r["file"], r["is_error"], r["memo"]) for r in incremental.current_reviews(log).collect()} == {("f", False, "better"), ("g", False, "")}


def test_findings_per_window(spark, tmp_path):
    schema = "rule_id string, ts timestamp"
    incoming = f"file://{tmp_path}/in"
    rows = [("empty_text", dt.datetime(2024, 1, 1, 1, m)) for m in (1, 2, 11)] + [("invalid_poly", dt.datetime(2024, 1, 1, 1, 3))]
    put(spark, incoming, rows, schema)
    query = incremental.findings_per_window(source(spark, incoming, schema)).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r["window"]["start"].minute, r["rule_id"], r["n"]) for r in spark.table("windows").collect()}
    assert found == {(0, "empty_text", 2), (10, "empty_text", 1), (0, "invalid_poly", 1)}
