import json
import random
import time

from pyspark.sql import functions as F

from quire.functions import json_pieces
from quire.operators import profile


def value(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return [None, rng.randrange(100), rng.random() < 0.5, rng.choice(['', 'a"b', "{[,:]}", "é\\n\\", "x y"])][kind]
    if kind == 4:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b.c", 'q"', "{", "한"]) + str(i): value(rng, depth - 1) for i in range(rng.randrange(4))}


def plain(v, name=""):
    for k, x in v.items() if isinstance(v, dict) else ():
        of = f"{name}.{k}" if name else k
        yield of, x
        yield from plain(x, of)


def test_keys_of_random_values():
    rng = random.Random(0)
    for _ in range(300):
        v = {"top": value(rng, 5), "other": value(rng, 3)}
        for text in (json.dumps(v), json.dumps(v, ensure_ascii=False, separators=(",", ":")), json.dumps(v, indent=2)):
            assert [(k, json.loads(p)) for k, p in json_pieces.keys(text)] == list(plain(v))
        assert [k for k, _ in json_pieces.keys(text, 1)] == ["top", "other"]
    assert list(json_pieces.keys("[1, {\"a\": 2}]")) == [] == list(json_pieces.keys("null"))


def test_deep_values_take_one_pass():
    n = 3000
    started = time.perf_counter()
    assert sum(1 for _ in json_pieces.keys('{"a":' * n + "1" + "}" * n)) == n
    assert time.perf_counter() - started < 5


def test_one_scan_in_the_plan(spark):
    rows = [(i, json.dumps({"a": {"b": {"c": i}}, "d": [1, {"e": 2}], "f": None})) for i in range(5)] + [(9, "[1]"), (10, "null"), (11, None)]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("v", F.try_parse_json("j"))
    found = profile.unpivot(df, "v", ["id"])
    keys = found.groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in keys} == {"a": 5, "a.b": 5, "a.b.c": 5, "d": 5, "f": 5}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan
    assert profile.unpivot(df, "v", ["id"], 1).select("key").distinct().count() == 3
