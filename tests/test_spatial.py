"""Containment on small and huge pages against all pairs of boxes."""

import random

from pyspark.sql import functions as F

from quire.operators import sampling, validate


def boxes(seed, n, size):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.randrange(size), rng.randrange(size), rng.choice([5, 20, 60]), rng.choice([5, 20, 60])
        if i % 9 == 0:
            x, y, w, h = x - size // 3, y - size // 3, size // 2, size // 2
        poly = [x, y, x + w, y, x + w, y + h, x, y + h]
        out.append((f"f{seed}", str(i), "table" if i % 3 == 0 else "figure", [float(v) for v in poly]))
    return out


def plain(rows, least=0.9):
    found = set()
    for f, a, kind, p in rows:
        if kind != "table":
            continue
        for g, b, _, c in rows:
            if f != g or a == b:
                continue
            wide = max(0.0, min(p[2], c[2]) - max(p[0], c[0]))
            high = max(0.0, min(p[5], c[5]) - max(p[1], c[1]))
            if wide * high / ((c[2] - c[0]) * (c[5] - c[1])) >= least:
                found.add((f, a, b))
    return found


def test_pages_in_cells_lose_no_pair_and_make_none_twice(spark):
    rows = boxes(1, 900, 1500) + boxes(2, 12, 100) + boxes(3, 40, 4)
    ann = spark.createDataFrame(rows, "file string, anno_id string, category string, poly array<double>").withColumn("poly_len", F.size("poly"))
    found = [(r["file"], r["anno_id"], r["child_id"]) for r in validate._inside(ann.filter("category = 'table'"), ann, 0.9).select("file", "anno_id", "child_id").collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows) and len(found) > 100


def test_a_huge_page_is_many_keys(spark):
    rows = [("one", str(i), "table", [float(v) for v in (i % 300, i // 300, i % 300 + 2, i // 300, i % 300 + 2, i // 300 + 2, i % 300, i // 300 + 2)]) for i in range(30_000)]
    ann = spark.createDataFrame(rows, "file string, anno_id string, category string, poly array<double>").withColumn("poly_len", F.size("poly"))
    from quire.functions import geometry

    placed = ann.withColumns({"b": geometry.box("poly"), "side": F.lit(validate.CELLS), "x0": F.lit(0.0), "y0": F.lit(0.0), "xn": F.lit(302.0), "yn": F.lit(102.0)})
    sizes = validate._in_cells(placed, "b").groupBy("file", "cx", "cy").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] < 400 and sizes[1] == 256
    alone = ann.limit(3000)
    assert validate._inside(alone, alone, 0.9).count() == 0


def test_draws_do_not_depend_on_partitions(spark):
    rows = [(i, f"g{i % 4}") for i in range(200)] + [(1000, "one"), (None, "none")]
    df = spark.createDataFrame(rows, "id long, g string")
    found = []
    for n in (1, 7):
        got = df.repartition(n).groupBy("g").agg(sampling.draws("id", "id", 5, seed=3).alias("d"))
        found.append({r["g"]: r["d"] for r in got.collect()})
    assert found[0] == found[1] and found[0]["one"] == [1000] and found[0]["none"] == [] and all(len(found[0][f"g{i}"]) == 5 for i in range(4))
    many = df.filter("g = 'g0'").groupBy().agg(sampling.draws("id", "id", 400).alias("d")).first()["d"]
    assert len(many) == 50 and 20 < len(set(many)) < 45  # with replacement
