import math
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from quire.llm import quality, queries
from tests.oracle import both


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_figures(spark, sf_dir, texts):
    for r in queries.op8_quality_rules(spark, sf_dir).collect():
        figures = base(texts[r["doc_id"]])
        assert tuple(r[c] for c in COLUMNS) == figures
        assert r["base_failed"] == (figures[0] < 50 or 100 * figures[4] > 50 * figures[0])
        assert not (r["kept"] and r["base_failed"])


def test_sql(spark, sf_dir):
    """All columns, also those of the estimated accuracies: posterior and kept."""
    a, b = both(spark, sf_dir, queries.op8_quality_rules, quality.ORACLE_SQL)
    assert a == b and len({r[2] for r in a}) == 2


def test_defined_results(nasty, nothing):
    rows = quality.judge(nasty).collect()
    texts = sorted((base(r["text"]) for r in nasty.collect()))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == texts
    assert quality.judge(nothing).count() == 0


def plain_em(rows, k, rounds):
    prior, good, bad = quality.START_PRIOR, [quality.START_GOOD] * k, [quality.START_BAD] * k
    clip = lambda x, b: max(b[0], min(b[1], x))
    for _ in range(rounds):
        post = []
        for v in rows:
            t = math.log(prior / (1 - prior))
            for j in range(k):
                t += math.log(good[j] / (1 - bad[j])) if v[j] == 1 else math.log((1 - good[j]) / bad[j]) if v[j] == -1 else 0
            post.append(1 / (1 + math.exp(-t)))
        s = quality.SMOOTHING
        prior = clip((sum(post) + s * quality.START_PRIOR) / (len(rows) + s), quality.PRIOR)
        of = lambda j, vote, w: sum(x for v, x in zip(rows, w, strict=True) if v[j] == vote)
        rest = [1 - p for p in post]
        good = [clip((of(j, 1, post) + s * quality.START_GOOD) / (of(j, 1, post) + of(j, -1, post) + s), quality.GOOD) for j in range(k)]
        bad = [clip((of(j, -1, rest) + s * quality.START_BAD) / (of(j, 1, rest) + of(j, -1, rest) + s), quality.BAD) for j in range(k)]
        bad = [max(b, 1.01 - g) for b, g in zip(bad, good, strict=True)]
    return prior, good, bad


def test_estimate_equals_plain_rounds(spark):
    rows = [(1, 1, 1)] * 40 + [(1, -1, 0)] * 5 + [(-1, -1, -1)] * 12 + [(-1, 1, 0)] * 3 + [v for v in product((-1, 0, 1), repeat=3)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    prior, good, bad = quality.estimate(df, ["a", "b", "c"], 6)
    p, g, b = plain_em(rows, 3, 6)
    assert prior == pytest.approx(p) and good == pytest.approx(g) and bad == pytest.approx(b)


def test_no_rows_keep_the_start_values(spark):
    df = spark.createDataFrame([], "a int")
    assert quality.estimate(df, ["a"])[0] == pytest.approx(quality.START_PRIOR)


def test_labels(spark):
    out = queries.op8_quality_rules(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    both = out.join(labels, "doc_id").filter("NOT base_failed").withColumn("right", (F.col("kept") == (F.col("quality") == 1)).cast("double"))
    rows = {r["quality"]: r["right"] for r in both.groupBy("quality").agg(F.avg("right").alias("right")).collect()}
    assert rows[0] > 0.9 and rows[1] > 0.98


def test_plan_is_native(spark, documents):
    plan = quality.features(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
