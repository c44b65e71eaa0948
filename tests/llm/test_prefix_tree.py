import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import prefix_tree, queries
from tests.oracle import both

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in BLANK else c for c in lowered).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=80):
    """rows: (doc_id, text) with distinct ids"""
    sets = {i: plain_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def ours(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_query(spark, sf_dir, texts):
    found = ours(queries.op12_ngram_join(spark, sf_dir))
    assert found == sorted(brute(texts.items()), key=str) and any(i != c for i, _, c in found)


def test_sql(spark, sf_dir):
    a, b = both(spark, sf_dir, queries.op12_ngram_join, prefix_tree.ORACLE_SQL)
    assert a == b and a


def crowd(seed, n):
    """Texts around common bases, from nearly equal to a little less like than the threshold, and around a passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    bases = [[word() for _ in range(rng.randrange(40, 160))] for _ in range(6)]
    passage = [word() for _ in range(90)]
    rows = []
    for i in range(n):
        if rng.random() < 0.25:
            own = [word() for _ in range(rng.randrange(4, 40))]
            found = passage + own if rng.random() < 0.5 else own + passage
        else:
            found = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                found[rng.randrange(len(found))] = word()
            if rng.random() < 0.3:
                found = found[: rng.randrange(len(found) * 3 // 4, len(found))]
        rows.append((i, " ".join(found)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [(512, 4096), (7, 3)])
def test_crowds(spark, monkeypatch, blocks):
    monkeypatch.setattr(prefix_tree, "TREE_SETS", blocks[0])
    monkeypatch.setattr(prefix_tree, "WALKS", blocks[1])
    rows = crowd(1, 300)
    expected = brute(rows)
    assert ours(prefix_tree.linked(made(spark, rows))) == sorted(expected, key=str)
    assert 10 < len({c for *_, c in expected}) < 250


def test_other_thresholds(spark):
    rows = crowd(2, 120)
    for percent in (50, 95, 100):
        assert ours(prefix_tree.linked(made(spark, rows), percent)) == sorted(brute(rows, percent), key=str)


def test_defined_results(spark, nasty, nothing):
    wide = nasty.withColumns({c: F.lit("clash") for c in ("h", "label", "total", "component_id", "n_shingles", "slot", "k1")})
    found = ours(prefix_tree.linked(wide))
    rows = {r["doc_id"]: r["text"] for r in nasty.collect() if r["doc_id"] is not None}
    no_id = [(None, len(plain_set(r["text"])), None) for r in nasty.filter("doc_id IS NULL").collect()]
    assert found == sorted(brute(rows.items()) + no_id, key=str)
    assert ours(prefix_tree.linked(nothing)) == []


def test_walks_equal_all_intersections():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.choice(400, 60, replace=False)
        sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.3, rng.integers(0, 400, 60), base)) for _ in range(25)]
        sets += [sets[0], sets[1][:20], sets[2][5:]]
        tree = prefix_tree.Tree(sets, [len(s) for s in sets], list(range(len(sets))))
        for x in (*sets[:5], rng.permutation(400)[:30]):
            x = np.sort(x)
            met = dict(tree.walk(x, len(x), 60, lambda _: False))
            for i, s in enumerate(sets):
                common = len(np.intersect1d(x, s))
                if 160 * common >= 60 * (len(x) + len(s)):
                    assert met[i] == common
                assert met.get(i, common) == common


def test_outlines_bound_what_sets_share():
    rng = np.random.default_rng(4)
    for _ in range(100):
        base = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = (np.unique(np.append(base[: int(rng.integers(0, 300))], rng.integers(0, 2**63, 50).astype(np.uint64))) for _ in "ab")
        x, y = (np.frombuffer(prefix_tree.outline(v), "<u2") for v in (a, b))
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b)) and x.sum() == len(a)


def test_outlines_of_large_sets_bound_and_tell_apart():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    own = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    half = [np.append(base[:1500], own(n)) for n in (1500, 1400, 600)]  # three sets of one passage, of which none is similar
    near = [base[:2000], np.append(base[:1950], own(150)), np.append(base[:2000], own(400))]
    row = lambda side, i, h: (0, 0, 0, 0, side, False, i, i, len(h), prefix_tree.outline(h))
    judged = lambda *rows: sorted(prefix_tree._judged(iter(rows), 80))
    assert len({len(prefix_tree.outline(h)) for h in near}) == 2
    assert judged(row(0, 1, near[0]), row(0, 2, half[0]), row(0, 3, near[2]), row(1, 4, near[1])) == [1, 3, 4]
    assert judged(row(0, 1, half[0]), row(0, 2, half[2]), row(1, 3, half[1])) == []


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 20), (50, 120)])
def test_sets_of_mostly_own_shingles_meet_nobody(spark, monkeypatch, limits):
    """Those that may be similar to another are all there; a passage of 30 words alone lets none meet."""
    monkeypatch.setattr(prefix_tree, "PART_SHINGLES", limits[0])
    monkeypatch.setattr(prefix_tree, "BLOCK_SHINGLES", limits[1])
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(90)] + passage)) for i in range(-5, 60)]
    rows += [(100 + i, rows[i][1] + " one more") for i in range(10)]
    seen, prefixes = [], prefix_tree._prefixes
    monkeypatch.setattr(prefix_tree, "_prefixes", lambda docs, reps, *a: (seen.extend(r[0] for r in reps.collect()), prefixes(docs, reps, *a))[1])
    assert ours(prefix_tree.linked(made(spark, rows))) == sorted(brute(rows), key=str)
    assert sorted(seen) == sorted([i for i, _ in rows[:10]] + [100 + i for i in range(10)])
