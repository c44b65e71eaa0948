import zlib

import numpy as np
import pytest

from quire.llm import bpe, packing, queries


def test_cut():
    assert packing.cut(3000, 1024) == [952, 1024, 1024] and packing.cut(1024, 1024) == [1024] and packing.cut(1, 1024) == [1]


def slow(lengths, capacity):
    """Sum of squares by trying every place."""
    bins = []
    for n in lengths:
        def cost(change):
            gaps = [b for b in bins]
            change(gaps)
            count = np.bincount([g for g in gaps if 0 < g < capacity], minlength=capacity + 1)
            return int((count**2).sum())

        if n >= capacity:
            bins.append(0)
            continue
        options = [(cost(lambda g: g.append(capacity - n)), 1, capacity, None)]
        for gap in sorted({g for g in bins if g >= n}):
            i = bins.index(gap)
            options.append((cost(lambda g, i=i: g.__setitem__(i, g[i] - n)), 0, gap, i))
        _, _, gap, i = min(options, key=lambda o: o[:3])
        if i is None:
            bins.append(capacity - n)
        else:
            bins[i] -= n
    return sorted(bins)


@pytest.mark.parametrize("seed", range(4))
def test_places_as_the_rule_says(seed):
    lengths = np.random.default_rng(seed).integers(1, 33, 120)
    bins, offsets = packing.sum_of_squares(lengths, 32)
    used = {}
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True):
        assert o == used.get(b, 0)
        used[b] = o + n
    assert sorted(32 - u for u in used.values()) == slow(lengths.tolist(), 32)


def check(rows, texts, capacity=1024):
    seqs, got = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    library = bpe.encoder().library
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at, expected = 0, []
        for k, n in enumerate(packing.cut(len(ids), capacity)):
            expected.append((k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
        assert sorted(got[doc_id]) == expected
    total = sum(r["length"] for r in rows)
    return len(seqs), -(-total // capacity)


def test_query(spark, sf_dir, texts):
    used, least = check(queries.op7_pack(spark, sf_dir).collect(), texts)
    assert used <= least * 1.05 + 1


def test_equal_and_null_ids_go_to_several_tasks(spark):
    rows = [(None, "some words to pack")] * 40 + [(7, "the same row again")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = packing.pack(packing.pieces(docs), share=10).collect()
    tasks = {(r["doc_id"], r["sequence_id"] >> packing.SEQUENCE_BITS) for r in found}
    assert len(found) == 80 and len([t for t in tasks if t[0] is None]) > 4 and len([t for t in tasks if t[0] == 7]) > 4
    places = {(r["sequence_id"], r["offset"]) for r in found}
    assert len(places) == 80


def test_defined_results(nasty, nothing):
    rows = packing.pack_documents(nasty).collect()
    check(rows, {r["doc_id"]: r["text"] for r in nasty.filter("doc_id IS NULL OR doc_id <> 6").collect()})
    assert sum(r["doc_id"] == 6 for r in rows) == 2
    assert packing.pack_documents(nothing).count() == 0
