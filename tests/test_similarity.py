"""Similarity and error rates against plain tables, and their cost on long texts."""

import random
import time

from quire.functions import text
from tests.test_whole import plain_edits


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] + 1 if x == y else max(above[j], row[j - 1]))
    return row[-1]


def changed(rng, a, n, letters):
    found = list(a)
    for _ in range(n):
        i = rng.randrange(len(found) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            found.insert(i, rng.choice(letters))
        elif found and kind == 1:
            found.pop(i - 1)
        elif found:
            found[i - 1] = rng.choice(letters)
    return "".join(found)


def pairs(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["ab", "abcdef", "a한😀é"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        yield a, changed(rng, a, rng.choice([0, 1, 2, 5, 30]), letters) if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randrange(120)))


def test_both_ways_equal_the_plain_tables(monkeypatch):
    for worth in (None, 0, 10**6):
        if worth is not None:
            monkeypatch.setattr(text, "_worth", lambda a, b, w=worth: w)
        for a, b in pairs(1, 250):
            assert text._common(a, b) == plain_common(a, b)
            assert text.edits(a, b) == plain_edits(a, b)


def test_runs_and_bounds():
    for a, b in pairs(2, 200):
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert text._run(a, b, 0, 0) == n and text._apart(a, b) <= plain_edits(a, b)
    assert text._differences("abc", "xyz", 2, True) is None and text._differences("abc", "xyz", 3, True) == 3
    assert text._differences("abc", "xyz", 5, False) is None and text._differences("abc", "xyz", 6, False) == 6


def test_similar_long_texts_take_moments():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(100_000))
    b = changed(rng, a, 20, "xyz")
    started = time.perf_counter()
    assert 1 <= text.edits(a, b) <= 20 and 0.999 < text.ratio(a, b) < 1
    assert time.perf_counter() - started < 0.5


def test_a_short_text_costs_by_its_own_letters():
    """Steps are those of the shorter text, and the longer one's places are found in one pass, whichever comes first."""
    rng = random.Random(5)
    long, short = "".join(rng.choices("abcdefgh", k=300_000)), "hgfedcbax" * 3
    start = time.process_time()
    for a, b in ((long, short), (short, long)):
        assert text._common(a, b) == 24 and text.edits(a, b) == len(long) - 24
    assert time.process_time() - start < 1


def test_long_unlike_texts_equal_the_plain_tables(monkeypatch):
    """Over 512 steps on numbers of some words, with letters that only one text has."""
    monkeypatch.setattr(text, "_worth", lambda a, b: 0)
    rng = random.Random(6)
    for n, m in ((1300, 700), (700, 1300), (513, 512), (30, 1100)):
        a, b = ("".join(rng.choice(letters) for _ in range(k)) for letters, k in (("abc한e", n), ("abc😀fg", m)))
        assert text._common(a, b) == plain_common(a, b)
        assert text.edits(a, b) == plain_edits(a, b)
