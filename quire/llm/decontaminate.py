"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words, and words to numbers.  Each window of ten
words (or a whole shorter item) is looked for by its rarest three words, its
anchor, and neighbouring windows mostly have the same one.  The automaton holds
all anchors, so a benchmark of any size is scanned for once and takes few nodes
for each window; where an anchor is met, the item and the text are compared to
both sides, and hits are mapped back to places in the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import repeat

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import append_columns, field, keeping_columns, of_worker

WINDOW = 10
#: Words of an anchor; shorter items are their own.
ANCHOR = 3

#: Bytes of UTF-8 that belong to no word become blanks, A-Z becomes a-z.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


@dataclass
class Items:
    """A benchmark as arrays: what is sent to all tasks, eight bytes a word or so."""

    key: str
    words: list[bytes]  # word n + 1
    numbers: np.ndarray  # of the items' words, one item after another
    starts: np.ndarray  # of items, and the end
    ids: list[str]
    anchors: np.ndarray  # places where windows have their anchors
    window: int


def pack(items: Iterable[tuple], window: int = WINDOW) -> Items:
    """Rows (item_id, text) as arrays; those without a word, with a null text or a null id have no windows."""
    number: dict[bytes, int] = {}
    parts, ids = [np.zeros(0, np.int32)], []
    for item_id, text in items:
        found = words(text)
        if found and item_id is not None:
            parts.append(np.array([number.setdefault(w, len(number) + 1) for w in found], np.int32))
            ids.append(str(item_id))
    numbers = np.concatenate(parts)
    starts = np.cumsum([len(p) for p in parts])
    return Items(uuid.uuid4().hex, list(number), numbers, starts, ids, _anchors(numbers, starts, window), window)


def _anchors(numbers: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The place of each window's anchor: that of its rarest words, of equally rare ones by a hash, then the first."""
    n = max(0, len(numbers) - ANCHOR + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(ANCHOR):
        grams = (grams + numbers[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    order = np.empty(n, np.int64)
    order[np.lexsort((np.arange(n), grams, counts[inverse]))] = np.arange(n)
    sizes = np.diff(starts)
    chosen = [starts[:-1][(sizes > 0) & (sizes < ANCHOR)]]  # shorter than an anchor
    for size in range(ANCHOR, window + 1):
        # windows of this many words: all of longer items for the full size, else whole items
        if size < window:
            first = starts[:-1][sizes == size]
        else:
            long = sizes >= window
            each = sizes[long] - window + 1
            first = np.repeat(starts[:-1][long] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        best = first
        for j in range(1, size - ANCHOR + 1):
            best = np.where(order[first + j] < order[best], first + j, best)
        chosen.append(best)
    return np.unique(np.concatenate(chosen)).astype(np.int64)


class Scanner:
    """The automaton of a benchmark's anchors, and what surrounds them."""

    def __init__(self, items: Items):
        self.items = items
        self.get = {w: n for n, w in enumerate(items.words, 1)}.get
        self.numbers, self.starts = items.numbers.tolist(), items.starts.tolist()
        places = items.anchors
        self.owner = dict(zip(places.tolist(), (np.searchsorted(items.starts, places, "right") - 1).tolist(), strict=True))
        at: dict[tuple, list[int]] = {}
        for p in places.tolist():
            at.setdefault(tuple(self.numbers[p : min(p + ANCHOR, self.starts[self.owner[p] + 1])]), []).append(p)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if at else None
        for key, where in at.items():
            self.automaton.add_word(key, (len(key), where))
        if at:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[set[int], set[str]]:
        """Places of hit words, and the ids of items with occurring windows, in the words of a text."""
        hit: set[int] = set()
        item: set[str] = set()
        if self.automaton is None or not found:
            return hit, item
        text = tuple(map(self.get, found, repeat(0)))
        seen: dict[int, int] = {}  # by the shift of text against items: how far that was compared
        for end, (length, where) in self.automaton.iter(text):
            d = end - length + 1
            for p in where:
                if seen.get(p - d, -1) > d:
                    continue
                owner = self.owner[p]
                lo, hi = self.starts[owner], self.starts[owner + 1]
                left, right = self._reach(text, d, p, lo, hi)
                seen[p - d] = d + right
                if left + right >= min(self.items.window, hi - lo):
                    hit.update(range(d - left, d + right))
                    item.add(self.items.ids[owner])
        return hit, item

    def _reach(self, text: tuple, d: int, p: int, lo: int, hi: int) -> tuple[int, int]:
        """Words before and from place *d* of the text that agree with those around *p* of the item in [lo, hi)."""
        numbers, left, right = self.numbers, 0, 0
        while left < min(d, p - lo) and text[d - left - 1] == numbers[p - left - 1]:
            left += 1
        while right < min(len(text) - d, hi - p) and text[d + right] == numbers[p + right]:
            right += 1
        return left, right


def _scan(sent):
    """A function from texts to word counts, hit words, items and spans."""
    scanner = of_worker(("items", sent.value.key), lambda: Scanner(sent.value))

    def scan(texts):
        counts, hits, items, spans = [], [], [], []
        for text in texts:
            found = words(text)
            hit, item = scanner.scan(found)
            counts.append(len(found))
            hits.append(sorted(hit))
            items.append(sorted(item))
            spans.append(_spans(text, hits[-1]))
        return counts, hits, items, spans

    return scan


def _spans(text: str | None, hit: list[int]) -> list[dict]:
    """Runs of hit words as places in the original text, in code points."""
    if not hit:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for i in hit:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [{"start": places[a][0], "end": places[b][1]} for a, b in runs]


_FIELDS = [
    field("n_words", T.LongType()),
    field("hit_words", T.ArrayType(T.IntegerType())),
    field("item_ids", T.ArrayType(T.StringType())),
    field("spans", T.ArrayType(T.StructType([field("start", T.IntegerType()), field("end", T.IntegerType())]))),
]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """*docs* with n_words, hit_words (word numbers from 0), item_ids and spans.

    Null or empty texts have no words and no hits; repeated rows are repeated;
    texts are scanned whole, however long.  An empty benchmark hits nothing.
    Columns of *docs* with those four names are replaced.  The benchmark, a
    table of test items, is sent to all tasks as arrays of word numbers.
    """
    pairs = benchmark.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    sent = docs.sparkSession.sparkContext.broadcast(pack((tuple(r) for r in pairs.toLocalIterator()), window))
    return append_columns(docs, ["text"], lambda: _scan(sent), _FIELDS)


def digest(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with the columns of *docs*."""
    return keeping_columns(docs, [f.name for f in _FIELDS], lambda rows: find_contamination(rows, benchmark, window).filter(F.size("hit_words") == 0))


#: The query on ``documents`` and ``benchmark``, for DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS phrase
  FROM b, generate_series(1, greatest(1, len(ws) - 9)) AS s(i) WHERE len(ws) > 0
), p AS (
  SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM d, (SELECT DISTINCT n FROM w) AS sizes, generate_series(1, len(ws) - n + 1) AS s(i)
), f AS (
  SELECT rid, i, p.n, item FROM p JOIN w ON w.n = p.n AND w.phrase = p.phrase
), h AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM f, generate_series(i, i + n - 1) AS s(k) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM f) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
