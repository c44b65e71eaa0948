"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: compatibility forms, case, look-alike letters and
digits or signs that stand for letters inside words.  Lexicon entries are whole
words or stems (word beginnings) whose weights, log odds by document, are
learned from labelled rows; exception phrases, listed and learned, cancel the
entries they cover.
The summed weights, over a growing function of the length, give the score.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field as datafield

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import append_columns, field, short_batches, staged

#: Labelled documents of each class that the lexicon is learned from, at most
#: about; drawn by a hash of doc_id.
SAMPLE = 4_000
STEM = (4, 10)
#: An entry is in so many toxic documents of the sample at least, and its odds
#: of being in a toxic one are so many times those of being in another.
LEAST_DOCUMENTS = 6
LEAST_ODDS = 6.0
#: An entry and the word before or after it are an exception if so many clean
#: documents of the sample hold them and the odds of a toxic one are so small a
#: part of those of a clean one.
EXCEPTION_DOCUMENTS = 6
EXCEPTION_ODDS = 1 / 6

#: Letters of other scripts by the Latin letter they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ԁ": "d", "ո": "n", "ս": "u",
}
#: Digits and signs by the letter they stand for inside a word.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
#: Phrases in which entries are harmless, besides those that are learned; more can be given.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "clown fish", "class clown car", "pond scum")

_ALIKE = str.maketrans(LOOK_ALIKES)
_STAND = str.maketrans(STANDS_FOR)
_ANY_ALIKE = re.compile("[" + "".join(LOOK_ALIKES) + "]").search
_UNSEEN = re.compile("[­​-‏⁠﻿]")
#: A run of letters, digits and signs that has a digit or sign; tried at its start only, and once.
_RUN = re.compile(r"(?<![^\W_])(?<![@$!])[^\W0-9_]*+[0-9@$!](?:[^\W_]|[@$!])*+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"[0-9@$!]")
_HAS_SIGN = re.compile(r"[0-9@$!][^\W\d_]").search
_WORDS = re.compile(r"[^\W_]+").findall


def _unmasked(m: re.Match) -> str:
    """A run with its digits and signs read as letters.

    That is from the digits and signs before its first letter to its last letter
    or digit, if one of them is inside, else only those before and the letters.
    """
    run = m[0]
    letters = _LETTERS.search(run)
    if not letters:
        return run
    first, end = letters.start(), len(run.rstrip("@$!"))
    if _SIGN.search(run, first + 1, end - 1):
        start = len(run[:first].rstrip("0123456789@$!"))
    else:
        start, end = len(run[:first].rstrip("0123456789@$")), letters.end()
        if start == first:
            return run
    return run[:start] + run[start:end].translate(_STAND) + run[end:]


def fold(text: str | None) -> list[str]:
    """The folded words of a text; a null text has none."""
    if not text:
        return []
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if not text.isascii() and _ANY_ALIKE(text):
        text = text.translate(_ALIKE)
    if _HAS_SIGN(text):
        text = _RUN.sub(_unmasked, text)
    return _WORDS(text)


def stems(words: Iterable[str]) -> set[str]:
    """Candidate entries of a document: `` word `` and `` stem``, with the blanks."""
    found = set()
    for w in set(words):
        found.add(f" {w} ")
        for n in range(STEM[0], min(len(w), STEM[1]) + 1):
            found.add(f" {w[:n]}")
    return found


def choose(found: Iterable[tuple[str, int, float]]) -> dict[str, float]:
    """Weights of the entries kept, from candidates, the toxic documents that hold them and their odds.

    Of a candidate and its beginnings only the one that tells most is kept.
    """
    gains = [(t * math.log(odds), k, math.log(odds)) for k, t, odds in found]
    gains.sort(key=lambda g: (-g[0], len(g[1]), g[1]))
    kept: dict[str, float] = {}
    below: set[str] = set()  # beginnings of kept entries
    for _, k, weight in gains:
        if k in below or any(k[:n] in kept for n in range(STEM[0] + 1, len(k))):
            continue
        kept[k] = weight
        below.update(k[:n] for n in range(STEM[0] + 1, len(k)))
    return kept


@dataclass
class Model:
    """A learned lexicon and the curve from its figures to a score."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 1.0, 0.0)
    _automaton: object = datafield(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None and (self.lexicon or self.exceptions):
            a = ahocorasick.Automaton()
            for k, w in self.lexicon.items():
                a.add_word(k, (len(k), w))
            for phrase in self.exceptions:
                if words := fold(phrase):
                    a.add_word(k := f" {' '.join(words)} ", (len(k), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weight(self, words: list[str]) -> float:
        """Summed weights of the entries that no exception phrase covers."""
        a = self.automaton()
        if a is None or not words:
            return 0.0
        hits, excused = [], []
        for end, (n, w) in a.iter(f" {' '.join(words)} "):
            (excused if w is None else hits).append((end - n + 1, end, w))
        total, first = 0.0, math.inf  # where the exceptions that end here or later begin
        while hits:
            a, b, w = hits.pop()
            while excused and excused[-1][1] >= b:
                first = min(first, excused.pop()[0])
            total += w if a < first else 0.0
        return total

    def neighbours(self, words: list[str]) -> set[str]:
        """Entries of the lexicon in a text with the word before, and with the word after, them."""
        a = self.automaton()
        found: set[str] = set()
        if a is None or len(words) < 2:
            return found
        starts, at = [], 0
        for word in words:
            starts.append(at)
            at += len(word) + 1
        for end, (n, w) in a.iter(f" {' '.join(words)} "):
            if w is not None:
                i = bisect.bisect_right(starts, end - n + 1) - 1
                found.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
        return found

    def figures(self, words: list[str]) -> tuple[float, float]:
        """The weight by length, twice: less than in proportion, and in proportion."""
        total, n = self.weight(words), len(words)
        return total / math.sqrt(n + 20), 20 * total / (n + 20)

    def score(self, text: str | None) -> float:
        x, y = self.figures(fold(text))
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def fit_curve(figures: Sequence[tuple[float, float]], labels: Sequence[int], weights: Sequence[float]) -> tuple[float, ...]:
    """Weighted logistic regression on the figures, with a small ridge, by Newton's steps."""
    x = np.column_stack([np.ones(len(labels)), np.array(figures, float).reshape(-1, 2)])
    y, w, beta = np.array(labels, float), np.array(weights, float), np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict]:
    """Distinct texts of a bounded sample of labelled rows, with toxic and
    for_curve; all labelled rows by class.

    The sample's ids are few, at most about *sample* of each class, so they are
    sent to the documents.  A document with labels of both kinds is toxic.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample / max(1, counts.get(0, 0))))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = drawn.withColumn("for_curve", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0)
    found = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(held), "doc_id")
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"), F.max("for_curve").alias("for_curve")), counts


def _counted(texts: DataFrame, make: Callable[[], Callable[[list[str]], set[str]]]) -> DataFrame:
    """entry, t and c: the toxic and the other documents that hold each entry that ``make()`` finds in folded words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, seen = make(), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[toxic].update(entries(fold(text)))
        some = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(some), 50_000):
            part = some[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[k][e] for e in part], pa.int64()) for k in (1, 0))], ["entry", "t", "c"])

    found = texts.select("text", F.col("toxic").cast("int")).mapInArrow(run, "entry string, t long, c long")
    return found.groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _odds(n_toxic: int, n_clean: int) -> Column:
    """How much likelier a toxic document holds an entry than another does."""
    return ((F.col("t") + 0.1) / (n_toxic + 0.2)) / ((F.col("c") + 0.5) / (n_clean + 1))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: Sequence[str] = EXCEPTIONS) -> Model:
    """A model of the rows of *labels* (doc_id, toxic), whichever of them the caller lets it see.

    Rows with a null id, text or label teach nothing.  Without toxic rows the
    lexicon is empty.  Candidates are counted and sifted where the texts are, so
    only entries of the lexicon, their beginnings and exceptions reach the
    driver.  *exceptions* are kept besides those learned from clean rows.
    """
    short_batches(docs.sparkSession)
    spread, counts = _labelled(docs, labels, sample)
    texts = staged(spread, "toxic-sample")
    teach = texts.filter("NOT for_curve")
    sizes = {r["toxic"]: r["n"] for r in teach.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = _odds(sizes.get(1, 0), sizes.get(0, 0)).alias("odds")
    telling = _counted(teach, lambda: stems).select("entry", "t", odds).filter((F.col("t") >= LEAST_DOCUMENTS) & (F.col("odds") >= LEAST_ODDS))
    lexicon = choose(tuple(r) for r in telling.collect())
    bare = docs.sparkSession.sparkContext.broadcast(Model(lexicon, ()))
    harmless = _counted(teach, lambda: bare.value.neighbours).filter((F.col("c") >= EXCEPTION_DOCUMENTS) & (odds <= EXCEPTION_ODDS))
    learned = sorted(r["entry"] for r in harmless.select("entry").collect())
    model = Model(lexicon, tuple(dict.fromkeys([*exceptions, *learned])))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [sent.value.figures(fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b[0] for b in both], pa.float64()), pa.array([b[1] for b in both], pa.float64()), batch.column(1)], ["x", "y", "toxic"]
            )

    curve = texts.filter("for_curve").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "x double, y double, toxic int")
    rows = sorted(tuple(r) for r in curve.collect())
    if rows:
        # each class weighs as in all labelled rows, not as in the sample
        of = {k: max(1.0, counts.get(k, 0) / sample) for k in (0, 1)}
        model.curve = fit_curve([r[:2] for r in rows], [r[2] for r in rows], [of[r[2]] for r in rows])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """*docs* with toxic_score (0 to 1) of each whole text.

    Null and empty texts get the score of no entries.  Repeated rows are
    repeated; a column of that name is replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.lexicon, model.exceptions, model.curve))

    def make():
        return lambda texts: ([sent.value.score(t) for t in texts],)

    return append_columns(docs, ["text"], make, [field("toxic_score", T.DoubleType())])
