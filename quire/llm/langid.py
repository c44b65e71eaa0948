"""Language identification by unigrams over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary,
learned by expectation-maximisation.  A word's probability is the sum over all
its segmentations into pieces, by a forward pass; a text's is the product over
its words.  Words' scores are kept in worker caches.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import append_columns, field, give_back, keeping_columns, of_worker, short_batches

MODEL = "piece_bpe_32k.model"
UNDETERMINED = "und"
#: Bound of the fit: documents of a language (about, by a hash of doc_id).
SAMPLE_DOCUMENTS = 3_000
ROUNDS = 6
#: Places of words (letters and ends, the longest word's for each) that one
#: pass holds; a longer word has a pass of its own.
PASS_PLACES = 60_000
#: Added to each piece's expected count.
SMOOTHING = 0.05
#: Probability of a letter that is no piece, alike in all languages.
UNKNOWN = 1e-9
CACHE_ENTRIES = 150_000
#: More than any code point.
LETTERS = 0x110000

_LETTERS = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    """Runs of letters of the composed, lower-cased text."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    found = _LETTERS(text.lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


def vocabulary(name: str = MODEL) -> dict[str, int]:
    """Numbers of the vocabulary's pieces that can be part of a word (▁ begins one)."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = (library.id_to_piece(i) for i in range(library.vocab_size()) if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i)))
    kept = sorted({p for p in pieces if p and (p == "▁" or all(c.isalpha() for c in p.removeprefix("▁")))})
    return {p: i for i, p in enumerate(kept)}


class Beginnings(dict):
    """Every beginning of a piece; its number if it is a piece, else -1."""

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beginnings as nodes, the empty one as 0: ascending node * LETTERS + letter, the nodes that these lead to, and each node's piece."""
        node = {"": 0} | {b: i for i, b in enumerate(self, 1)}
        step = np.array([node[b[:-1]] * LETTERS + ord(b[-1]) for b in self], np.int64)
        order = np.argsort(step)
        return step[order], order + 1, np.array([-1, *self.values()], np.int64)


def beginnings(pieces: dict[str, int]) -> Beginnings:
    known = {p[:n]: -1 for p in pieces for n in range(1, len(p))}
    return Beginnings(known | pieces)


class Lattice:
    """The pieces at each place of some words, as arrays for passes over all words at once.

    An arc is (word, begin, end, piece), where piece -1 is an unknown letter.
    Arcs are grouped by end and length, so that no group has a word twice.
    Sums are kept as logarithms, so words may be of any length.
    """

    def __init__(self, found: Sequence[str], known: Beginnings):
        self.n = len(found)
        self.lengths = np.array([len(w) + 1 for w in found], np.int64)
        self.size = int(self.lengths.max()) + 1 if self.n else 1
        letters = np.frombuffer("".join(["▁" + w for w in found]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(self.n), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        left = (starts + self.lengths)[word] - np.arange(len(letters))
        steps, to, pieces = known.steps
        # all places at once, a letter further each time, as far as there are beginnings of pieces
        at, node, length = np.arange(len(letters)), np.zeros(len(letters), np.int64), 0
        arcs = []
        while len(at):
            key = node * LETTERS + letters[at + length]
            i = np.minimum(np.searchsorted(steps, key), len(steps) - 1) if len(steps) else np.zeros(len(at), np.int64)
            here = steps[i] == key if len(steps) else np.zeros(len(at), bool)
            length += 1
            goes = at[here]
            node = to[i[here]] if len(steps) else node[:0]
            piece = pieces[node]
            if length == 1:
                alone = np.ones(len(letters), bool)
                alone[goes[piece >= 0]] = False
                arcs.append((np.flatnonzero(alone), 1, np.full(int(alone.sum()), -1)))
            arcs.append((goes[piece >= 0], length, piece[piece >= 0]))
            more = left[goes] > length
            at, node = goes[more], node[more]
        begins = np.concatenate([a for a, _, _ in arcs]) if arcs else np.zeros(0, np.int64)
        spans = np.concatenate([np.full(len(a), n) for a, n, _ in arcs]) if arcs else np.zeros(0, np.int64)
        piece = np.concatenate([p for _, _, p in arcs]) if arcs else np.zeros(0, np.int64)
        word = word[begins]
        begin = begins - starts[word]
        group = (begin + spans) * self.size + spans
        order = np.lexsort((word, group))
        self.word, self.begin, self.end, self.piece = word[order], begin[order], (begin + spans)[order], piece[order]
        self.bounds = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Logarithm of the summed probability of all segmentations up to each place: [place, word, language].

        logs: of the probabilities by piece and language, the last row for unknown letters.
        """
        alpha = np.full((self.size, self.n, logs.shape[1]), -np.inf)
        alpha[0] = 0.0
        for a, b in zip(self.bounds, self.bounds[1:], strict=False):
            w, end = self.word[a:b], self.end[a]
            alpha[end, w] = np.logaddexp(alpha[end, w], alpha[self.begin[a], w] + logs[self.piece[a:b]])
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.lengths, np.arange(self.n)]

    def expected(self, probabilities: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of words with such counts."""
        logs = np.log(np.append(probabilities, UNKNOWN))
        alpha = self.forward(logs[:, None])
        total, alpha = self.totals(alpha)[:, 0], alpha[:, :, 0]
        beta = np.full((self.size, self.n), -np.inf)
        beta[self.lengths, np.arange(self.n)] = 0.0
        # groups from the last end back: all that leaves an end is done before what leads to it
        for a, b in zip(self.bounds[-2::-1], self.bounds[:0:-1], strict=True):
            w, begin = self.word[a:b], self.begin[a]
            beta[begin, w] = np.logaddexp(beta[begin, w], logs[self.piece[a:b]] + beta[self.end[a], w])
        known = self.piece >= 0
        w, p = self.word[known], self.piece[known]
        share = np.exp(alpha[self.begin[known], w] + logs[p] + beta[self.end[known], w] - total[w])
        return np.bincount(p, share * counts[w], minlength=len(probabilities))


def passes(found: Sequence[str]) -> Iterator[list[int]]:
    """Places of *found*, from short to long words, in lists that a pass holds."""
    some: list[int] = []
    for i in sorted(range(len(found)), key=lambda i: len(found[i])):
        if some and (len(some) + 1) * (len(found[i]) + 2) > PASS_PLACES:
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def fit_pieces(counts: dict[str, int], pieces: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its words' counts, by expectation-maximisation."""
    found, known = sorted(counts), beginnings(pieces)
    parts = []
    for some in passes(found):
        words_here = [found[i] for i in some]
        parts.append((Lattice(words_here, known), np.array([counts[w] for w in words_here], float)))
    p = np.full(len(pieces), 1 / max(1, len(pieces)))
    for _ in range(rounds):
        expected = sum((lattice.expected(p, weight) for lattice, weight in parts), np.full(len(pieces), SMOOTHING))
        p = expected / expected.sum()
    return p


@dataclass
class Model:
    """Languages and, by piece, each language's probabilities."""

    languages: list[str]
    pieces: dict[str, int]
    table: np.ndarray


class Scorer:
    """Log-likelihoods of words by language, with a bounded cache."""

    def __init__(self, model: Model):
        self.model = model
        self.logs = np.log(np.vstack([model.table, np.full((1, len(model.languages)), UNKNOWN)]))
        self.known = beginnings(model.pieces)
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.languages)))

    def learn(self, texts: Sequence[Sequence[str]]) -> None:
        """See to it that the cache has all words of some texts."""
        new = list({w for t in texts for w in t if w not in self.place})
        if len(self.place) + len(new) > CACHE_ENTRIES:
            self.place.clear()
            new = list({w for t in texts for w in t})
        for some in passes(new):
            self._add([new[i] for i in some])

    def _add(self, new: list[str]) -> None:
        lattice = Lattice(new, self.known)
        values = lattice.totals(lattice.forward(self.logs))
        start = len(self.place)
        while start + len(new) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[start : start + len(new)] = values
        self.place.update(zip(new, range(start, start + len(new)), strict=True))

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """(language, its posterior probability) of each text."""
        split = [words(t) for t in texts]
        langs, scores = [], []
        if not self.model.languages:
            return [UNDETERMINED] * len(split), [0.0] * len(split)
        for at in range(0, len(split), 64):
            some = split[at : at + 64]
            self.learn(some)
            for found in some:
                if not found:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = self.rows[np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))].sum(0)
                best = int(total.argmax())
                langs.append(self.model.languages[best])
                scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
        return langs, scores


def learn(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, name: str = MODEL) -> Model:
    """Fit each language of *docs* (doc_id, text, lang) that the caller lets it see.

    Rows with a null text or lang teach nothing; a language whose texts have no
    letters is not learned.  At most about *documents* documents of a language
    are read; words are counted there, and the driver fits their counts.
    """
    spark = docs.sparkSession
    short_batches(spark)
    usable = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = sizes.select(F.col("lang").alias("of_lang"), F.least(F.lit(1.0), documents / F.col("n")).alias("share"))
    drawn = usable.select("doc_id", "text", "lang").join(F.broadcast(share), F.col("lang") == F.col("of_lang"))
    sample = drawn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
        for lang, counted in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["lang", "word", "n"]
            )

    counted = sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_lang: dict[str, dict[str, int]] = {}
    for lang, word, n in counted.toLocalIterator():
        by_lang.setdefault(lang, {})[word] = n
    pieces, languages = vocabulary(name), sorted(by_lang)
    table = np.column_stack([fit_pieces(by_lang[k], pieces) for k in languages]) if languages else np.zeros((len(pieces), 0))
    # what words and lattices took would else stay with the driver through all that follows
    by_lang.clear()
    give_back()
    return Model(languages, pieces, table)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """*docs* with lang_pred and lang_score, the posterior of equally likely languages.

    A null text or one without letters is ``und`` with score 0; texts are read
    whole.  Repeated rows are repeated; columns with those names are replaced;
    an empty table gives no rows.
    """
    import uuid

    sent, key = docs.sparkSession.sparkContext.broadcast(model), ("langid", uuid.uuid4().hex)

    def make():
        return of_worker(key, lambda: Scorer(sent.value)).predict

    return append_columns(docs, ["text"], make, [field("lang_pred", T.StringType()), field("lang_score", T.DoubleType())])


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents of a determined language whose score is *least* or more, with their columns; lang, if it is one, becomes that found."""

    def chosen(rows: DataFrame) -> DataFrame:
        found = identify(rows, model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= least))
        return found.withColumn("lang", F.col("lang_pred"))

    return keeping_columns(docs, ("lang_pred", "lang_score"), chosen)
