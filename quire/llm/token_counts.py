"""Token counts by a two-tier lookup on the map side.

A text's count is the sum over its pre-tokens, runs of blanks with what follows
them, because no piece of the vocabulary goes on past a blank.  Frequent
pre-tokens' counts come from a compact broadcast table; each worker encodes
what that lacks and keeps it in a bounded cache.  Nothing is shuffled by
pre-token.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import append_columns, field, of_worker, short_batches

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens of the broadcast table, and documents (about) that it is drawn
#: from.  The table decides only where a count is looked up, never the count.
TABLE_ENTRIES = 50_000
TABLE_DOCUMENTS = 4_000
#: Entries of a worker's cache of other pre-tokens; a full cache is emptied.
CACHE_ENTRIES = 400_000

_BLANK = "▁"
_RUNS = re.compile(f"{_BLANK}+[^{_BLANK}]+|{_BLANK}+").findall


class PieceCounter:
    """``count(text)`` is the length of the library's encoding."""

    def __init__(self, name: str, packed: bytes = b""):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        #: Whether texts may be cut before runs of blanks.
        self.cuttable = (
            not any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces)
            and _BLANK in pieces
            and all(self.library.decode(self.library.encode(t)) == t for t in (" a  b ", "\ufb01\u3000\t\u00b2 x"))
            and self.library.encode("a", out_type=str)[0] == f"{_BLANK}a"
        )
        self.frequent = unpack(packed)
        self.cache = _Cache(self)
        self.lookup = self.cache.__getitem__

    def one(self, word: str) -> int:
        """Ids of a pre-token of one blank and *word*."""
        return len(self.library.encode(word)) if word else 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuttable or "\x00" in text:
            return len(self.library.encode(text))
        words = text.split(" ")
        if "" in words or _BLANK in text:
            # The library sets a blank before the text; a pre-token's own first blank stands for it.
            runs = _RUNS(_BLANK + text.replace(" ", _BLANK))
            return sum(self.lookup(run[1:]) for run in runs)
        return sum(map(self.lookup, words))


class _Cache(dict):
    def __init__(self, counter: PieceCounter):
        self.counter = counter
        self.update(counter.frequent)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES + len(self.counter.frequent):
            self.clear()
            self.update(self.counter.frequent)
        n = self[word] = self.counter.one(word)
        return n


def pack(counts: dict[str, int]) -> bytes:
    """A table of counts under 256 of words without blanks, as compressed bytes."""
    kept = {w: n for w, n in counts.items() if n < 256 and " " not in w}
    words = " ".join(kept).encode("utf-8", "surrogatepass")
    return zlib.compress(struct.pack("<I", len(kept)) + bytes(kept.values()) + words)


def unpack(packed: bytes) -> dict[str, int]:
    if not packed:
        return {}
    data = zlib.decompress(packed)
    (n,) = struct.unpack_from("<I", data)
    words = data[4 + n :].decode("utf-8", "surrogatepass").split(" ") if n else []
    return dict(zip(words, data[4 : 4 + n], strict=True))


def frequent_table(docs: DataFrame, model: str = MODEL, entries: int = TABLE_ENTRIES, documents: int = TABLE_DOCUMENTS) -> bytes:
    """The packed table of the commonest pre-tokens of about *documents* documents.

    Tasks count the words of their share of a sample drawn by a hash of doc_id,
    and the driver merges one bounded row from each.
    """
    spark = docs.sparkSession
    short_batches(spark)
    every = max(1, docs.count() // documents)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.split(" ") if text else ())
        if seen:
            common = {w: min(n, 2**31) for w, n in seen.most_common(entries)}
            yield pa.RecordBatch.from_pydict({"counts": [json.dumps(common).encode()]}, schema=pa.schema([("counts", pa.binary())]))

    total: Counter = Counter()
    for row in sample.mapInArrow(run, "counts binary").toLocalIterator():
        total.update(json.loads(row["counts"]))
    counter = PieceCounter(model)
    words = sorted(total, key=lambda w: (-total[w], w))[:entries]
    return pack({w: counter.one(w) for w in words if w and _BLANK not in w and "\x00" not in w}) if counter.cuttable else b""


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """*docs* with n_bytes, n_tokens and over_limit of each whole text.

    A null or empty text has 0 of both.  Repeated rows are repeated; columns of
    *docs* with those names are replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, model))

    def make():
        counter = _worker_counter(model, sent)

        def compute(texts):
            counts = [counter.count(t) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            return sizes, counts, [n > limit for n in counts]

        return compute

    fields = [field("n_bytes", T.LongType()), field("n_tokens", T.LongType()), field("over_limit", T.BooleanType())]
    return append_columns(docs, ["text"], make, fields)


def _worker_counter(model: str, sent) -> PieceCounter:
    """This process's counter for a table; its cache outlives tasks."""
    return of_worker(("pieces", model, zlib.crc32(sent.value)), lambda: PieceCounter(model, sent.value))
