"""Audit of how sources of a language differ in the terms they use.

Terms are counted once over all texts.  Counts of kept terms are then put in
order by language and term over ranges, and each range is encoded with integer
dictionaries: a chunk holds a sorted array of kept terms, ids are places in it, and counts of a
group are a bincount over ids.  Ids keep the order of terms, so chunks become
dense vectors of all groups, and of equal values the smaller id comes first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import short_batches, staged

#: Documents of a language that a kept term is in, at least.
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Terms that a task counts before it passes them on, over all groups.
HELD_TERMS = 500_000
#: Terms of a chunk at most, and cells of its dense vectors.
CHUNK_TERMS, CHUNK_CELLS = 4096, 1 << 20
#: Shares of a group's best terms that are ranked apart.
SHARES = 32
#: Rows of one Arrow batch that a task gives.
ROWS = 50_000
#: Groups whose totals are sent to all tasks at once; more are joined.
SENT_GROUPS = 100_000

#: Bytes of UTF-8 that belong to no term become blanks, A-Z becomes a-z.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of batches of (text, lang, source), as far as a task holds them."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            found = list(n)
            for i in range(0, len(found), ROWS):
                some = found[i : i + ROWS]
                columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([n[t] for t in some], pa.int64()), pa.array([df[t] for t in some], pa.int64())], ["lang", "source", "term", "n", "df"]
                )

    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            found = terms(text)
            n.update(found)
            df.update(set(found))
            size += len(n)
            if size >= HELD_TERMS:
                yield from flush()
                held.clear()
                size = 0
    yield from flush()


def _encoded(width: int):
    """Chunks of *width* kept terms from rows (lang, term, source, n) in order.

    For each chunk a row with its terms, and one for each source that has some:
    ids and counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, lang = TaskContext.get().partitionId(), 0, None
        kept: list[str] = []
        rows: dict[str, tuple[list, list]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            order = np.array([t.encode() for t in kept], object)
            out: list[tuple] = [(lang, part, seq, None, kept, None, None)]
            for source, (found, n) in rows.items():
                ids = np.searchsorted(order, np.array(found, object))
                out.append((lang, part, seq, source, None, ids.tolist(), n))
            for i in range(0, len(out), 64):
                columns = zip(*out[i : i + 64], strict=True)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["lang", "part", "seq", "source", "terms", "ids", "counts"])

        for (of, term), group in groupby(_rows(batches), lambda r: r[:2]):
            if kept and (of != lang or len(kept) >= width):
                yield from flush()
                kept, rows, seq = [], {}, seq + 1
            lang = of
            kept.append(term)
            for _, _, source, n in group:
                ids, counts = rows.setdefault(source, ([], []))
                ids.append(term.encode())
                counts.append(n)
        if kept:
            yield from flush()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def shares(counts: np.ndarray, totals: np.ndarray, vocabulary: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * vocabulary)), exactly, also where the product needs more than 64 bits."""
    of = totals + 2 * vocabulary
    if counts.size and int(counts.max()) + 2 > np.iinfo(np.int64).max // SCALE:
        return (1 + SCALE * (counts.astype(object) + 2) // of.astype(object)).astype(np.int64)
    return 1 + SCALE * (counts + 2) // of


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so 64 bits suffice."""
    return (p - q) * (p - q) // (p + q)


def _compared(top: int):
    """(lang, source, part, item, value) of each chunk: parts of sums for pairs of sources, and a source's best terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, _, _), group in groupby(_rows(batches), lambda r: r[:3]):
            head = next(group)  # the row with the terms and the groups' totals
            terms_, groups, vocabulary = head[4] or [], head[7], head[8]
            place = {g["source"]: i for i, g in enumerate(groups)}
            totals = np.array([g["total"] for g in groups], np.int64)
            counts = np.zeros((len(groups), len(terms_)), np.int64)
            for row in group:
                ids, n = np.array(row[5], np.int64), np.array(row[6], np.int64)
                counts[place[row[3]]] = _summed(ids, n, len(terms_))
            yield from _chunk(lang, [g["source"] for g in groups], terms_, counts, totals, vocabulary, top)

    return run


def _summed(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Counts by id.  bincount adds as floats, so counts go in halves of 31 bits."""
    low = np.bincount(ids, n & 0x7FFFFFFF, size).astype(np.int64)
    return low + (np.bincount(ids, n >> 31, size).astype(np.int64) << 31)


def _chunk(lang, sources, terms_, counts, totals, vocabulary, top) -> Iterator[pa.RecordBatch]:
    p = shares(counts, totals[:, None], vocabulary) if counts.size else counts
    q = shares(counts.sum(axis=0), totals.sum(keepdims=True), vocabulary) if counts.size else counts.sum(axis=0)
    out: list[tuple] = []
    for i, source in enumerate(sources):
        sums = apart(p[i], p[i + 1 :]).sum(axis=1).tolist()
        for other, value in zip(sources[i + 1 :], sums, strict=True):
            out += (source, "pair", other, value), (other, "pair", source, value)
        ids = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        values = apart(p[i, ids], q[ids])
        best = np.lexsort((ids, -values))[:top]
        out += [(source, "term", terms_[ids[b]], int(values[b])) for b in best]
        if len(out) >= ROWS:
            yield _batch(lang, out)
            out = []
    if out:
        yield _batch(lang, out)


def _batch(lang: str, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *columns[:3], pc.cast(columns[3], pa.int64())], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) group differs from others of its language.

    Part ``pair`` has every other source of the language with the sum of
    ``apart`` over all kept terms; part ``term`` the *top* terms that the group
    uses more than its language does.  Null texts, langs and sources are empty
    ones.  Texts are read whole; repeated rows count again; of equal values the
    item that is less as UTF-8 comes first.  A language without kept terms has
    pairs of value 0, one of a single source has no pairs, and an empty table no
    rows.  Columns other than text, lang and source are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = staged(rows.select("lang", "source").distinct(), "groups")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    widest = sizes.agg(F.max("n")).first()[0] or 1
    width = max(1, min(CHUNK_TERMS, CHUNK_CELLS // widest))

    # one shuffle by (lang, term) serves the sums of sources and of languages; rare terms end there
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, df long").repartition("lang", "term")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    in_lang = F.sum("df").over(Window.partitionBy("lang", "term"))
    kept = staged(counted.withColumn("df", in_lang).filter(F.col("df") >= least).select("lang", "term", "source", "n"), "kept-counts")
    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    chunks = staged(ordered.mapInArrow(_encoded(width), "lang string, part int, seq int, source string, terms array<string>, ids array<int>, counts array<long>"), "chunks")

    of_groups = chunks.filter("source IS NOT NULL").groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("total"))
    vocabulary = chunks.groupBy("lang").agg(F.sum(F.when(F.col("terms").isNotNull(), F.size("terms")).otherwise(0)).alias("vocabulary"))
    totals = groups.join(of_groups, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    listed = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups")).join(vocabulary, "lang", "left")
    listed = staged(listed.select("lang", "groups", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary")), "totals")

    heads = chunks.filter("source IS NULL")
    bare = listed.filter("vocabulary = 0").select("lang", F.lit(-1).alias("part"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("source"))
    heads = heads.unionByName(bare, allowMissingColumns=True).join(F.broadcast(listed) if groups.count() <= SENT_GROUPS else listed, "lang")
    dealt = heads.unionByName(chunks.filter("source IS NOT NULL"), allowMissingColumns=True)
    dealt = dealt.repartition("lang", "part", "seq").sortWithinPartitions("lang", "part", "seq", F.col("source").asc_nulls_first())
    dealt = dealt.select("lang", "part", "seq", "source", "terms", "ids", "counts", "groups", "vocabulary")
    found = dealt.mapInArrow(_compared(top), "lang string, source string, part string, item string, value long")

    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", "part", *by).orderBy(F.desc("value"), "item"))
    best = (F.col("part") == "pair") | (F.col("rank") <= top)
    # a group's terms are ranked in shares first, so that those of many chunks do not meet in one task
    few = summed.withColumn("rank", rank(F.pmod(F.xxhash64("item"), F.lit(SHARES)))).filter(best)
    return few.withColumn("rank", rank()).filter(best)


#: The query on ``documents``, for DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), u AS (
  SELECT rid, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT rid) >= 10
), n AS (
  SELECT lang, source, term, count(*) AS c FROM u JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang
), t AS (
  SELECT g.lang, g.source, CAST(coalesce(sum(c), 0) AS HUGEINT) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY g.lang, g.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2) // (total + 2 * v) AS p
  FROM g JOIN kept k USING (lang) JOIN t USING (lang, source) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c) + 2) // (any_value(total) + 2 * any_value(v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), terms AS (
  SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(r AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
      FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
WHERE part = 'pair' OR r <= 10
"""
