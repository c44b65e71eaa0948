"""Links of documents by the Jaccard similarity of their word shingles, with prefix trees.

Most sets hold so many shingles of their own that they can be similar to no other,
and end there (``crowded``).  The rest put their shingles in one global order,
those of rarely met slots first.  Two similar sets share one of their first shingles, so sets meet at
those shingles (``_meetings``), and what meets is joined in blocks: the sets of
a block, from the shared shingle on, are a trie; others walk down it, share the
overlap of a common path, and leave a subtree that the shingles left on both
sides cannot make similar (``Tree``).

Results are components, so pairs that are connected already need no walk: first
every set is compared with the most met one at its shingles, which connects most
of a group of near copies, then only sets of different components meet.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import scratch, short_batches, staged
from quire.llm.minhash import _hashed, _joined, _sent, components, distinct, one_row_each

#: Intersection over union, in percent, from which sets are linked.
PERCENT = 80
#: Slots in which shingles are counted to order them.
SLOTS = 1 << 18
#: Sets of one trie, and sets that one task walks down it.
TREE_SETS, WALKS = 512, 4096
#: Shingles of a part of the slots in which single ones are found, and of a block of texts that asks for its own.
PART_SHINGLES, BLOCK_SHINGLES = 1 << 20, 1 << 20

_U = np.uint64


def words(text: str | None) -> list[bytes]:
    """Words between blanks and control blanks, A-Z in lower case; a null text has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct shingles, some hundred thousand words at a time."""
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        held.append(words(text))
        size += len(held[-1])
        if size >= 300_000:
            yield from map(distinct, _hashed(held))
            held, size = [], 0
    yield from map(distinct, _hashed(held))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(20)) % _U(SLOTS)


def ordered(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set in global order: by its slots' counts, then by hash."""
    return hashes[np.lexsort((hashes, counts[_slot(hashes)]))]


#: Buckets, at least, that a set's shingles are counted in: what two sets share is
#: at most the sum of the lesser counts.  Larger sets are not judged by that.
BUCKETS, JUDGED = 128, 4_000_000
#: Bytes of a hash that sets are compared by, the upper ones; slots and order need no others.
BYTES = 6


def _to_bytes(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()


def _from_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // BYTES, 8), np.uint8)
    wide[:, 8 - BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return wide.view("<u8").ravel()


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2) of each document.

    k1 and k2 are a digest of the set, null without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, k1, k2 = [], [], []
            for h in shingle_sets(batch.column(1).to_pylist()):
                a, b = struct.unpack("<qq", hashlib.blake2b(h.tobytes(), digest_size=16).digest()) if len(h) else (None, None)
                sizes.append(len(h))
                k1.append(a)
                k2.append(b)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long")


def _gaps(places: np.ndarray) -> bytes:
    """Ascending numbers below 2 ** 16 as differences, of 8 bits if all fit and else of 16."""
    gaps = np.diff(places, prepend=0)
    return gaps.astype(np.uint8 if len(gaps) and gaps.max() < 256 else "<u2").tobytes()


def _places(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else "<u2").cumsum(dtype=np.int64)


def crowded(docs: DataFrame, reps: DataFrame, shingles: int, percent: int) -> DataFrame:
    """(doc_id) of the sets in *reps* (doc_id), of so many *shingles* in all, but those that are surely similar to no other.

    A shingle alone in its slot is in no other set, and a set of which more than
    100 - *percent* percent are so is similar to none.  Slots are counted in
    parts, each about ``PART_SHINGLES`` shingles whatever the input: blocks of
    texts send three bytes and a place for each shingle to its part, and get the
    places of those back that are alone there.
    """
    spark = docs.sparkSession
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shingles / PART_SHINGLES))
    schema, names = "part int, block long, whole boolean, n int, places binary, data binary", ["part", "block", "whole", "n", "places", "data"]

    def block(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(h) for h in sets])
        h = np.concatenate(sets)
        part = ((h >> _U(32)) % _U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        part, place = part[order], np.repeat(np.arange(len(ids)), sizes)[order]
        slots = h.astype("<u8").view(np.uint8).reshape(-1, 8)[order, :3]
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(h) else np.zeros(0, np.int64)
        rows = [(ids[0] % parts, ids[0], True, len(ids), np.array(ids, "<i8").tobytes(), sizes.astype("<i4").tobytes())]
        rows += ((int(part[a]), ids[0], False, int(b - a), _gaps(place[a:b]), slots[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(h)], strict=True))
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, size = [], [], 0
        for batch in batches:
            for rep, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
                ids.append(rep)
                sets.append(h)
                size += len(h)
                if size >= BLOCK_SHINGLES or len(ids) >= 1 << 16:
                    yield block(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield block(ids, sets)

    def grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(rows, lambda r: r[key]):
            yield list(group)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(1 << 24, bool)
        for group in grouped(batches, 0):
            sent = [r for r in group if not r[2]]
            wide = np.zeros((sum(r[3] for r in sent), 4), np.uint8)
            wide[:, :3] = np.frombuffer(b"".join(r[5] for r in sent), np.uint8).reshape(-1, 3)
            slots = wide.view("<u4").ravel()
            ascending = np.sort(slots)
            twice = ascending[1:][ascending[1:] == ascending[:-1]]
            many[twice] = True
            one = ~many[slots]
            many[twice] = False
            out, at = [r for r in group if r[2]], 0
            for _, key, _, n, places, _ in sent:
                own = _places(places, n)[one[at : at + n]]
                out.append((None, key, False, len(own), _gaps(own), None))
                at += n
            kinds = ((1, pa.int64()), (2, pa.bool_()), (3, pa.int32()), (4, pa.binary()), (5, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in kinds], names[1:])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 0):
            (_, _, n, ids, sizes), *rest = group
            totals, single = np.frombuffer(sizes, "<i4").astype(np.int64), np.zeros(n, np.int64)
            for *_, m, places, _ in rest:
                single += np.bincount(_places(places, m), minlength=n)
            stays = (totals > 0) & (100 * (totals - single) >= percent * totals)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8")[stays])], ["doc_id"])

    sent = _texts(docs, reps).mapInArrow(send, schema).repartition("part").sortWithinPartitions("part")
    back = sent.mapInArrow(alone, schema.removeprefix("part int, ")).repartition("block").sortWithinPartitions("block", F.desc("whole"))
    return back.mapInArrow(judge, "doc_id long")


def slot_counts(docs: DataFrame, reps: DataFrame) -> np.ndarray:
    """How many of the sets' shingles fall into each slot, of the documents in *reps* (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for h in shingle_sets(batch.column(1).to_pylist()):
                np.add.at(seen, _slot(h).astype(np.int64), 1)
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(seen[hit])], ["slot", "n"])

    found = _texts(docs, reps).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def _prefixes(docs: DataFrame, reps: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(h, rep, total, rest, short) of the shingles that may be the first that two similar sets share.

    *rest* is the number of shingles from h on.  A set similar to another shares
    *percent* of its own shingles at least, and the smaller of the two
    2 * percent / (100 + percent), which *short* says.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
                total = len(h)
                rest = np.arange(total, 0, -1)
                n = int((100 * rest >= percent * total).sum())
                first, rest = ordered(h, sent.value)[:n], rest[:n]
                shared = sent.value[_slot(first)] > 1
                first, rest = first[shared], rest[shared]
                columns = [pa.array(first.view(np.int64)), pa.array(np.full(len(first), rep)), pa.array(np.full(len(first), total, np.int32))]
                short = (100 + percent) * rest >= 2 * percent * total
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rest.astype(np.int32)), pa.array(short)], ["h", "rep", "total", "rest", "short"])

    return _texts(docs, reps).mapInArrow(run, "h long, rep long, total int, rest int, short boolean")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in *wanted* (doc_id)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_sent(wanted, wanted.count()), "doc_id", "left_semi").select("doc_id", "text")


def outline(hashes: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each bucket, as 16 bits each; a bucket has four of them at most in the mean, up to 2 ** 16 buckets."""
    n = BUCKETS
    while 4 * n < len(hashes) and n < 1 << 16:
        n *= 2
    return np.bincount(((hashes >> _U(48)) % _U(n)).astype(np.int64), minlength=n).clip(0, 0xFFFF).astype("<u2").tobytes()


def _folded(outlines: np.ndarray, n: int) -> np.ndarray:
    """The outlines (rows) in *n* buckets, which divides theirs."""
    if outlines.shape[1] == n:
        return outlines
    return outlines.reshape(len(outlines), -1, n).sum(axis=1, dtype=np.int64).clip(0, 0xFFFF).astype("<u2")


def _sets(docs: DataFrame, wanted: DataFrame, counts: np.ndarray) -> DataFrame:
    """(rep, s, c): the sets of the documents in *wanted*, in global order, as bytes, and their outlines."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, outlines = [], []
            for h in shingle_sets(batch.column(1).to_pylist()):
                sets.append(_to_bytes(ordered(h, sent.value)))
                outlines.append(outline(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(outlines, pa.binary())], ["rep", "s", "c"])

    return _texts(docs, wanted).mapInArrow(run, "rep long, s binary, c binary")


def _meetings(rows: DataFrame) -> DataFrame:
    """The *rows* of ``_prefixes`` at shingles where similar sets may meet, with n, how many do.

    Of shingles at which the same sets meet only the first in the global order
    counts: it is the first that any two of them share.
    """
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short")).filter("n > 1 AND short").select("h", "n")
    met = staged(_joined(rows, staged(shared, "shared"), ["h"], rows.count()), "met")
    alike = met.groupBy("h").agg(
        F.first("n").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x2"), F.sum("rest").alias("rest")
    )
    first = alike.groupBy("n", "x1", "x2").agg(F.max_by("h", "rest").alias("h")).select("h", "n")
    return staged(_joined(met.drop("n"), staged(first, "first"), ["h"], met.count()), "meetings", keep=True)


class Tree:
    """A trie of sets of ascending numbers, one node for each run of them that no set leaves.

    A node knows the smallest set below it and how many numbers may still come.
    """

    def __init__(self, sets: list[np.ndarray], totals: list[int], labels: list[int]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        self.members = order
        self.nodes: list[tuple] = []
        sizes = np.array([len(sets[i]) for i in order])
        wholes = np.array([totals[i] for i in order])
        marks = np.array([labels[i] for i in order])
        common = np.array([0] + [_common(sets[a], sets[b]) for a, b in zip(order, order[1:], strict=False)])
        todo = [(0, len(order), 0, None)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(sizes[lo])
            done = lo + int((sizes[lo:hi] == end).sum())  # sets that end here come first
            uniform = int(marks[lo]) if (marks[lo:hi] == marks[lo]).all() else None
            children: list[int] = []
            self.nodes.append((sets[order[lo]][depth:end], lo, done, int(wholes[lo:hi].min()), int(sizes[lo:hi].max()) - end, uniform, children))
            if parent is not None:
                parent.append(len(self.nodes) - 1)
            starts = [done, *(np.flatnonzero(common[done + 1 : hi] == end) + done + 1).tolist()] if done < hi else []
            for a, b in zip(starts, [*starts[1:], hi], strict=False):
                todo.append((a, b, end, children))

    def walk(self, x: np.ndarray, total: int, percent: int, skip) -> Iterator[tuple[int, int]]:
        """(member, common shingles) of sets that may be similar to one of *total* shingles, of which *x* are known here.

        ``skip(label)`` says of a label whether sets of it are of no interest.
        """
        todo = [(0, 0, len(x))]
        while todo:
            node, shared, left = todo.pop()
            edge, lo, done, smallest, below, uniform, children = self.nodes[node]
            least = percent * (total + smallest)
            if (100 + percent) * (shared + min(left, len(edge) + below)) < least or uniform is not None and skip(uniform):
                continue
            if len(edge):
                at = np.searchsorted(x, edge)
                at[at == len(x)] = 0
                shared += int((x[at] == edge).sum()) if len(x) else 0
                left = len(x) - int(np.searchsorted(x, edge[-1], "right"))
            if (100 + percent) * (shared + min(left, below)) < least:
                continue
            for m in range(lo, done):
                yield self.members[m], shared
            todo += ((c, shared, left) for c in children)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    return int(unlike[0]) if len(unlike) else n


def _walked(counts, percent: int):
    """Links (a, b) from rows (group.., side, walks, rep, label, total, s) in order: the sets of a trie (side 0), then those that only walk down it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_rows(batches), lambda r: r[:4]):
            links = list(_links(group))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    def _rows(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def _links(group):
        held, tree, known = [], None, None
        above: dict[int, int] = {}

        def root(label: int) -> int:
            while (up := above.get(label, label)) != label:
                above[label] = label = above.get(up, up)
            return label

        def inner():
            for rep, label, total, h, walks in held:
                if walks:
                    yield from one(rep, label, total, h)

        def one(rep, label, total, h):
            for m, shared in tree.walk(known(h), total, percent, lambda other: root(other) == root(label)):
                y, other, size, *_ = held[m]
                if (100 + percent) * shared >= percent * (total + size) and root(other) != (own := root(label)):
                    above[root(other)] = own
                    yield rep, y

        for *_, side, walks, rep, label, total, s in group:
            h = _from_bytes(s)
            if side == 0:
                held.append((rep, label, total, h, walks))
                continue
            if tree is None and held:
                tree, known = _tree(held, counts.value)
                yield from inner()
            if tree is not None:
                yield from one(rep, label, total, h)
        if tree is None and held:
            tree, known = _tree(held, counts.value)
            yield from inner()

    return run


def _likely(percent: int):
    """(group.., rep) of the rows (group.., side, walks, rep, label, total, c) in order that some other row of the group may be similar to, by outlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for keys, group in groupby(rows, lambda r: r[:4]):
            found = list(_judged(group, percent))
            columns = [pa.array([k] * len(found), t) for k, t in zip(keys, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64())], ["g", "kind", "block", "part", "rep"])

    return run


def _judged(group: Iterator[tuple], percent: int) -> Iterator[int]:
    held, hit = [], None

    def meets(rep: int, label: int, total: int, c: np.ndarray) -> bool:
        shared = np.empty(len(totals), np.int64)
        for where, kinds in outlines:  # those with as many buckets each
            n = min(max(kinds), len(c))
            if n not in kinds:
                kinds[n] = _folded(kinds[max(kinds)], n)
            shared[where] = np.minimum(kinds[n], _folded(c[None, :], n)).sum(axis=1, dtype=np.int64)
        near = ((100 + percent) * shared >= percent * (totals + total)) | (np.maximum(totals, total) > JUDGED)
        near &= labels != label
        np.logical_or(hit, near, out=hit)
        return bool(near.any())

    for *_, side, walks, rep, label, total, c in group:
        row = rep, label, total, np.frombuffer(c, "<u2")
        if side == 0:
            held.append((*row, walks))
            continue
        if hit is None:
            if not held:
                return
            outlines, totals, labels, hit = _stacked(held)
        if meets(*row):
            yield rep
    if hit is None and held:
        outlines, totals, labels, hit = _stacked(held)
    own = [meets(*row) if walks else False for *row, walks in held]
    yield from (row[0] for row, a, b in zip(held, own, hit.tolist() if held else (), strict=True) if a or b)


def _stacked(held: list[tuple]) -> tuple:
    """(places, outlines by number of buckets) of the sets with as many buckets each; all sets' totals, labels, and room for marks."""
    sizes = np.array([len(row[3]) for row in held])
    outlines = [(at := np.flatnonzero(sizes == n), {int(n): np.array([held[i][3] for i in at])}) for n in np.unique(sizes)]
    return outlines, np.array([row[2] for row in held]), np.array([row[1] for row in held]), np.zeros(len(held), bool)


def _tree(held: list[tuple], counts: np.ndarray):
    """The trie of (rep, label, total, hashes, ..), and a function from hashes to the numbers that its sets know."""
    hashes = [x[3] for x in held]
    found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    rank = np.empty(len(found), np.int32)
    rank[np.lexsort((found, counts[_slot(found)]))] = np.arange(len(found), dtype=np.int32)
    numbers = np.split(rank[inverse], np.cumsum([len(h) for h in hashes])[:-1])

    def known(h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(found, h), len(found) - 1)
        return rank[at[found[at] == h]]

    return Tree(numbers, [x[2] for x in held], [x[1] for x in held]), known


def _join(trees: DataFrame, walks: DataFrame, sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Links (a, b) between sets of *trees* and of *walks* (g, kind, rep, label, total, pos) of one group (g, kind).

    A group's sets are cut into tries of TREE_SETS and its walks into parts of
    WALKS, and each part walks down each trie; *pos* is where a set begins.
    Sets go there only if their outlines leave it open that some are similar.
    """

    def size(df: DataFrame, of: str) -> DataFrame:
        found = df.groupBy("g", "kind").agg(
            F.count(F.lit(1)).alias(f"n_{of}"), F.min("label").alias(f"lo_{of}"), F.max("label").alias(f"hi_{of}"),
            F.bit_xor(F.xxhash64("rep")).alias(f"x_{of}"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias(f"y_{of}"), F.sum("pos").alias(f"pos_{of}"),
        )
        return found

    sizes = size(trees, "trees").join(size(walks, "walks"), ["g", "kind"])
    several = F.least("lo_trees", "lo_walks") < F.greatest("hi_trees", "hi_walks")
    # of groups with the same sets the one that begins first has them whole from what any two of them share
    alike = [f"{what}_{of}" for of in ("trees", "walks") for what in ("n", "x", "y")]
    first = sizes.filter(several).groupBy(*alike).agg(F.min_by(F.struct("g", "kind"), F.struct(F.col("pos_trees") + F.col("pos_walks"), "g", "kind")).alias("of"))
    grid = first.select("of.*", F.ceil(F.col("n_trees") / TREE_SETS).alias("blocks"), F.ceil(F.col("n_walks") / WALKS).alias("parts"), (F.col("n_trees") + F.col("n_walks")).alias("n"))
    grid = staged(grid, "grid")
    # salted, so that equal ids in several groups do not fall into the same places
    place = lambda of: F.pmod(F.xxhash64("rep", "g"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), (F.col(of) - 1).cast("int")))
    rest = ("rep", "label", "total", "pos")
    keys = ["g", "kind", "block", "part"]
    left = _joined(trees, grid, ["g", "kind"], trees.count()).select("g", "kind", place("blocks").alias("block"), every("parts").alias("part"), F.lit(0).alias("side"), *rest)
    right = _joined(walks, grid, ["g", "kind"], walks.count()).select("g", "kind", every("blocks").alias("block"), place("parts").alias("part"), F.lit(1).alias("side"), *rest)
    # a set that is in a trie and walks down it goes there once
    once = left.unionByName(right).groupBy(*keys, *rest).agg(F.min("side").alias("side"), (F.max("side") == 1).alias("walks"))
    places = staged(once, "places")
    outlined = _sent(places, places.count()).join(sets.select("rep", "c"), "rep").select(*keys, "side", "walks", "rep", "label", "total", "c")
    outlined = outlined.repartition(*keys).sortWithinPartitions(*keys, "side")
    likely = outlined.mapInArrow(_likely(percent), "g long, kind int, block int, part int, rep long")
    places = staged(places.join(staged(likely, "likely"), [*keys, "rep"], "left_semi"), "likely-places")
    dealt = _sent(places, places.count()).join(sets.drop("c"), "rep").select(*keys, "side", "walks", "rep", "label", "total", F.substring("s", BYTES * F.col("pos") + 1, F.lit(2**31 - 1)).alias("s"))
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "side")
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    return dealt.mapInArrow(_walked(sent, percent), "a long, b long")


def _labels(docs: DataFrame, reps: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(node, label) of the sets in *reps* (doc_id) that are linked with others."""
    with scratch(docs.sparkSession):
        met = _meetings(staged(_prefixes(docs, reps, counts, percent), "prefixes"))
    sets = staged(_sets(docs, staged(met.select(F.col("rep").alias("doc_id")).distinct(), "wanted"), counts), "sets")

    # every set with the most met one at each of its shingles
    central = met.groupBy("rep").agg(F.sum("n").alias("met"))
    ranked = met.join(central, "rep")
    head = F.max(F.struct("met", (-F.col("rep")).alias("r"), "total")).alias("p")
    heads = ranked.groupBy("h").agg(F.first("n").alias("n"), head).select("h", "n", (-F.col("p.r")).alias("pivot"), F.col("p.total").alias("pivot_total"))
    pairs = _joined(met.select("h", "rep", "total"), staged(heads, "heads"), ["h"], met.count())
    sizes_fit = F.least("total", "pivot_total") * 100 >= F.greatest("total", "pivot_total") * percent
    pairs = staged(pairs.filter((F.col("rep") != F.col("pivot")) & sizes_fit).select("rep", "total", "pivot", "pivot_total").distinct(), "pairs")
    start, kind = F.lit(0).alias("pos"), F.lit(0).alias("kind")
    trees = pairs.select(F.col("pivot").alias("g"), kind, "rep", F.col("rep").alias("label"), "total", start)
    walks = pairs.select("pivot", F.col("pivot_total").alias("total")).distinct().select(F.col("pivot").alias("g"), kind, F.col("pivot").alias("rep"), F.col("pivot").alias("label"), "total", start)
    found = staged(components(_join(trees, walks, sets, counts, percent)), "labels")

    # then sets of other components at the same shingle; two alone have met already
    named = met.filter("n > 2").join(found, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep"))
    named = staged(named.select("h", "rep", "label", "total", (F.col("total") - F.col("rest")).alias("pos"), "short"), "named")
    by_label = named.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short"))
    apart = by_label.groupBy("h").agg(F.max(F.struct("n", "label"))["label"].alias("major"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.max("short").alias("any"))
    apart = staged(apart.filter("labels > 1 AND any").select("h", "major", "n"), "apart")
    apart = staged(_joined(named, apart, ["h"], named.count()).withColumn("is_major", F.col("label") == F.col("major")), "apart-members")
    columns = (F.col("h").alias("g"), F.col("kind"), "rep", "label", "total", "pos")
    # sets whose sizes differ by more than the threshold do not meet: kinds are bands of sizes, two for each
    size = F.log("total") / max(math.log(100 / percent), 0.01)
    band = lambda of: F.floor(of).cast("int")
    bands = lambda lo, hi: F.sequence(band(lo - 1e-9), band(hi + 1e-9))
    # even: the smaller set of a pair, if not of the largest component there, meets all; odd: other sets meet that component's smaller ones
    even, odd = lambda b: 2 * b, lambda b: 2 * b + 1
    short_of_major = F.col("is_major") & F.col("short")
    trees = apart.withColumn("kind", F.explode(F.when(short_of_major, F.array(even(band(size)), odd(band(size)))).otherwise(F.array(even(band(size)))))).select(*columns)
    others = apart.filter("NOT is_major")
    walks = others.filter("short").withColumn("kind", F.explode(F.transform(bands(size, size + 1), even))).select(*columns)
    walks = walks.unionByName(others.withColumn("kind", F.explode(F.transform(bands(size - 1, size), odd))).select(*columns))
    links = staged(_join(trees, walks, sets, counts, percent), "links")
    return components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by *percent* of common shingles or more, and what they reach.

    A set is a text's distinct shingles of five words, or all words of a shorter
    text; shingles are told apart by 64-bit hashes, of which 48 bits are compared
    between texts.  A text without words (null,
    empty, blank) has an empty set and is linked with nothing.  Equal sets are
    one.  Of rows with the same doc_id one counts (``minhash.one_row_each``); a
    row with a null doc_id links nothing and has a null component.  Ids are
    integers; others are cast, which fails for those that are none.  Texts are
    whole, an empty table has no rows, columns other than doc_id and text are
    not read, except to choose among rows with the same doc_id.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = one_row_each(docs)
    marked = staged(described(docs), "described")
    with_id = marked.filter("doc_id IS NOT NULL AND k1 IS NOT NULL")
    distinct_sets = with_id.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("total"), F.count(F.lit(1)).alias("n"))
    texts = staged(distinct_sets, "distinct-sets")
    with scratch(spark):
        shingles = texts.agg(F.sum("total")).first()[0] or 0
        crowd = staged(crowded(docs, texts.select(F.col("rep").alias("doc_id")), shingles, percent), "crowded")
        labels = staged(_labels(docs, crowd, slot_counts(docs, crowd), percent), "components", keep=True)
    named = texts.join(labels, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("label", "rep").alias("component_id"))
    found = _joined(with_id, named, ["k1", "k2"], with_id.count()).select("doc_id", "n_shingles", "component_id")
    alone = marked.filter("doc_id IS NULL OR k1 IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


#: The query on ``documents``, for DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, generate_series(1, greatest(1, len(ws) - 4)) AS g(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), l AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reached) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""
