"""Merkle manifest of a dataset, and proofs that single documents belong to it.

A document's leaf is the digest of its fields.  The leaves of a source, by
doc_id, are hashed three by three to the source's root, and the sources' roots
likewise to the dataset's.  For each parent the manifest stores its preimage,
the concatenated digests of its children.  A leaf joins the preimages of its
ancestors: without its own 64 characters they are the siblings of the proof, and
with another digest in that place they fold to the root that this one leads to.

A tree is cut into blocks of BLOCK consecutive nodes, five levels each, whose
roots are the next tier's nodes.  So a large source is many small groups, a
tier has 1 / BLOCK of the rows of the one below, and preimages that stand above
many leaves are joined once for each block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import staged

FAN_OUT = 3
LEVELS = 5
#: Nodes of one block.
BLOCK = FAN_OUT**LEVELS
#: Characters of a digest.
WIDTH = 64
#: The tree over the sources' roots; those of sources begin with 0 (null) or 1.
TOP = ""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<slot: int, preimage: string>"


def leaf(values: Sequence[Column]) -> Column:
    """Digest of *values*: each its UTF-8 byte count, a colon and the value as text, or ``-`` for null."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _tree(source: Column) -> Column:
    """A source's tree: names keep the order of sources, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """*nodes* with pos, from 0, in their *tree* by *order*, and the total of the tree.

    Ranges of (tree, order) are sorted apart and each is shifted by the tree's
    rows in the ranges before it, so a large tree is no single task.
    """
    keys = ["tree", *order]
    dealt = staged(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "ordered")
    runs = dealt.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__n"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("__n").over(of_tree.orderBy("__part")) - F.col("__n")
    runs = runs.select("tree", "__part", before.alias("__before"), F.sum("__n").over(of_tree).alias("total"))
    inside = F.row_number().over(Window.partitionBy("tree", "__part").orderBy(*order)) - 1
    return dealt.withColumn("__inside", inside).join(runs, ["tree", "__part"]).select(*nodes.columns, (F.col("__inside") + F.col("__before")).alias("pos"), "total")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, total, p1 .. p5, digest) of nodes (tree, pos, total, digest).

    p1 to p5 are the preimages of the block's parents by level.  A tree of one
    block ends where one node is left; other blocks have all levels.
    """
    numbered = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    held = F.array_sort(F.collect_list(F.struct("pos", "digest")))
    out = numbered.groupBy("tree", "block", "total").agg(held.alias("h"))
    out = out.withColumn("h", F.transform("h", lambda x: x["digest"]))
    for k in range(1, LEVELS + 1):
        ends = (F.col("total") <= BLOCK) & (F.size("h") == 1)
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("h") - 1) / FAN_OUT)), lambda j: F.array_join(F.slice("h", j * FAN_OUT + 1, FAN_OUT), ""))
        out = out.withColumn(f"p{k}", F.when(ends, F.array().cast("array<string>")).otherwise(runs))
        out = out.withColumn("h", F.when(ends, F.col("h")).otherwise(F.transform(f"p{k}", lambda p: F.sha2(p, 256))))
    return out.select("tree", "block", "total", *(f"p{k}" for k in range(1, LEVELS + 1)), F.col("h")[0].alias("digest"))


def _steps(pos: Column) -> Column:
    """The path of a node of a joined block through that block: its slot in each ancestor, and the ancestor's preimage."""
    found = []
    for k in range(1, LEVELS + 1):
        within = pos % BLOCK
        preimage = F.get(F.col(f"p{k}"), F.floor(within / FAN_OUT**k).cast("int"))
        slot = (F.floor(within / FAN_OUT ** (k - 1)) % FAN_OUT).cast("int")
        step = F.array(F.struct(slot.alias("slot"), preimage.alias("preimage"))).cast(f"array<{_STEP}>")
        found.append(F.when(preimage.isNotNull(), step).otherwise(F.array().cast(f"array<{_STEP}>")))
    return F.concat(*found)


@dataclass
class Forest:
    """Trees over placed nodes: ``tiers`` of blocks, lowest first, and each tree's ``roots`` (tree, digest)."""

    tiers: list[DataFrame]
    roots: DataFrame

    def paths(self, nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
        """*nodes* with path: the steps up to the root of their tree, then those of *above* (tree, path)."""
        upper = None
        for n in range(len(self.tiers) - 1, -1, -1):
            blocks = self.tiers[n]
            finished = blocks.filter(F.col("total") <= BLOCK)
            if above is not None:
                ended = finished.join(above.select("tree", F.col("path").alias("rest")), "tree")
            else:
                ended = finished.withColumn("rest", F.array().cast(f"array<{_STEP}>"))
            if upper is not None:
                ended = ended.unionByName(blocks.join(upper, ["tree", "block"]))
            if n == 0:
                held = ended
            else:
                # the blocks below are this tier's nodes
                below = self.tiers[n - 1].filter(F.col("total") > BLOCK).select("tree", F.col("block").alias("pos"))
                found = below.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(ended, ["tree", "block"])
                upper = found.select("tree", F.col("pos").alias("block"), F.concat(_steps(F.col("pos")), "rest").alias("rest"))
        found = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(held.drop("total", "digest"), ["tree", "block"])
        return found.select(*nodes.columns, F.concat(_steps(F.col("pos")), "rest").alias("path"))


def grown(nodes: DataFrame) -> Forest:
    """The trees over *nodes* (tree, pos, total, digest), tier by tier until every tree has its root."""
    tiers, roots = [], None
    nodes = nodes.select("tree", "pos", "total", "digest")
    while True:
        tiers.append(staged(_blocks(nodes), "merkle-blocks"))
        done = tiers[-1].filter(F.col("total") <= BLOCK).select("tree", "digest")
        roots = done if roots is None else roots.union(done)
        rest = tiers[-1].filter(F.col("total") > BLOCK)
        if rest.isEmpty():
            return Forest(tiers, roots)
        nodes = rest.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), "digest")


@dataclass
class Manifest:
    """``leaves`` (doc_id, leaf, other columns, tree, pos, total), the sources' trees, the tree over them, and its root."""

    leaves: DataFrame
    sources: Forest
    subroots: DataFrame
    top: Forest
    root: str | None


def build(leaves: DataFrame) -> Manifest:
    """The manifest of *leaves* (doc_id, source, leaf, and columns to keep).

    A null source is a source of its own, before all others; a null doc_id comes
    before all others, and rows of one doc_id go by their leaf, so that repeated
    rows, alike in all fields, are leaves side by side.  No rows have no root.
    """
    nodes = leaves.withColumn("tree", _tree(F.col("source"))).withColumn("digest", F.col("leaf"))
    leaves = staged(placed(nodes, ["doc_id", "leaf"]), "merkle-leaves")
    sources = grown(leaves)
    named = sources.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
    subroots = staged(placed(named, ["name"]), "merkle-subroots")
    top = grown(subroots)
    found = top.roots.first()
    return Manifest(leaves.drop("digest"), sources, subroots, top, found["digest"] if found else None)


def proofs(m: Manifest) -> DataFrame:
    """The manifest's leaves with subroot, root and path: (slot, preimage) of each ancestor up to the root."""
    ways = staged(m.top.paths(m.subroots).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")), "merkle-ways")
    found = m.sources.paths(m.leaves, ways).join(ways.select("tree", "subroot"), "tree")
    return found.drop("tree", "pos", "total").withColumn("root", F.lit(m.root).cast("string"))


def siblings(path: Column | str) -> Column:
    """The proof: the siblings' digests from the leaf's level to the root's, left to right, as one text."""
    cut = lambda s: F.concat(_left(s), _right(s))
    return F.array_join(F.transform(path, cut), "")


def folded(start: Column | str, path: Column | str) -> Column:
    """The root to which the leaf *start* leads, put in its place among the siblings of *path*."""
    first = F.col(start) if isinstance(start, str) else start
    return F.aggregate(path, first, lambda h, s: F.sha2(F.concat(_left(s), h, _right(s)), 256))


def _left(step: Column) -> Column:
    return F.substring(step["preimage"], F.lit(1), step["slot"] * WIDTH)


def _right(step: Column) -> Column:
    return F.substring(step["preimage"], (step["slot"] + 1) * WIDTH + 1, F.lit(FAN_OUT * WIDTH))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without line ends in every second document by the crc32 of its doc_id; others, and those without a doc_id, stay."""
    hit = F.crc32(doc_id.cast("string")) % 2 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def audit(docs: DataFrame) -> DataFrame:
    """Per row of *docs*: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is that of *docs*; what is folded is the leaf of the
    ``tampered`` text.  Nulls are fields of their own kind, an empty text is one
    of no bytes, texts are hashed whole however long, repeated rows are leaves
    of their own, an empty table has no rows, and columns other than FIELDS are
    not read.
    """
    fields = [F.col(f"`{c}`") for c in FIELDS]
    changed = [*fields[:-1], tampered(F.col("doc_id"), F.col("text"))]
    # staged, as texts would else be read again to find the ranges in which leaves are put in order
    leaves = staged(docs.select("doc_id", "source", leaf(fields).alias("leaf"), leaf(changed).alias("found")), "merkle-digests")
    m = build(leaves)
    rows = proofs(m).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), folded("found", "path").alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a decimal number in SQL: each digit is taken in, then eight bits are shifted out.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
          lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""

#: The query on ``documents``, for DuckDB: lists of each level, then folds.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, source IS NOT NULL AS named, crc32_even, head || coalesce(strlen(text) || ':' || text, '-') AS original,
         head || coalesce(strlen(t2) || ':' || t2, '-') AS changed
  FROM (SELECT *, CASE WHEN crc32_even THEN replace(text, chr(10), '') ELSE text END AS t2,
               coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
        FROM (SELECT *, coalesce({crc} % 2 = 0, false) AS crc32_even FROM documents))
), l AS (
  SELECT rid, doc_id, named, coalesce(source, '') AS source, sha256(original) AS leaf, sha256(changed) AS found FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY named, source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), t AS (
  SELECT named, source, 0 AS k, list(leaf ORDER BY pos) AS hs FROM p GROUP BY named, source
  UNION ALL
  SELECT named, source, k + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], ''))) FROM t WHERE len(hs) > 1
), s AS (
  SELECT named, source, hs[1] AS subroot, row_number() OVER (ORDER BY named, source) - 1 AS spos FROM t WHERE len(hs) = 1
), u AS (
  SELECT 0 AS k, list(subroot ORDER BY spos) AS hs FROM s
  UNION ALL
  SELECT k + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], ''))) FROM u WHERE len(hs) > 1
), f AS (
  SELECT rid, named, source, pos AS spot, 0 AS k, found AS h, '' AS proof FROM p
  UNION ALL
  SELECT rid, f.named, f.source, spot // 3, f.k + 1,
         sha256(array_to_string(list_concat(list_concat(hs[spot - spot % 3 + 1:spot], [h]), hs[spot + 2:spot - spot % 3 + 3]), '')),
         proof || array_to_string(list_concat(hs[spot - spot % 3 + 1:spot], hs[spot + 2:spot - spot % 3 + 3]), '')
  FROM f JOIN t ON f.named = t.named AND f.source = t.source AND f.k = t.k AND len(hs) > 1
), g AS (
  SELECT rid, spos AS spot, 0 AS k, h, proof FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k DESC) AS r FROM f) JOIN s USING (named, source) WHERE r = 1
  UNION ALL
  SELECT rid, spot // 3, g.k + 1,
         sha256(array_to_string(list_concat(list_concat(hs[spot - spot % 3 + 1:spot], [h]), hs[spot + 2:spot - spot % 3 + 3]), '')),
         proof || array_to_string(list_concat(hs[spot - spot % 3 + 1:spot], hs[spot + 2:spot - spot % 3 + 3]), '')
  FROM g JOIN u ON g.k = u.k AND len(hs) > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k DESC) AS r FROM g) JOIN p USING (rid) JOIN s USING (named, source),
     (SELECT hs[1] AS root FROM u WHERE len(hs) = 1)
WHERE r = 1
""".replace("{crc}", _CRC)
