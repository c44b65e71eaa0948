"""Cosine search, threshold clusters and cluster reports over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import metric
from quire.operators.numbering import dense_ids
from quire.staging import staged

#: Query vectors of one product.
BLOCK = 1000
#: Query vectors that are sent to all tasks at once.
HELD_QUERIES = 20_000


def cosine(vector: Column | str, query: list[float]) -> Column:
    """Cosine with a fixed vector, without leaving the JVM."""
    q = np.asarray(query, float)
    v = F.col(vector) if isinstance(vector, str) else vector
    dot = F.aggregate(F.zip_with(v, F.array(*(F.lit(float(x)) for x in q)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, dot / (norm * float(np.linalg.norm(q)))).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float], k: int = 5, label: str | None = None, id_col: str = "vec_id") -> DataFrame:
    """The *k* vectors most like the query, of one label if given; the query itself is never stored."""
    some = vectors if label is None else vectors.filter(F.col("label") == label)
    return some.withColumn("score", cosine("embedding", query)).orderBy(F.desc("score"), id_col).limit(k)


def region_label(regions: list[tuple[str, list[float]]], wanted: str | None) -> tuple[str, list[float]] | None:
    """The first region with the wanted label, else the first one."""
    return next((r for r in regions if r[0] == wanted), regions[0] if regions else None)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 5, label: str | None = None, id_col: str = "vec_id", held: int = HELD_QUERIES) -> DataFrame:
    """query, *id_col*, score: the *k* vectors most like each query vector (of one label if given).

    Queries go to the vectors in blocks of about *held*.  A task multiplies
    batches of vectors with parts of a block and keeps each query's best, so k
    rows for a query and task are shuffled.
    """
    spark = vectors.sparkSession
    some = vectors if label is None else vectors.filter(F.col("label") == label)
    rows = some.select(F.col(id_col).cast("long").alias(id_col), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-asked.count() // held))
    found = None
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).collect()
        sent = spark.sparkContext.broadcast((np.array([r["query"] for r in block], np.int64), _exact_unit([r["embedding"] for r in block])))
        best = rows.mapInArrow(_best_of_task(sent, id_col, k), f"query long, `{id_col}` long, score double")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("query").orderBy(F.desc("score"), id_col)
    return found.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")


def _best_of_task(sent, id_col: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, matrix = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * -(-len(asked) // BLOCK)
        for batch in batches:
            ids, unit = batch.column(0).to_numpy(), _exact_unit(batch.column(1).to_pylist())
            for part in range(len(best)):
                at = part * BLOCK
                score = matrix[at : at + BLOCK] @ unit.T if len(unit) else np.zeros((0, 0))
                if score.shape[1] > k:  # the k-th best of the batch, and ties with it
                    i, j = np.nonzero(score >= np.partition(score, -k, axis=1)[:, -k, None])
                else:
                    i, j = np.indices(score.shape).reshape(2, -1)
                q, v, s = (np.concatenate(x) for x in zip(best[part], (i + at, ids[j], score[i, j]), strict=True))
                order = np.lexsort((v, -s, q))
                q, v, s = q[order], v[order], s[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                best[part] = q[rank < k], v[rank < k], s[rank < k]
        for q, v, s in best:
            yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(v), pa.array(s)], ["query", id_col, "score"])

    return run


def _exact_unit(lists: list) -> np.ndarray:
    """Rows of length 1; those of zeros stay."""
    if not lists:
        return np.zeros((0, 0))
    m = np.array(lists, float).reshape(len(lists), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def search(collections: dict[int, DataFrame], stage: int, query: list[float] | DataFrame, top: int = 5, label: str | None = None) -> DataFrame | None:
    """Search of a stage's collection for one vector or a frame of them; stage 3 by label with ten hits.

    An unknown stage has no hits, which is None where there is no collection at all.
    """
    if not collections:
        return None
    known = collections.get(stage, next(iter(collections.values())).limit(0))
    k, of = (10, label) if stage == 3 else (top, None)
    return top_k_each(known, query, k, of) if isinstance(query, DataFrame) else top_k(known, query, k, of)


def first_per_document(vectors: DataFrame, doc: str = "doc_id", order: str = "id") -> DataFrame:
    """Of several vectors of a document the one inserted first."""
    first = vectors.groupBy(doc).agg(F.min_by(F.struct(*[c for c in vectors.columns if c != doc]), order).alias("__v"))
    return first.select(doc, "__v.*").select(*vectors.columns)


def similar_classes(vectors: DataFrame, threshold: float, id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(a, b, score) of all pairs of different vectors over *threshold*, by their least ids, and (id, rep) of all vectors.

    Equal vectors are one, so n copies give n rows of the second frame and none
    of the first.
    """
    found = staged(metric.distinct(vectors, threshold, id_col), "distinct-vectors")
    return metric.pairs(found.filter("id = rep").select("id", "v"), threshold), found.select("id", "rep")


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id") -> DataFrame:
    """(a, b, score) of all pairs a < b with a cosine over *threshold*, exactly; copies are written out.

    Where vectors have many copies, ``similar_classes`` says the same with fewer rows.
    """
    pairs, members = similar_classes(vectors, threshold, id_col)
    one, two = (members.select(F.col("id").alias(f"id_{c}"), F.col("rep").alias(c)) for c in "ab")
    apart = pairs.join(one, "a").join(two, "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "score")
    copies = one.join(two.withColumnRenamed("b", "a"), "a").filter("id_a < id_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(1.0).alias("score"))
    return apart.unionByName(copies)


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the least id that each node is connected with; nodes without edges are their own.

    Each round takes the least label among neighbours and then that label's own
    label, so long chains shorten fast; each round is staged.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    now = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        heard = both.join(now, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("heard"))
        met = now.join(heard, F.col("id") == F.col("a")).select("id", "label", F.least("label", "heard").alias("least"))
        jump = now.select(F.col("id").alias("via"), F.col("label").alias("far"))
        after = staged(met.join(jump, F.col("least") == F.col("via")).select("id", F.col("label").alias("before"), F.least("least", "far").alias("label")), "labels")
        changed = after.filter("before <> label").limit(1).count()
        now = after.select("id", "label")
        if not changed:
            break
    return nodes.select("id").join(now, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def clusters(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id") -> DataFrame:
    """id, cluster_id, pos, size, is_rep: connected components of pairs over *threshold*; single ones too.

    A cluster's id and representative is its least id, that inserted first.
    """
    members = staged(metric.distinct(vectors, threshold, id_col), "distinct-vectors")
    reps = members.filter("id = rep").select("id", "v")
    of_reps = labels(reps, metric.edges(reps, threshold)).withColumnRenamed("id", "rep")
    found = members.select("id", "rep").distinct().join(of_reps, "rep").select("id", "label")
    placed = dense_ids(found, ["label", "id"], "__n")
    groups = placed.groupBy("label").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("size"))
    return placed.join(groups, "label").select(
        "id", F.col("label").alias("cluster_id"), (F.col("__n") - F.col("__first") + 1).cast("int").alias("pos"), "size", (F.col("id") == F.col("label")).alias("is_rep")
    )


def dedup_report(found: DataFrame) -> DataFrame:
    """Rows of clusters of two or more: cluster name by order, whether to keep or to check."""
    several = found.filter("size > 1")
    order = dense_ids(several.filter("is_rep").select("cluster_id"), ["cluster_id"], "n")
    action = F.when(F.col("is_rep"), "Keep").otherwise("Remove/Check")
    return several.join(order, "cluster_id").select(F.format_string("CLUSTER_%04d", "n").alias("cluster"), "id", "pos", "size", action.alias("action"))


def cluster_metrics(found: DataFrame) -> DataFrame:
    """One row: total, unique, duplicates, dup_rate (percent), compression."""
    one = found.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("is_rep").cast("long")).alias("unique_docs"))
    return one.select(
        "total",
        "unique_docs",
        (F.col("total") - F.col("unique_docs")).alias("duplicates"),
        F.round(F.try_divide(100.0 * (F.col("total") - F.col("unique_docs")), F.col("total").cast("double")), 6).alias("dup_rate"),
        F.round(F.try_divide(F.col("total").cast("double"), F.col("unique_docs").cast("double")), 6).alias("compression"),
    )


def size_histogram(found: DataFrame) -> DataFrame:
    return found.filter("is_rep AND size > 1").groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters"))


def type_statistics(found: DataFrame, types: DataFrame, top: int = 10) -> DataFrame:
    """Per type (id, doc_type): total, unique (by representative), dup_rate; UNKNOWN is left out."""
    per = found.join(types, "id").filter("doc_type <> 'UNKNOWN'").groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("is_rep").cast("long")).alias("unique_docs")
    )
    rate = F.round(100.0 * (F.col("total") - F.col("unique_docs")) / F.col("total"), 6)
    return per.withColumn("dup_rate", rate).orderBy(F.desc("total"), "doc_type").limit(top)


def largest_clusters(found: DataFrame, clusters_: int = 5, members: int = 4) -> DataFrame:
    top = found.filter("is_rep AND size > 1").orderBy(F.desc("size"), "cluster_id").limit(clusters_).select("cluster_id")
    return found.join(F.broadcast(top), "cluster_id", "left_semi").filter(F.col("pos") <= members)
