"""A corpus pipeline of five of the operators, each stage written and read again.

Stages take (spark, docs, sf_dir).  All but the last return the columns of
*docs*, further ones with any names too; the last returns packed pieces.  Null,
empty and very long texts, ties, repeated rows and nulls in other columns have
the results that each stage states; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, langid, line_dedup, minhash, packing
from quire.llm.common import keeping_columns, scratch, staged

#: The driver's check of these rows is by a brute-force version in the tests.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined stay; lang becomes the predicted one.

    Null texts and those without letters go, and without rows that have a lang
    all do; whole texts count, repeated rows are repeated, and of equally likely
    languages the first by name is meant.
    """
    return langid.accepted(docs, langid.learn(docs.select("doc_id", "text", "lang")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars is that of the lines that stay.

    All rows stay: a null text, and one whose lines all go, becomes the empty
    text.  Repeated rows are documents of their own, so ten copies of a row lose
    its lines.
    """

    def deduped(rows: DataFrame) -> DataFrame:
        found = line_dedup.apply(line_dedup.build(rows), rows)
        if "n_chars" in docs.columns:
            found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return found

    return keeping_columns(docs, ("n_lines", "n_dropped"), deduped)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the least doc_id.

    Texts without words are like no other, and rows without a doc_id stay, too;
    of rows with one doc_id a fixed one stays (``minhash.one_row_each``).
    """
    return minhash.kept(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go.

    Texts are scanned whole; null and empty ones hold nothing and stay, and
    repeated rows stay or go together.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, with their sequences; a null or empty text is its end id alone.

    Repeated rows are packed apart, and rows without a doc_id have pieces without one.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result staged in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), f"stage{n}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
