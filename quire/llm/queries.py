"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, divergence, langid, line_dedup, merkle, minhash, packing, prefix_tree, quality, token_counts, toxicity, wavelet
from quire.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def _remainder(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(_remainder(4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return wavelet.read_documents(shards)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply(line_dedup.build(docs), docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(_remainder(5) != 0)
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


_ALL = (
    op1_chat_format,
    op2_language_id,
    op3_wavelet_shards,
    op4_token_counts,
    op5_line_dedup,
    op6_toxicity,
    op7_pack,
    op8_quality_rules,
    op9_near_duplicates,
    op10_decontaminate,
    op11_source_divergence,
    op12_ngram_join,
    op13_merkle_manifest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.ORACLE_SQL,
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op8_quality_rules": quality.ORACLE_SQL,
        "op10_decontaminate": decontaminate.ORACLE_SQL,
        "op11_source_divergence": divergence.ORACLE_SQL,
        "op12_ngram_join": prefix_tree.ORACLE_SQL,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
