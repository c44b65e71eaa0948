"""Review sessions: results as an append-only log, progress, error rates, label edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.numbering import dense_ids

RESULT = "is_error boolean, error_types array<string>, memo string, reviewed boolean"


def new_session(sampled: DataFrame, file: str = "file") -> DataFrame:
    """An entry for each sampled file, not yet reviewed."""
    return sampled.select(
        F.col(file).alias("file"), F.lit(False).alias("is_error"), F.array().cast("array<string>").alias("error_types"), F.lit("").alias("memo"), F.lit(False).alias("reviewed")
    )


def upsert(log: DataFrame, keys: list[str] = ("file",), order: str = "ts") -> DataFrame:
    """Of each file's log entries the last one; what was logged counts as reviewed."""
    rest = [c for c in log.columns if c not in (*keys, order, "reviewed")]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != "error_types"])).alias("r"))
    return latest.select(*keys, "r.*", F.lit(True).alias("reviewed"))


def with_results(sampled: DataFrame, results: DataFrame) -> DataFrame:
    """Sampled files with their results; default entries where there is none."""
    joined = sampled.join(results, "file", "left")
    return joined.na.fill({"is_error": False, "memo": "", "reviewed": False}).withColumn("error_types", F.coalesce("error_types", F.array().cast("array<string>")))


def summary(breakdown: DataFrame, reviewed: DataFrame, stratum: str = "doc_type") -> DataFrame:
    """Per type: total, sampled, errors, error rate of the sample in percent; then a row for all (ALL).

    Errors count under the same type as the sample, known or not.
    """
    errors = reviewed.filter("is_error").groupBy(stratum).agg(F.count(F.lit(1)).alias("errors"))
    per = breakdown.select(stratum, "total", "sampled").join(errors, stratum, "left").na.fill(0, ["errors"])
    whole = per.agg(F.lit("ALL").alias(stratum), F.sum("total").alias("total"), F.sum("sampled").alias("sampled"), F.sum("errors").alias("errors"))
    rate = F.coalesce(F.round(F.try_divide(F.col("errors").cast("double"), F.col("sampled").cast("double")) * 100, 1), F.lit(0.0))
    return per.unionByName(whole).withColumn("error_rate", rate)


def details(reviewed: DataFrame) -> DataFrame:
    """Rows of the detail sheet, numbered in file order."""
    return dense_ids(reviewed.withColumn("error_types", F.array_join("error_types", ", ")), ["file"], "no")


def progress(reviewed: DataFrame, by: list[str] = ()) -> DataFrame:
    """Reviewed and all files, and whether all are done; per session or type if given."""
    counted = reviewed.groupBy(*by).agg(F.count_if("reviewed").alias("done"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("finished", (F.col("total") > 0) & (F.col("done") == F.col("total")))


def next_unreviewed(reviewed: DataFrame, order: str = "pos", after: int | None = None) -> DataFrame:
    """One row: the first place not reviewed (after a place, if given), 0 if there is none."""
    open_ = ~F.col("reviewed") if after is None else ~F.col("reviewed") & (F.col(order) > after)
    return reviewed.agg(F.coalesce(F.min(F.when(open_, F.col(order))), F.lit(0)).alias("next"))


def next_id(ann: DataFrame, sub: DataFrame) -> DataFrame:
    """Per file one more than the greatest id of its blocks and their sub-regions."""
    ids = ann.select("file", F.expr("try_cast(anno_id AS bigint)").alias("id")).union(sub.select("file", F.expr("try_cast(sub_id AS bigint)")))
    return ids.groupBy("file").agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def edited(ann: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """Blocks with the edited fields (null: unchanged) of *edits* (file, anno_id, fields)."""
    new = edits.select("file", "anno_id", *(F.col(f).alias(f"__{f}") for f in fields))
    joined = ann.join(new, ["file", "anno_id"], "left")
    return joined.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).select(*ann.columns)


def with_relations(rel: DataFrame, added: DataFrame) -> DataFrame:
    """Relations and those added (file, src, tgt, relation_type) that were not there."""
    keys = ["file", "src", "tgt", "relation_type"]
    new = added.select(*keys).distinct().join(rel.select(*keys), keys, "left_anti")
    return rel.unionByName(new, allowMissingColumns=True)


#: What may be wrong with a formula that a reviewer has looked at.
FORMULA_ISSUES = (
    "수식 렌더링 오류 (깨진 기호)",
    "구분자 불일치 ($ 짝이 맞지 않음)",
    "중괄호/괄호 불일치",
    "LaTeX 명령어 오타",
    "수식 의미 불명확",
    "레이아웃/위치 이상",
    "기타",
)


def result_of(results: DataFrame, file: str) -> DataFrame:
    """One row: a file's result, or the default entry."""
    asked = results.sparkSession.range(1).select(F.lit(file).alias("file"))
    return with_results(asked, results.filter(F.col("file") == file))


def formula_reviews(ann: DataFrame, log: DataFrame) -> DataFrame:
    """Each block's last review of its formulas by eye: file, anno_id, verified, issues, notes, reviewer, ts.

    log: those columns, a row for each review; blocks never reviewed have the
    defaults, and so have issues and notes of reviews that verify nothing.
    """
    last = log.groupBy("file", "anno_id").agg(F.max_by(F.struct("verified", "issues", "notes", "reviewer", "ts"), F.struct("ts", "reviewer", "notes")).alias("r"))
    joined = ann.select("file", "anno_id").distinct().join(last, ["file", "anno_id"], "left")
    done = F.coalesce("r.verified", F.lit(False))
    return joined.select(
        "file",
        "anno_id",
        done.alias("verified"),
        F.when(done, F.coalesce("r.issues", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("issues"),
        F.when(done, F.coalesce("r.notes", F.lit(""))).otherwise("").alias("notes"),
        F.coalesce("r.reviewer", F.lit("")).alias("reviewer"),
        F.col("r.ts").alias("ts"),
    )
