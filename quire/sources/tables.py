"""Other inputs: OCR results, review sessions, conversion reports, label files, batches."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OCR_SCHEMA = "filename string, anno_id string, category string, gt_text string, ocr_text string, similarity double, timestamp double"
#: Names of batch folders, and of the JSON and image folders in one.
BATCH_PATTERNS = ("*_delivery_*", "*_rework_*", "*_final_*")
JSON_DIR, IMAGE_DIR = "json", "img"


def read_ocr_cache(spark: SparkSession, path: str) -> DataFrame:
    """OCR results, of each (filename, anno_id) the last row."""
    rows = spark.read.csv(path, header=True, schema=OCR_SCHEMA, multiLine=True, escape='"')
    return last_of(rows.withColumn("__n", F.monotonically_increasing_id()), ["filename", "anno_id"], "__n").drop("__n")


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(latest)).filter("__r = 1").drop("__r")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Review sessions, one JSON file each; files that are no JSON are left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("session"), F.try_parse_json("value").alias("v"))
    get = lambda k, t: F.expr(f"try_variant_get(v, '$.{k}', '{t}')").alias(k)
    return text.filter("v IS NOT NULL").select(
        "session", get("batch", "string"), get("date", "string"), get("sample_rate", "double"), get("min_per_type", "int"), get("seed", "int"), get("sampled_files", "array<string>"), "v"
    )


def session_exists(spark: SparkSession, folder: str, session: str) -> bool:
    return (session, False) in _list(spark, folder)


def delete_session(spark: SparkSession, folder: str, session: str) -> bool:
    """Delete a session's file; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{session}")
    return session_exists(spark, folder, session) and path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def session_results(sessions: DataFrame) -> DataFrame:
    """session, file, is_error, error_types, memo, reviewed of the stored review results."""
    result = "map<string, struct<is_error: boolean, error_types: array<string>, memo: string, reviewed: boolean>>"
    rows = sessions.select("session", F.explode(F.expr(f"try_variant_get(v, '$.review_results', '{result}')")).alias("file", "r"))
    return rows.select("session", "file", "r.is_error", "r.error_types", "r.memo", "r.reviewed")


def read_conversion_report(spark: SparkSession, path: str) -> DataFrame:
    """Conversion report rows of four columns; shorter ones are left out."""
    rows = spark.read.csv(path, header=True, schema="filename string, field string, original string, converted string", mode="DROPMALFORMED", escape='"')
    return rows.filter("converted IS NOT NULL")


def read_label_file(spark: SparkSession, path: str) -> DataFrame:
    """path and text of tab-separated lines, cut at the first tab; lines without one are left out."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).filter(F.size(parts) == 2).select(parts[0].alias("path"), parts[1].alias("text"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All vectors of a stored collection, however many."""
    return spark.read.parquet(path)


def _list(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(hadoop)
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(folder)] if fs.exists(folder) else []


def batches(spark: SparkSession, bases: list[str], patterns: tuple[str, ...] = BATCH_PATTERNS) -> list[str]:
    """Names of batch folders below any of *bases*, in descending order."""
    found = [n for base in bases for n, is_dir in _list(spark, base) if is_dir and any(fnmatch.fnmatch(n, p) for p in patterns)]
    return sorted(found, reverse=True)


def batch_dirs(spark: SparkSession, bases: list[str], name: str) -> tuple[str, str]:
    """(JSON folder, image folder) of a batch in the first of *bases* that has it, else in the last.

    A batch without an image folder, but with images, is its own image folder.
    """
    for base in bases:
        entries = _list(spark, f"{base}/{name}")
        if entries:
            folder = f"{base}/{name}"
            own = (IMAGE_DIR, True) not in entries and any(n.lower().endswith((".jpg", ".jpeg", ".png")) for n, is_dir in entries if not is_dir)
            return f"{folder}/{JSON_DIR}", folder if own else f"{folder}/{IMAGE_DIR}"
    return f"{bases[-1]}/{name}/{JSON_DIR}", f"{bases[-1]}/{name}/{IMAGE_DIR}"
