"""Outputs: page files, reports, label files, manifests, vector collections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.sources import workbook


def write_files(df: DataFrame, target: str, name: str = "name", content: str = "content") -> None:
    """One file for each row below *target*, a URI that all executors reach.

    A file is written beside its place and then moved there, so that a task
    that is tried again leaves whole files.  Of rows with one name the greatest
    content stays.
    """
    from pyarrow import fs

    rows = df.groupBy(name).agg(F.max(content).alias(content)).select(name, content)

    def put(part: Iterable) -> None:
        place, root = fs.FileSystem.from_uri(target)
        for row in part:
            path = f"{root}/{row[0]}"
            place.create_dir(path.rpartition("/")[0], recursive=True)
            with place.open_output_stream(f"{path}.writing") as f:
                f.write(row[1].encode("utf-8") if isinstance(row[1], str) else bytes(row[1]))
            place.move(f"{path}.writing", path)

    rows.foreachPartition(put)


def page_json(pages: DataFrame) -> DataFrame:
    """name and content of page files, from their VARIANT."""
    return pages.filter("page IS NOT NULL").select(F.col("file").alias("name"), F.to_json("page", {"pretty": "true"}).alias("content"))


def changed_pages(pages: DataFrame, before: DataFrame) -> DataFrame:
    """Pages that are no longer as they were."""
    old = before.select("file", F.to_json("page").alias("__old"))
    return pages.join(old, "file").filter(F.to_json("page") != F.col("__old")).drop("__old")


def split_pages(documents: DataFrame) -> DataFrame:
    """name and content of a page file for each document of an array; named by image, else by place."""
    image = F.expr("try_variant_get(page, '$.page_info.image_path', 'string')")
    stem = F.regexp_replace(F.element_at(F.split(image, "/"), -1), r"\.[^.]*$", "")
    name = F.coalesce(F.nullif(stem, F.lit("")), F.format_string("annotation_%05d", "doc_pos"))
    last = documents.withColumn("name", F.concat(name, F.lit(".json"))).groupBy("name").agg(F.max_by(F.to_json("page"), "doc_pos").alias("content"))
    return last


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """A CSV folder with headers; with a byte-order mark for spreadsheet programs if asked for.

    The mark is part of the first column's name in each part file's header.
    """
    first = df.columns[0]
    out = df.withColumnRenamed(first, "\ufeff" + first) if bom else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _all_rows(df: DataFrame, limit: int) -> list:
    """The rows of a report, which must not be more than *limit*."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows; write it as CSV or raise the limit")
    return rows


def markdown(title: str, rows: DataFrame, limit: int = 1000) -> str:
    """A report's table as Markdown; fails beyond *limit* rows."""
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{' --- |' * len(rows.columns)}\n"
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return head + "".join(f"| {' | '.join(map(cell, r))} |\n" for r in _all_rows(rows, limit))


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """One small file, such as a report, at a path of any file system that the session knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def table_sheet(name: str, df: DataFrame, limit: int = 100_000) -> workbook.Sheet:
    """A sheet of a frame's rows under its column names; fails beyond *limit* rows."""
    cell = lambda v: str(v) if isinstance(v, list | dict) else v
    return workbook.Sheet(name, [df.columns, *([cell(v) for v in row] for row in _all_rows(df, limit))], heads={0})


def write_xlsx(sheets: dict[str, DataFrame], path: str, limit: int = 100_000) -> None:
    """Report sheets as a workbook; fails beyond *limit* rows of a sheet."""
    spark = next(iter(sheets.values())).sparkSession
    write_bytes(spark, workbook.to_bytes([table_sheet(name, df, limit) for name, df in sheets.items()]), path)


def validation_sheets(found: DataFrame, files: int, limit: int = 100_000) -> list[workbook.Sheet]:
    """Findings, and a sheet of totals: all, errors, warnings, files read."""
    totals = found.agg(F.count(F.lit(1)), F.count_if(F.col("severity") == "ERROR"), F.count_if(F.col("severity") == "WARNING")).first()
    names = ("총 이슈", "오류 (ERROR)", "경고 (WARNING)", "스캔한 파일")
    return [table_sheet("검증 결과", found, limit), workbook.Sheet("요약", [("항목", "값"), *zip(names, (*totals, files), strict=True)], heads={0})]


def review_sheets(session: dict, summary: DataFrame, details: DataFrame, limit: int = 100_000) -> list[workbook.Sheet]:
    """The review's two sheets: totals of the session and by type, and each sampled file with its result.

    session: label and value of each line at the top.  summary: doc_type, name,
    total, sampled, errors, error_rate, its last row that of all types (ALL).
    details: no, file, doc_type, name, is_error, error_types, memo, reviewed.
    Rows are filled by whether there are errors.
    """
    fill = {True: workbook.ERROR_FILL, False: workbook.OK_FILL}
    top = workbook.Sheet("요약", [*session.items()], bold=set(range(len(session))), widths=(10, 24, 14, 10, 10, 12))
    top.rows += [(), ("문서 유형", "유형명", "전체 페이지", "샘플 수", "오류 수", "오류율(%)")]
    top.heads.add(len(top.rows) - 1)
    rows = _all_rows(summary.select("doc_type", "name", "total", "sampled", "errors", "error_rate"), limit)
    for r in sorted(rows, key=lambda r: (r["doc_type"] == "ALL", r["doc_type"])):
        if r["doc_type"] == "ALL":
            top.bold.add(len(top.rows))
            top.rows.append(("합계", None, None, r["sampled"], r["errors"], r["error_rate"]))
        else:
            top.fills[len(top.rows)] = fill[r["error_rate"] > 0]
            top.rows.append((r["doc_type"], r["name"] or r["doc_type"], *r[2:]))
    listed = workbook.Sheet("검수결과", [("번호", "파일명", "문서 유형", "유형명", "오류 여부", "오류 유형", "검수자 메모", "검수 완료")], heads={0}, widths=(6, 60, 10, 18, 10, 30, 30, 10))
    for r in sorted(_all_rows(details.select("no", "file", "doc_type", "name", "is_error", "error_types", "memo", "reviewed"), limit), key=lambda r: r["no"]):
        if r["is_error"] or r["reviewed"]:
            listed.fills[len(listed.rows)] = fill[r["is_error"]]
        listed.rows.append((r["no"], r["file"], r["doc_type"], r["name"] or r["doc_type"], "오류" if r["is_error"] else "정상", r["error_types"], r["memo"], "✅" if r["reviewed"] else "⬜"))
    return [top, listed]


def append_vectors(vectors: DataFrame, path: str, stored: DataFrame | None = None, key: str = "doc_id") -> None:
    """Append vectors of documents that *stored* lacks, so a batch that is run again adds nothing."""
    new = vectors if stored is None else vectors.join(stored.select(key).distinct(), key, "left_anti")
    new.write.mode("append").parquet(path)


def label_lines(pairs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Numbered label lines, ``images/0000001.jpg<TAB>text``, with the image's name."""
    from quire.operators.numbering import dense_ids

    numbered = dense_ids(pairs, [key])
    image = F.format_string("images/%07d.jpg", "id")
    return numbered.select("id", image.alias("image"), F.concat(image, F.lit("\t"), F.col(text)).alias("line"))


def key_value_entries(pairs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """The entries of an image store: image-%09d, label-%09d for each pair, and num-samples."""
    from quire.operators.numbering import dense_ids

    numbered = dense_ids(pairs, [key])
    each = numbered.select(F.explode(F.array(F.struct(F.format_string("image-%09d", "id").alias("k"), F.col(key).cast("string").alias("v")), F.struct(F.format_string("label-%09d", "id").alias("k"), F.col(text).alias("v")))).alias("e"))
    total = numbered.agg(F.lit("num-samples").alias("k"), F.count(F.lit(1)).cast("string").alias("v"))
    return each.select("e.k", "e.v").union(total)


def copy_manifest(files: DataFrame, group: Column, source: Column, target_dir: str) -> DataFrame:
    """src and dst of files to be copied into a folder for each value of a group."""
    from quire.functions.text import safe_name

    return files.select(source.alias("src"), F.concat_ws("/", F.lit(target_dir), safe_name(group), F.element_at(F.split(source, "/"), -1)).alias("dst")).distinct()


def group_counts(manifest: DataFrame) -> DataFrame:
    """Files of a manifest by the folder of their group."""
    folder = F.element_at(F.split("dst", "/"), -2)
    return manifest.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def copy_files(manifest: DataFrame) -> None:
    """Do what a manifest says, on the executors."""
    from pyarrow import fs

    def run(part: Iterable) -> None:
        for row in part:
            source, a = fs.FileSystem.from_uri(row["src"])
            target, b = fs.FileSystem.from_uri(row["dst"])
            target.create_dir(b.rpartition("/")[0], recursive=True)
            fs.copy_files(a, b, source_filesystem=source, destination_filesystem=target)

    manifest.select("src", "dst").foreachPartition(run)


def draw_list(ann: DataFrame, rel: DataFrame, colors: DataFrame) -> DataFrame:
    """What a page's picture shows: outlines with colour and label, and arrows of relations, as rows."""
    default = F.lit("#343a40")
    named = ann.join(F.broadcast(colors), "category", "left")
    outlines = named.select("file", F.lit("polygon").alias("shape"), F.coalesce("color", default).alias("color"), F.concat_ws(":", "anno_id", "category").alias("label"), F.col("poly").alias("points"))
    centres = ann.select("file", "anno_id", geometry.centre("poly").alias("c"))
    start = centres.select("file", F.col("anno_id").alias("src"), F.col("c").alias("a"))
    end = centres.select("file", F.col("anno_id").alias("tgt"), F.col("c").alias("b"))
    lines = rel.join(start, ["file", "src"]).join(end, ["file", "tgt"]).withColumn("h", geometry.arrow_head(F.col("a"), F.col("b")))
    points = F.array("a.x", "a.y", "b.x", "b.y", "h.x1", "h.y1", "h.x2", "h.y2")
    arrows = lines.select("file", F.lit("arrow").alias("shape"), F.lit("#FF00FF").alias("color"), F.col("relation_type").alias("label"), points.alias("points"))
    return outlines.unionByName(arrows)


def page_pictures(shapes: DataFrame, info: DataFrame) -> DataFrame:
    """name and content of a picture (SVG) for each page of *info* (file, width, height, image_path) from its ``draw_list``.

    The page's image, if it has one, lies below the outlines and arrows.
    """
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    at = lambda i: F.get("points", F.lit(i)).cast("string")
    points = F.array_join(F.transform("points", lambda p: p.cast("string")), " ")
    label = escaped(F.coalesce("label", F.lit("")))
    outline = F.concat(F.lit('<polygon fill="none" stroke-width="2" stroke="'), "color", F.lit('" points="'), points, F.lit('"/><text fill="'), "color", F.lit('" x="'), at(0), F.lit('" y="'), at(1), F.lit('">'), label, F.lit("</text>"))
    path = F.concat(F.lit("M"), at(0), F.lit(" "), at(1), F.lit(" L"), at(2), F.lit(" "), at(3), F.lit(" M"), at(4), F.lit(" "), at(5), F.lit(" L"), at(2), F.lit(" "), at(3), F.lit(" L"), at(6), F.lit(" "), at(7))
    arrow = F.concat(F.lit('<path fill="none" stroke-width="2" stroke="'), "color", F.lit('" d="'), path, F.lit('"><title>'), label, F.lit("</title></path>"))
    drawn = shapes.filter(F.size("points") >= 2).select("file", F.when(F.col("shape") == "arrow", F.struct(F.lit(1).alias("z"), arrow.alias("e"))).otherwise(F.struct(F.lit(0).alias("z"), outline.alias("e"))).alias("s"))
    body = drawn.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["e"]), "").alias("body"))
    size = lambda c, default: F.coalesce(c, F.lit(default)).cast("string")
    box = F.concat_ws(" ", F.lit("0 0"), size("width", geometry.PAGE_WIDTH), size("height", geometry.PAGE_HEIGHT))
    image = F.coalesce(F.concat(F.lit('<image href="'), escaped(F.col("image_path")), F.lit('"/>')), F.lit(""))
    content = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), box, F.lit('">'), image, F.coalesce("body", F.lit("")), F.lit("</svg>"))
    return info.join(body, "file", "left").select(F.concat(F.regexp_replace("file", r"\.json$", ""), F.lit(".svg")).alias("name"), content.alias("content"))


def write_charset(chars: DataFrame, path: str) -> None:
    """Characters in code point order, one line of them; a charset is bounded by Unicode."""
    chars.select("ch").coalesce(1).write.mode("overwrite").text(path)


def stop_unless_exists(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        raise FileNotFoundError(path)
