"""Crops of page pictures by polygons, and the training files made of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import geometry, rasters
from quire.functions.geometry import CANVAS
from quire.functions.text import col_of, strip
from quire.operators.numbering import dense_ids
from quire.operators.sampling import train_split, training_reason
from quire.plans import rules
from quire.sources import sinks
from quire.staging import spread, staged

#: Rows of pictures in one Arrow batch.
PICTURES = "8"
#: Bytes of crops after which a batch of them ends.
CROP_BYTES = 8 << 20

_QUAD = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("corners", T.ArrayType(T.DoubleType())),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("m", T.ArrayType(T.DoubleType())),
    ]
)


@F.pandas_udf(_QUAD)
def _quads(polys: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = _QUAD.names
    for batch in polys:
        found = [rasters.quad(p) or dict.fromkeys(names) for p in batch]
        yield pd.DataFrame({n: pd.Series([f[n] for f in found], dtype=object) for n in names})


def quad(poly: Column | str) -> Column:
    """struct(kind, corners, width, height, m) of ``rasters.quad``; nulls where a polygon cuts nothing out."""
    return _quads(col_of(poly).cast("array<double>"))


_CROPS = "file string, pos int, width int, height int, content binary, error string"


def crops(
    pictures: DataFrame, regions: DataFrame, decode: Callable[[bytes], np.ndarray] = rasters.decode, cut: Callable = rasters.cut, as_png: bool = True
) -> DataFrame:
    """file, pos, width, height, content, error: what each region (file, pos, poly) cuts out of its picture (file, content).

    content is a PNG, or rows of plain channel bytes.  A region without a
    picture, of one that *decode* fails on, or that cuts nothing out has an
    error (IMG_NOT_FOUND, IMG_LOAD_FAILED, CROP_EMPTY) and no content.  A
    picture is decoded once for all its regions, which meet it as one row; of
    two pictures of one file the greatest content counts.
    """
    spark = pictures.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", PICTURES)
    one = spread(pictures, "file").groupBy("file").agg(F.max("content").alias("content"))
    listed = spread(regions, "file").groupBy("file").agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("poly").cast("array<double>").alias("poly"))).alias("regions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, places, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pixels, error = None, "IMG_NOT_FOUND" if content is None else None
                if content is not None:
                    try:
                        pixels = decode(content)
                    except Exception:  # whatever a decoder raises, other pictures go on
                        error = "IMG_LOAD_FAILED"
                rows, size = [], 0
                for place in places:
                    part = None if pixels is None else cut(pixels, place["poly"])
                    if part is None:
                        rows.append((file, place["pos"], None, None, None, error or "CROP_EMPTY"))
                    else:
                        rows.append((file, place["pos"], part.shape[1], part.shape[0], rasters.encode(part) if as_png else part.tobytes(), None))
                        size += len(rows[-1][4])
                    if len(rows) == 64 or size >= CROP_BYTES:
                        yield _crop_rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _crop_rows(rows)

    return listed.join(one, "file", "left").select("file", "regions", "content").mapInArrow(run, _CROPS)


def _crop_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["file", "pos", "width", "height", "content", "error"])


def canvas_pixels(content: bytes) -> np.ndarray:
    """Pixels of a ``geometry.layout_canvas``."""
    return np.frombuffer(content, np.uint8).reshape(CANVAS, CANVAS, 3)


def layout_pictures(ann: DataFrame, width: Column, height: Column) -> DataFrame:
    """file, content: each page's canvas as its list of boxes, which ``layout_pixels`` draws where the picture is cut."""
    boxes = geometry.layout_boxes(ann, width, height)
    return boxes.select("file", F.to_json("b").cast("binary").alias("content"))


def layout_pixels(content: bytes) -> np.ndarray:
    """Pixels of a picture of ``layout_pictures``, the same as those of ``geometry.layout_canvas``."""
    return geometry.drawn_canvas(json.loads(bytes(content)))


def training_text(text: Column | str) -> Column:
    """A block's text on one line, without outer white space; null is empty."""
    return strip(F.translate(F.coalesce(col_of(text), F.lit("")), "\n\r", "  "))


def training_crops(ann: DataFrame, pictures: DataFrame, decode: Callable[[bytes], np.ndarray] = rasters.decode) -> DataFrame:
    """file, pos, text, width, height, content, reason of all blocks (file, pos, category, text, poly).

    Only blocks that category and text let through are cut out; reason says why
    a block gives no pair, and is null if it gives one.
    """
    named = ann.select("file", F.col("pos").cast("int").alias("pos"), "category", training_text("text").alias("text"), "poly")
    early = F.when(~F.col("category").isin(*rules.TRAINING_CATEGORIES), F.concat(F.lit("CAT_EXCLUDED("), "category", F.lit(")"))).when(F.length("text") == 0, "TEXT_EMPTY")
    named = named.withColumn("early", early)
    found = crops(pictures, named.filter("early IS NULL"), decode)
    late = F.coalesce("error", training_reason(F.col("category"), F.col("text"), F.col("width"), F.col("height")))
    cut = named.filter("early IS NULL").join(found, ["file", "pos"]).select("file", "pos", "text", "width", "height", "content", late.alias("reason"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("content", "binary"))]
    return cut.unionByName(named.filter("early IS NOT NULL").select("file", "pos", "text", *nothing, F.col("early").alias("reason")))


def write_training_set(made: DataFrame, target: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Write the pairs of ``training_crops`` below *target*, and return the numbers of skipped blocks by reason.

    Crops are files ``images/0000001.png``, numbered by file and place and
    written by the executors; ``labels``, ``train`` and ``val`` are folders of
    text files with lines ``images/0000001.png<TAB>text``, the last two an exact
    split by *seed*.
    """
    made = staged(made, "training-crops")
    numbered = dense_ids(made.filter("reason IS NULL"), ["file", "pos"])
    image = F.format_string("images/%07d.png", "id")
    pairs = staged(numbered.select("id", image.alias("name"), F.concat(image, F.lit("\t"), "text").alias("line"), "content"), "training-pairs")
    sinks.write_files(pairs, target)
    lines = pairs.select("id", "line")
    lines.orderBy("id").select("line").write.mode("overwrite").text(f"{target}/labels")
    split = train_split(lines, "id", share, seed)
    for name in ("train", "val"):
        split.filter(F.col("split") == name).select("line").write.mode("overwrite").text(f"{target}/{name}")
    return made.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
