"""Places for image models: embeddings, regions, text recognition.

A model is a function that the caller brings; it is loaded once in each task
and sees Arrow batches of images.  A file that a model fails on gives a row
with the error and stops no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.staging import staged

#: Region labels that are stored, and the vectors' lengths by stage.
REGION_LABELS = ("signature", "stamp", "table")
DIMENSIONS = {1: 1024, 2: 768, 3: 768}

Load = Callable[[], Callable]


def _each(df: DataFrame, columns: Sequence[str], load: Load, schema: str, rows: Callable) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromJson(described))
        model = load()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out += [(*r, None) for r in rows(model, row)]
                except Exception as e:  # one bad file stops no other
                    out.append((row[columns[0]], *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)

    described = df.sparkSession.createDataFrame([], schema).schema.jsonValue()
    return df.select(*columns).mapInArrow(run, schema)


def embed(images: DataFrame, load: Load, key: str = "doc_id", content: str = "content") -> DataFrame:
    """doc_id, embedding (unit length), error: ``load()`` gives a function from bytes to numbers."""

    def rows(model: Callable, row: dict) -> list[tuple]:
        return [(row[key], _unit(model(row[content])))]

    return _each(images, [key, content], load, "doc_id string, embedding array<double>, error string", rows)


def _unit(numbers: Sequence) -> list[float]:
    v = [float(x) for x in numbers]
    norm = sum(x * x for x in v) ** 0.5 + 1e-6
    return [x / norm for x in v]


def regions(images: DataFrame, load: Load, key: str = "doc_id", content: str = "content", size: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, label, box, embedding (unit length), error of each stored region.

    ``load()`` gives a function from bytes to (label, box, numbers) triples;
    other labels are left out.  With the columns of the images' width and height
    in *size*, boxes are kept inside them; boxes without area are left out.
    """

    def rows(model: Callable, row: dict) -> list[tuple]:
        out = []
        for label, box, v in model(row[content]):
            x1, y1, x2, y2 = map(float, box)
            if size:
                x1, y1, x2, y2 = max(0.0, x1), max(0.0, y1), min(float(row[size[0]]), x2), min(float(row[size[1]]), y2)
            if label.lower() in REGION_LABELS and x2 > x1 and y2 > y1:
                out.append((row[key], label.lower(), [x1, y1, x2, y2], _unit(v)))
        return out

    return _each(images, [key, content, *(size or ())], load, "doc_id string, label string, box array<double>, embedding array<double>, error string", rows)


def recognise(crops: DataFrame, load: Load, key: str = "key", content: str = "content", joiner: str = " ") -> DataFrame:
    """key, ocr_text, error: ``load()`` gives a function from bytes to the tokens read."""
    return _each(crops, [key, content], load, "key string, ocr_text string, error string", lambda m, r: [(r[key], joiner.join(m(r[content])))])


def run_stages(images: DataFrame, loads: dict[int, Load]) -> tuple[dict[int, DataFrame], DataFrame]:
    """Vectors by stage, of the stages chosen, and a report: per document what each stage made and its errors.

    A stage's model sees each image once; what it made is staged.
    """
    made = {s: staged((regions if s == 3 else embed)(images, load), f"stage{s}") for s, load in loads.items()}
    report = images.select("doc_id").distinct()
    for stage, df in made.items():
        per = df.groupBy("doc_id").agg(F.count("embedding").alias(f"stage_{stage}"), F.max("error").alias(f"error_{stage}"))
        report = report.join(per, "doc_id", "left").na.fill(0, [f"stage_{stage}"])
    return {s: df.filter("embedding IS NOT NULL").drop("error") for s, df in made.items()}, report
