"""Geometry of polygons given as flat arrays of x, y, x, y, ..."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import col_of
from quire.staging import spread


def xs(poly: Column | str) -> Column:
    return F.filter(col_of(poly), lambda _, i: i % 2 == 0)


def ys(poly: Column | str) -> Column:
    return F.filter(col_of(poly), lambda _, i: i % 2 == 1)


def flat(nested: Column | str) -> Column:
    """[[x, y], ...] as a flat polygon."""
    return F.flatten(col_of(nested))


def box(poly: Column | str) -> Column:
    """struct(x1, y1, x2, y2); zeros for an odd or empty polygon."""
    p = col_of(poly)
    fine = p.isNotNull() & (F.size(p) > 0) & (F.size(p) % 2 == 0)
    names = ("x1", F.array_min(xs(p))), ("y1", F.array_min(ys(p))), ("x2", F.array_max(xs(p))), ("y2", F.array_max(ys(p)))
    return F.struct(*(F.when(fine, v).otherwise(0.0).cast("double").alias(n) for n, v in names))


def extent(poly: Column | str) -> Column:
    """struct(width, height, area, aspect) of the box; zeros for fewer than two numbers, aspect 0 without height."""
    p = col_of(poly)
    fine = p.isNotNull() & (F.size(p) >= 2)
    w = F.when(fine, F.array_max(xs(p)) - F.array_min(xs(p))).otherwise(0.0).cast("double")
    h = F.when(fine, F.array_max(ys(p)) - F.array_min(ys(p))).otherwise(0.0).cast("double")
    aspect = F.when(h > 0, w / h).otherwise(0.0)
    return F.struct(w.alias("width"), h.alias("height"), (w * h).alias("area"), aspect.alias("aspect"))


def centre(poly: Column | str) -> Column:
    """struct(x, y), the mean of the vertices; null for an odd or empty polygon."""
    p = col_of(poly)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.when(p.isNotNull() & (F.size(p) > 0) & (F.size(p) % 2 == 0), F.struct(mean(xs(p)).alias("x"), mean(ys(p)).alias("y")))


def contains_box(outer: Column, inner: Column) -> Column:
    return (outer["x1"] <= inner["x1"]) & (outer["y1"] <= inner["y1"]) & (outer["x2"] >= inner["x2"]) & (outer["y2"] >= inner["y2"])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))


def box_overlap(parent: Column, child: Column) -> Column:
    """Share of the child's box that the parent's covers; 0 for a child without area."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(parent[hi], child[hi]) - F.greatest(parent[lo], child[lo]))
    area = (child["x2"] - child["x1"]) * (child["y2"] - child["y1"])
    return F.when(area > 0, side("x1", "x2") * side("y1", "y2") / area).otherwise(0.0)


def is_rectangle(poly: Column | str) -> Column:
    """Four corners of an upright rectangle, in turn."""
    p = col_of(poly)
    at = lambda i: F.get(p, F.lit(i))
    one = (at(0) == at(6)) & (at(2) == at(4)) & (at(1) == at(3)) & (at(5) == at(7))
    other = (at(0) == at(2)) & (at(4) == at(6)) & (at(1) == at(7)) & (at(3) == at(5))
    return F.coalesce((F.size(p) == 8) & (one | other), F.lit(False))


def has_point(poly: Column | str, x: Column, y: Column) -> Column:
    """Whether a point is inside, by the parity of edges that a ray to the right crosses; false under three vertices."""
    p = col_of(poly)
    n = (F.size(p) / 2).cast("int")
    at = lambda i: F.get(p, i)

    def crosses(i: Column) -> Column:
        j = F.when(i == 0, n - 1).otherwise(i - 1)
        xi, yi, xj, yj = at(2 * i), at(2 * i + 1), at(2 * j), at(2 * j + 1)
        return ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / F.nullif(yj - yi, F.lit(0.0)) + xi)

    inside = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda s, i: s != F.coalesce(crosses(i), F.lit(False)))
    return F.when(F.size(p) >= 6, inside).otherwise(False)


def crop(b: Column, margin: float, width: Column, height: Column) -> Column:
    """A box with a margin, kept inside the image."""
    return F.struct(
        F.greatest(F.lit(0.0), b["x1"] - margin).alias("x1"),
        F.greatest(F.lit(0.0), b["y1"] - margin).alias("y1"),
        F.least(width, b["x2"] + margin).alias("x2"),
        F.least(height, b["y2"] + margin).alias("y2"),
    )


#: The canvas of layout features and a page's size where unknown.
CANVAS, PAGE_WIDTH, PAGE_HEIGHT = 512, 1000.0, 1400.0


def on_canvas(b: Column, width: Column, height: Column) -> Column:
    """A box scaled from its page to the canvas, in whole pixels."""
    w, h = F.coalesce(F.nullif(width, F.lit(0.0)), F.lit(PAGE_WIDTH)), F.coalesce(F.nullif(height, F.lit(0.0)), F.lit(PAGE_HEIGHT))
    return F.struct(
        (b["x1"] / w * CANVAS).cast("int").alias("x1"),
        (b["y1"] / h * CANVAS).cast("int").alias("y1"),
        (b["x2"] / w * CANVAS).cast("int").alias("x2"),
        (b["y2"] / h * CANVAS).cast("int").alias("y2"),
    )


def layout_grid(boxes: DataFrame, cells: int = 16) -> DataFrame:
    """Per file a vector of how much of each canvas cell its boxes (file, box) cover: a layout feature without a model."""
    step = CANVAS // cells
    lo = lambda c: F.greatest(F.lit(0), F.floor(F.col(f"box.{c}") / step)).cast("int")
    hi = lambda c: F.least(F.lit(cells - 1), F.floor(F.col(f"box.{c}") / step)).cast("int")
    kept = boxes.filter((hi("x2") >= lo("x1")) & (hi("y2") >= lo("y1")))
    cell = kept.select("file", "box", F.explode(F.sequence(lo("x1"), hi("x2"))).alias("cx")).select(
        "file", "box", "cx", F.explode(F.sequence(lo("y1"), hi("y2"))).alias("cy")
    )
    part = lambda c, a, b: F.greatest(F.lit(0), F.least((F.col(c) + 1) * step, F.col(f"box.{b}")) - F.greatest(F.col(c) * step, F.col(f"box.{a}")))
    covered = (part("cx", "x1", "x2") * part("cy", "y1", "y2") / float(step * step)).alias("v")
    summed = cell.select("file", (F.col("cy") * cells + F.col("cx")).alias("k"), covered).groupBy("file", "k").agg(F.sum("v").alias("v"))
    entries = F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")
    return summed.groupBy("file").agg(entries).select(
        "file", F.transform(F.sequence(F.lit(0), F.lit(cells * cells - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("embedding")
    )


# Greys and colours of categories on the canvas, and that of all others.
CANVAS_COLORS = {
    "text": (220, 220, 220),
    "title": (100, 100, 100),
    "table": (173, 216, 230),
    "figure": (144, 238, 144),
    "image": (144, 238, 144),
    "list": (200, 200, 200),
}
CANVAS_OTHER = (200, 200, 200)


def layout_boxes(ann: DataFrame, width: Column, height: Column) -> DataFrame:
    """file, b: a page's boxes on the canvas as (pos, category, box), by pos.

    Blocks (file, pos, category, poly, ignored) that are ignored or have under
    four numbers are left out.  A page's boxes, not texts, meet in one row.
    """
    x, y = xs("poly"), ys("poly")
    corners = F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))
    kept = ann.filter(F.size("poly") >= 4).filter(~F.col("ignored"))
    placed = kept.select("file", F.struct("pos", F.lower("category").alias("category"), on_canvas(corners, width, height).alias("box")).alias("b"))
    return spread(placed, "file").groupBy("file").agg(F.array_sort(F.collect_list("b")).alias("b"))


#: Canvases in one Arrow batch.
CANVASES = 8


def layout_canvas(ann: DataFrame, width: Column, height: Column) -> DataFrame:
    """file, pixels: a page's ``layout_boxes`` as filled rectangles on a white canvas, later ones over earlier ones.

    pixels: CANVAS rows of CANVAS red, green and blue bytes.
    """
    boxes = layout_boxes(ann, width, height)
    return boxes.mapInArrow(canvases, f"file {boxes.schema['file'].dataType.simpleString()}, pixels binary")


def canvases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, pixels) of (file, blocks), however many rows a batch has, CANVASES at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANVASES):
            some = batch.slice(at, CANVASES)
            drawn = [drawn_canvas(b).tobytes() for b in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(drawn, pa.binary())], ["file", "pixels"])


def drawn_canvas(blocks: list[dict]) -> np.ndarray:
    """The canvas of one page's (category, box) blocks."""
    canvas = np.full((CANVAS, CANVAS, 3), 255, np.uint8)
    for block in blocks:
        b = block["box"]
        canvas[max(0, b["y1"]) : max(0, b["y2"] + 1), max(0, b["x1"]) : max(0, b["x2"] + 1)] = CANVAS_COLORS.get(block["category"], CANVAS_OTHER)
    return canvas


#: An arrow head's length and the angle of its sides.
ARROW_LENGTH, ARROW_ANGLE = 20.0, 0.85


def arrow_head(start: Column, end: Column) -> Column:
    """struct(x1, y1, x2, y2): the two back corners of the head of an arrow from start to end."""
    import math

    angle = F.atan2(end["y"] - start["y"], end["x"] - start["x"])
    corner = lambda s, f, c: end[c] + ARROW_LENGTH * f(angle + s * math.pi * ARROW_ANGLE)
    return F.struct(corner(1, F.cos, "x").alias("x1"), corner(1, F.sin, "y").alias("y1"), corner(-1, F.cos, "x").alias("x2"), corner(-1, F.sin, "y").alias("y2"))


def rect_poly(left: Column, top: Column, width: Column, height: Column, scale_x: Column, scale_y: Column) -> Column:
    """The eight numbers of a rectangle drawn on a canvas."""
    right, bottom = left + width * scale_x, top + height * scale_y
    return F.array(left, top, right, top, right, bottom, left, bottom)


def polygon_overlap(parent: np.ndarray, child: np.ndarray) -> float:
    """Area of the common part over the child's area, both by even-odd filling.

    Between the heights of vertices and of edges' crossings every edge is a
    straight line that crosses no other, so the common length at mid-height
    times the height of such a slab is its exact area.
    """
    if len(parent) < 6 or len(child) < 6 or len(parent) % 2 or len(child) % 2:
        return 0.0
    edges = [_edges(p) for p in (parent, child)]
    heights = _heights(np.concatenate(edges))
    common = own = 0.0
    for lo, hi in zip(heights, heights[1:], strict=False):
        spans = [_spans(e, (lo + hi) / 2) for e in edges]
        own += (hi - lo) * sum(b - a for a, b in spans[1])
        common += (hi - lo) * sum(max(0.0, min(b, d) - max(a, c)) for a, b in spans[0] for c, d in spans[1])
    return float(common / own) if own > 0 else 0.0


def _edges(p: np.ndarray) -> np.ndarray:
    points = np.asarray(p, float).reshape(-1, 2)
    return np.column_stack([points, np.roll(points, -1, axis=0)])


def _heights(edges: np.ndarray) -> list[float]:
    """Heights of all vertices and of the places where two edges cross."""
    i, j = np.triu_indices(len(edges), 1)
    a, b = edges[i], edges[j]
    along, other, gap = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2], b[:, :2] - a[:, :2]
    cross = lambda p, q: p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]
    det = cross(along, other)
    fine = det != 0
    t, u = cross(gap, other)[fine] / det[fine], cross(gap, along)[fine] / det[fine]
    met = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return np.unique(np.concatenate([edges[:, 1], a[fine, 1][met] + t[met] * along[fine, 1][met]])).tolist()


def _spans(edges: np.ndarray, y: float) -> list[tuple[float, float]]:
    cut = sorted(ax + (y - ay) / (by - ay) * (bx - ax) for ax, ay, bx, by in edges if (ay > y) != (by > y))
    return list(zip(cut[::2], cut[1::2], strict=False))


@F.pandas_udf(T.DoubleType())
def _overlap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for parents, children in batches:
        yield pd.Series([0.0 if p is None or c is None else polygon_overlap(p, c) for p, c in zip(parents, children, strict=True)], dtype=float)


def with_overlap(pairs: DataFrame, parent: str, child: str, out: str = "ioa") -> DataFrame:
    """*pairs* with the share of the child polygon that the parent covers.

    Upright rectangles are computed in columns; only pairs of other shapes
    whose boxes meet go to Python, in a branch of their own.
    """
    by_box = box_overlap(box(parent), box(child))
    hard = ~(is_rectangle(parent) & is_rectangle(child)) & (by_box > 0)
    rest = pairs.filter(hard).withColumn(out, _overlap(parent, child))
    return pairs.filter(~hard).withColumn(out, by_box).unionByName(rest)
