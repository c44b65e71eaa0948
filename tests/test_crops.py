import math
import random
import struct
import zlib

import numpy as np
import pytest

from quire.functions import rasters
from quire.operators import crops
from quire.plans import queries


def picture(seed, height, width, channels=3):
    return np.random.default_rng(seed).integers(0, 256, (height, width, channels), dtype=np.uint8)


def test_png_and_pnm_round_trips():
    for channels in (1, 3, 4):
        pixels = picture(channels, 7, 11, channels)
        assert (rasters.decode(rasters.encode(pixels)) == pixels).all()
    pixels = picture(0, 4, 5)
    assert (rasters.decode(b"P6\n# made\n5 4\n255\n" + pixels.tobytes()) == pixels).all()
    assert (rasters.decode(b"P5 5 4 255\n" + pixels[:, :, 0].tobytes())[:, :, 0] == pixels[:, :, 0]).all()
    for bad in (b"", b"JFIF", b"P6 9 9 255\n", b"P6 2 2 65535\n" + bytes(24), rasters.encode(pixels)[:60], b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(rasters.Unreadable):
            rasters.decode(bad)


def filtered(pixels, kinds):
    """PNG lines of the given filters, byte by byte as the format defines them."""
    h, w, c = pixels.shape
    raw, flat = b"", pixels.reshape(h, -1).astype(int)
    for y in range(h):
        line = [kinds[y % len(kinds)]]
        for i in range(w * c):
            a = flat[y][i - c] if i >= c else 0
            b = flat[y - 1][i] if y else 0
            d = flat[y - 1][i - c] if y and i >= c else 0
            p = a + b - d
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            line.append((flat[y][i] - (0, a, b, (a + b) // 2, best)[line[0]]) % 256)
        raw += bytes(line)
    return raw


def png(pixels, kinds, colour, extra=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(filtered(pixels, kinds))) + chunk(b"IEND", b"")


def test_png_filters_palettes_and_turns():
    pixels = picture(5, 12, 6)
    for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (rasters.decode(png(pixels, kinds, 2)) == pixels).all()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    index, palette = picture(6, 3, 4, 1) % 5, picture(7, 1, 5)[0]
    assert (rasters.decode(png(index, [0], 3, chunk(b"PLTE", palette.tobytes()))) == palette[index[:, :, 0]]).all()
    for order, mark in (("<", b"II"), (">", b"MM")):
        exif = mark + struct.pack(f"{order}HIHHHIHH", 42, 8, 1, 0x0112, 3, 1, 6, 0)
        assert rasters.orientation(exif) == 6
        turned = rasters.decode(png(pixels, [0], 2, chunk(b"eXIf", exif)))
        assert (turned == np.rot90(pixels, -1)).all()
    assert rasters.orientation(b"") == 1 == rasters.orientation(b"II*\x00\xff\xff\xff\xff")
    seen = [rasters.turned(pixels, k) for k in range(1, 9)]
    expected = [pixels, pixels[:, ::-1], pixels[::-1, ::-1], pixels[::-1], pixels.transpose(1, 0, 2), np.rot90(pixels, -1), pixels[::-1, ::-1].transpose(1, 0, 2), np.rot90(pixels)]
    assert all((a == b).all() for a, b in zip(seen, expected, strict=True))


def test_hull_and_corners():
    rng = random.Random(0)
    for _ in range(200):
        points = np.array([(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(1, 14))])
        found = [tuple(p) for p in rasters.hull(points).tolist()]
        left = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        if len(found) > 2:
            for a, b, c in zip(found, found[1:] + found[:1], found[2:] + found[:2], strict=True):
                assert left(a, b, c) > 0 and all(left(a, b, p) >= 0 for p in points.tolist())
        assert set(found) <= set(map(tuple, points.tolist()))
    ring = np.array([(0, 0), (50, 1), (100, 0), (102, 40), (100, 80), (50, 79), (0, 80)])
    assert rasters.simplified(ring).tolist() == [[0, 0], [100, 0], [100, 80], [0, 80]]
    assert len(rasters.simplified(np.array([(0, 0), (100, 0), (150, 60), (50, 120), (-40, 60)]))) == 5


def test_quads_of_all_kinds():
    assert rasters.quad([10, 10, 60, 10, 60, 30, 10, 30]) | {"m": None} == {"kind": "quad", "corners": [10, 10, 60, 10, 60, 30, 10, 30], "width": 50, "height": 20, "m": None}
    assert rasters.quad([1.9, 1.9, 7.2, 3.3]) == {"kind": "box", "corners": [1, 1, 7, 1, 7, 3, 1, 3], "width": 6, "height": 2, "m": None}
    flat = rasters.quad([0, 5, 40, 5, 40, 6, 0, 6])
    assert (flat["kind"], flat["width"], flat["height"]) == ("box", 41, 2)
    five = rasters.quad([0, 0, 100, 0, 150, 60, 50, 120, -40, 60])
    assert (five["kind"], five["corners"][:2], five["width"], five["height"]) == ("box", [-40, 0], 191, 121)
    for none in (None, [], [1, 2, 3], [5, 5, 5, 5], [5, 5], [math.nan] * 8):
        assert rasters.quad(none) is None
    rng = random.Random(1)
    for _ in range(100):
        centre, angle = (200, 200), rng.uniform(-0.5, 0.5)
        w, h = rng.uniform(40, 90), rng.uniform(15, 35)
        corners = [(centre[0] + x * w * math.cos(angle) - y * h * math.sin(angle), centre[1] + x * w * math.sin(angle) + y * h * math.cos(angle)) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        k = rng.randrange(4)
        found = rasters.quad([v for p in corners[k:] + corners[:k] for v in p])
        assert found["corners"] == [float(int(v)) for p in corners for v in p]
        m = [*found["m"], 1.0]
        to = [(0, 0), (found["width"] - 1, 0), (found["width"] - 1, found["height"] - 1), (0, found["height"] - 1)]
        for (x, y), (u, v) in zip(np.array(found["corners"]).reshape(4, 2), to, strict=True):
            d = m[6] * x + m[7] * y + m[8]
            assert ((m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d) == pytest.approx((u, v), abs=1e-6)


def plain_warp(pixels, m, width, height):
    """Each pixel of the crop by itself."""
    back = np.linalg.inv(np.append(m, 1.0).reshape(3, 3))
    out = np.zeros((height, width, pixels.shape[2]), np.uint8)
    at = lambda i, j, c: float(pixels[i, j, c]) if 0 <= i < pixels.shape[0] and 0 <= j < pixels.shape[1] else 0.0
    for v in range(height):
        for u in range(width):
            x, y, d = back @ (u, v, 1)
            x, y = (round(z) if abs(z - round(z)) < 1e-9 else z for z in (x / d, y / d))
            j, i = math.floor(x), math.floor(y)
            fx, fy = x - j, y - i
            for c in range(pixels.shape[2]):
                top = at(i, j, c) * (1 - fx) + at(i, j + 1, c) * fx
                below = at(i + 1, j, c) * (1 - fx) + at(i + 1, j + 1, c) * fx
                out[v, u, c] = np.rint(top * (1 - fy) + below * fy)
    return out


def test_warp_equals_single_pixels(monkeypatch):
    pixels = picture(2, 60, 80)
    for poly in ([10, 10, 60, 5, 70, 45, 5, 50], [-12, 20, 40, -9, 62, 30, 15, 70], [10, 10, 40, 10, 40, 30, 10, 30], [20, 5, 60, 35, 45, 55, 5, 25]):
        q = rasters.quad(poly)
        expected = plain_warp(pixels, q["m"], q["width"], q["height"])
        for block in (1 << 20, 100):
            monkeypatch.setattr(rasters, "BLOCK_PIXELS", block)
            found = rasters.warped(pixels, q["m"], q["width"], q["height"]).astype(int)
            assert np.abs(found - expected).max() <= 1 and (found == expected).mean() > 0.999


def test_regions_and_boxes():
    pixels = picture(3, 20, 30)
    assert (rasters.region(pixels, [2, 3, 12, 9]) == pixels[3:9, 2:12]).all()
    assert (rasters.region(pixels, [-5, 3, 12, 3, 12, 99]) == pixels[3:20, 0:12]).all()
    for none in (None, [], [1, 2, 3], [1, 2, 3, 4, 5], [5, 5, 5, 9], [40, 3, 50, 9], [math.inf] * 4):
        assert rasters.region(pixels, none) is None
    assert (rasters.cut(pixels, [3, 4, 10, 9]) == pixels[4:9, 3:10]).all()
    assert rasters.cut(pixels, [300, 400, 310, 409]) is None and rasters.cut(pixels, [0, 0, 10**7, 0, 10**7, 10**7, 0, 10**7]) is None


def test_crops_of_pages(spark):
    pages = {"a": picture(4, 50, 60), "b": picture(5, 40, 40)}
    pictures = spark.createDataFrame([(f, rasters.encode(p)) for f, p in pages.items()] + [("c", b"no picture")], "file string, content binary")
    rows = [("a", i, [5.0 + i % 7, 6.0, 45.0, 6.0, 45.0, 30.0, 5.0 + i % 7, 30.0]) for i in range(150)]
    rows += [("b", 0, [0.0, 0.0, 9.0, 9.0]), ("b", 1, None), ("b", 2, [1.0]), ("c", 0, rows[0][2]), ("d", 0, rows[0][2])]
    regions = spark.createDataFrame(rows, "file string, pos int, poly array<double>")
    found = {(r["file"], r["pos"]): r for r in crops.crops(pictures, regions).collect()}
    assert len(found) == len(rows)
    for f, i, poly in rows:
        r = found[f, i]
        part = rasters.cut(pages[f], poly) if f in pages else None
        assert r["error"] == ({"c": "IMG_LOAD_FAILED", "d": "IMG_NOT_FOUND"}.get(f, "CROP_EMPTY") if part is None else None)
        if part is not None:
            assert (r["width"], r["height"]) == part.shape[1::-1] and (rasters.decode(r["content"]) == part).all()
    assert crops.crops(pictures, regions.limit(0)).count() == 0
    boxes = crops.crops(pictures, regions, cut=rasters.region).filter("file = 'b' AND pos = 0").first()
    assert (boxes["width"], boxes["height"]) == (9, 9)


def test_training_files(spark, tmp_path):
    page = picture(6, 100, 400)
    pictures = spark.createDataFrame([("p.json", rasters.encode(page))], "file string, content binary")
    line = lambda y: [10.0, y, 200.0, y, 200.0, y + 20.0, 10.0, y + 20.0]
    rows = [("p.json", i, "title", f" text\n{i} ", line(float(i))) for i in range(10)]
    rows += [("p.json", 20, "figure", "x", line(1.0)), ("p.json", 21, "title", " \n", line(1.0)), ("p.json", 22, "title", "x", [0.0, 0.0, 30.0, 0.0, 30.0, 20.0, 0.0, 20.0]), ("q.json", 0, "title", "x", line(1.0))]
    ann = spark.createDataFrame(rows, "file string, pos int, category string, text string, poly array<double>")
    skipped = crops.write_training_set(crops.training_crops(ann, pictures), f"file://{tmp_path}/set")
    assert {r["reason"]: r["n"] for r in skipped.collect()} == {"CAT_EXCLUDED(figure)": 1, "TEXT_EMPTY": 1, "LOW_ASPECT": 1, "IMG_NOT_FOUND": 1}
    lines = lambda name: sorted(x for p in (tmp_path / "set" / name).glob("part-*") for x in p.read_text().splitlines())
    assert lines("labels") == [f"images/{i + 1:07d}.png\ttext {i}" for i in range(10)]
    assert len(lines("train")) == 8 and sorted(lines("train") + lines("val")) == lines("labels")
    for i in range(10):
        found = rasters.decode((tmp_path / f"set/images/{i + 1:07d}.png").read_bytes())
        assert (found == rasters.cut(page, line(float(i)))).all()


def test_crops_of_canvases(spark, sf_dir, tmp_path):
    """The query's rows on a few pages against the canvas drawn and cut again, block by block."""
    from pyspark.sql import functions as F

    from quire.functions import geometry

    spark.createDataFrame([(i, "t") for i in range(30, 60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["file"], r["pos"]): r for r in queries.QUERIES["g9_crops"](spark, str(tmp_path)).collect()}
    blocks = queries.ann(spark, str(tmp_path)).collect()
    canvases = {r["file"]: r["pixels"] for r in geometry.layout_canvas(queries.ann(spark, str(tmp_path)), F.lit(None).cast("double"), F.lit(0.0)).collect()}
    assert len(found) == len(blocks) == 30
    import hashlib

    for b in blocks:
        x, y = b["x1"], b["y1"]
        poly = b["poly"] if b["pos"] % 2 == 0 else [x, y, x + 60, y + 80, x - 20, y + 140, x - 80, y + 60]
        part = rasters.cut(np.frombuffer(canvases[b["file"]], np.uint8).reshape(512, 512, 3), poly)
        r = found[b["file"], b["pos"]]
        assert r["sha256"] == (None if part is None else hashlib.sha256(part.tobytes()).hexdigest()) and (r["error"] is None) == (part is not None)


def test_layout_pictures_are_small_and_draw_the_canvas(spark, sf_dir):
    """Lists of boxes move in place of 786,432 bytes a page, and give the same pixels."""
    from pyspark.sql import functions as F

    from quire.functions import geometry

    a, size = queries.ann(spark, sf_dir), (F.lit(None).cast("double"), F.lit(0.0))
    pictures = {r["file"]: r["content"] for r in crops.layout_pictures(a, *size).collect()}
    canvases = {r["file"]: r["pixels"] for r in geometry.layout_canvas(a, *size).collect()}
    assert pictures.keys() == canvases.keys() and len(pictures) > 10
    for file, content in pictures.items():
        assert len(content) < 2000
        assert crops.layout_pixels(content).tobytes() == canvases[file]


def test_flat_and_mixed_pixels_are_sampled_alike():
    """A picture of flat areas and noise against four weighted pixels at every place."""
    rng = np.random.default_rng(3)
    pixels = np.full((40, 50, 3), 200, np.uint8)
    pixels[10:30, 5:25] = (10, 20, 30)
    pixels[:, 40:] = rng.integers(0, 256, (40, 10, 3))
    x, y = rasters._placed(rng.uniform(-4, 54, (30, 30)), 50), rasters._placed(rng.uniform(-4, 44, (30, 30)), 40)
    found = rasters._sampled(pixels, x, y)
    at = lambda i, j: pixels[i, j] if 0 <= i < 40 and 0 <= j < 50 else np.zeros(3)
    for i, j in np.ndindex(x.shape):
        left, top = int(np.floor(x[i, j])), int(np.floor(y[i, j]))
        u, v = x[i, j] - left, y[i, j] - top
        mean = (1 - u) * (1 - v) * at(top, left) + (1 - u) * v * at(top + 1, left) + u * (1 - v) * at(top, left + 1) + u * v * at(top + 1, left + 1)
        assert np.abs(found[i, j] - mean).max() <= 0.5 + 1e-9
