"""Pictures as arrays of rows, columns and channels: reading, turning, cutting and straightening them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

#: Fixed value: a hull's corner nearer than this to the line past it is none.
CORNER = 3.0
#: Pixels of a crop at most; polygons of broken files may span any area.
MOST_PIXELS = 1 << 28
#: Pixels that are sampled at once, so few that their numbers stay in a core's cache.
BLOCK_PIXELS = 1 << 14
_PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of PNG colour types that have eight bits.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class Unreadable(ValueError):
    """Bytes that are no picture of a kind that is read here."""


def decode(data: bytes) -> np.ndarray:
    """Pixels of a PNG (8 bits, not interlaced) or a binary PNM, turned as its EXIF says.

    Other formats need a decoder of the caller's; they raise Unreadable.
    """
    data = bytes(data)
    try:
        if data.startswith(_PNG):
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            return _pnm(data)
    except (struct.error, zlib.error, IndexError, ValueError) as e:
        raise Unreadable(str(e)) from e
    raise Unreadable("neither PNG nor PNM")


def _pnm(data: bytes) -> np.ndarray:
    numbers, at = [], 2
    while len(numbers) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    width, height, most = numbers
    if most != 255:
        raise Unreadable("not of eight bits")
    channels = 1 if data[:2] == b"P5" else 3
    return np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, turn, head = 8, [], None, 1, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"eXIf":
            turn = orientation(body)
        at += 12 + size
    width, height, bits, colour, _, _, interlaced = head or (0, 0, 0, 9, 0, 0, 0)
    if bits != 8 or interlaced or colour not in _CHANNELS:
        raise Unreadable("a PNG of another kind than 8 bits, not interlaced")
    channels = _CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    pixels = np.zeros((height + 1, width, channels), np.uint8)
    for y, line in enumerate(lines):
        pixels[y + 1] = _unfiltered(line[0], line[1:].reshape(width, channels), pixels[y])
    pixels = pixels[1:]
    return turned(palette[pixels[:, :, 0]] if colour == 3 else pixels, turn)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + above
    out = [[0] * line.shape[1]]
    before = [0] * line.shape[1]
    for values, tops in zip(line.tolist(), above.tolist(), strict=True):
        left = out[-1]
        if kind == 3:
            guess = [(a + b) // 2 for a, b in zip(left, tops, strict=True)]
        else:
            guess = [_nearest(a, b, c) for a, b, c in zip(left, tops, before, strict=True)]
        out.append([(v + g) & 255 for v, g in zip(values, guess, strict=True)])
        before = tops
    return np.array(out[1:], np.uint8)


def _nearest(left: int, top: int, corner: int) -> int:
    """Of three neighbours the one nearest to left + top - corner."""
    to_left, to_top, to_corner = abs(top - corner), abs(left - corner), abs(left + top - 2 * corner)
    return left if to_left <= to_top and to_left <= to_corner else top if to_top <= to_corner else corner


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of one, three or four channels."""
    height, width, channels = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels).reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def orientation(exif: bytes) -> int:
    """The orientation, 1 to 8, that EXIF data (a TIFF header and its first directory) state; 1 without one."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 8:
        return 1
    (at,) = struct.unpack(f"{order}I", exif[4:8])
    (n,) = struct.unpack(f"{order}H", exif[at : at + 2]) if at + 2 <= len(exif) else (0,)
    for i in range(n):
        entry = exif[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack(f"{order}H", entry[:2])[0] == 0x0112:
            value = struct.unpack(f"{order}H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def turned(pixels: np.ndarray, to: int) -> np.ndarray:
    """Pixels as they are to be seen, for an EXIF orientation."""
    if to >= 5:
        pixels = pixels.transpose(1, 0, 2)
    if to in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if to in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of whole-numbered points, in turn from the least one; points on an edge are none."""
    found = sorted(set(map(tuple, points.tolist())))
    if len(found) < 3:
        return np.array(found).reshape(-1, 2)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for run in (found, found[::-1]):
        half: list[tuple] = []
        for p in run:
            while len(half) > 1 and cross(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves)


def simplified(ring: np.ndarray, within: float = CORNER) -> np.ndarray:
    """The corners of a closed line that are needed to stay *within* of it.

    The line is cut at two far points, each part keeps the point farthest from
    its chord as long as that is farther than *within*, and of what is left a
    corner nearly on the line between its neighbours goes.
    """
    n = len(ring)
    if n < 3:
        return ring
    far = 0
    for _ in range(3):
        start, far = far, int(((ring - ring[far]) ** 2).sum(axis=1).argmax())
    if ((ring[start] - ring[far]) ** 2).sum() <= within**2:
        return ring[[start]]
    kept, todo = {start, far}, [(start, far), (far, start)]
    while todo:
        a, b = todo.pop()
        inside = [(a + i) % n for i in range(1, (b - a) % n)]
        if not inside:
            continue
        away = _from_line(ring[inside], ring[a], ring[b])
        if away.max() > within:
            c = inside[int(away.argmax())]
            kept.add(c)
            todo += [(a, c), (c, b)]
    corners = sorted(kept)
    for c in list(corners):
        i = corners.index(c)
        if len(corners) > 2 and _from_line(ring[[c]], ring[corners[i - 1]], ring[corners[(i + 1) % len(corners)]])[0] <= within / 2**0.5:
            corners.pop(i)
    return ring[corners]


def _from_line(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    along = (b - a).astype(float)
    gap = points - a
    length = float(np.hypot(*along))
    return np.abs(gap[:, 1] * along[0] - gap[:, 0] * along[1]) / length if length else np.hypot(gap[:, 0], gap[:, 1])


def in_order(corners: np.ndarray) -> np.ndarray:
    """Four corners as upper left, upper right, lower right, lower left: by the least and greatest sum and difference."""
    total, across = corners.sum(axis=1), corners[:, 1] - corners[:, 0]
    return corners[[total.argmin(), across.argmin(), total.argmax(), across.argmax()]]


def quad(poly: Sequence[float] | None) -> dict | None:
    """What of a picture a polygon cuts out: kind ``quad`` or ``box``, corners, width, height, and the transform of a quad.

    Four or more points are rounded towards zero; if their simplified hull has
    four corners these are straightened to a rectangle as wide and high as the
    longer of two sides, else the box of the points is cut out.  One to three
    points give their box.  Odd or empty polygons, and what has no area, give
    None.  The transform's eight numbers take a point (x, y) of the picture to
    the crop: ((m0 x + m1 y + m2) / d, (m3 x + m4 y + m5) / d) with
    d = m6 x + m7 y + 1.
    """
    if poly is None or not len(poly) or len(poly) % 2 or not np.isfinite(np.asarray(poly, float)).all():
        return None
    points = np.trunc(np.asarray(poly, float)).astype(np.int64).reshape(-1, 2)
    if len(points) < 4:
        (x1, y1), (x2, y2) = points.min(axis=0).tolist(), points.max(axis=0).tolist()
        return _box(x1, y1, x2 - x1, y2 - y1)
    corners = simplified(hull(points))
    if len(corners) != 4:
        (x1, y1), (x2, y2) = points.min(axis=0).tolist(), points.max(axis=0).tolist()
        return _box(x1, y1, x2 - x1 + 1, y2 - y1 + 1)
    corners = in_order(corners).astype(float)
    tl, tr, br, bl = corners
    side = lambda a, b: float(np.hypot(*(a - b)))
    width, height = int(max(side(br, bl), side(tr, tl))), int(max(side(tr, br), side(tl, bl)))
    m = transform(corners, width, height) if width > 1 and height > 1 else None
    return None if m is None else {"kind": "quad", "corners": corners.ravel().tolist(), "width": width, "height": height, "m": m.tolist()}


def _box(x: int, y: int, width: int, height: int) -> dict | None:
    if width <= 0 or height <= 0:
        return None
    return {"kind": "box", "corners": [float(v) for v in (x, y, x + width, y, x + width, y + height, x, y + height)], "width": width, "height": height, "m": None}


def transform(corners: np.ndarray, width: int, height: int) -> np.ndarray | None:
    """Eight numbers that take four corners to those of a picture of *width* and *height*; None if none do."""
    to = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    rows, known = [], []
    for (x, y), (u, v) in zip(corners, to, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
        known += [u, v]
    try:
        m = np.linalg.solve(np.array(rows), np.array(known))
    except np.linalg.LinAlgError:
        return None
    return m + 0.0 if np.isfinite(m).all() else None


def warped(pixels: np.ndarray, m: Sequence[float], width: int, height: int) -> np.ndarray:
    """The crop whose points *m* takes from *pixels*, each the mean of the four pixels around it, zeros outside.

    Rows are sampled some at a time, so that a large crop needs little more than itself.
    """
    back = np.linalg.inv(np.append(np.asarray(m, float), 1.0).reshape(3, 3))
    out = np.empty((height, width, pixels.shape[2]), np.uint8)
    step = max(1, BLOCK_PIXELS // width)
    across = np.arange(width, dtype=float)
    for top in range(0, height, step):
        down = np.arange(top, min(top + step, height), dtype=float)[:, None]
        x, y, d = (back[i, 0] * across + back[i, 1] * down + back[i, 2] for i in range(3))
        # what a straight line would meet at infinity is outside
        if not (np.abs(d) > 1e-12).all():
            d = np.where(np.abs(d) > 1e-12, d, np.nan)
        out[top : top + step] = _sampled(pixels, _placed(x / d, pixels.shape[1]), _placed(y / d, pixels.shape[0]))
    return out


def _placed(v: np.ndarray, n: int) -> np.ndarray:
    """Places along a side of *n* pixels: what is far outside comes near, and whole numbers computed with an error of rounding stay whole."""
    v = np.where(np.isnan(v), -2.0, v).clip(-2, n + 1)
    near = np.rint(v)
    return np.where(np.abs(v - near) < 1e-9, near, v)


def _sampled(pixels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The mean of the four pixels around each place; where they are the same pixel four times, that one."""
    height, width, channels = pixels.shape
    left, top = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    x0, y0, x1, y1 = int(left.min()), int(top.min()), int(left.max()) + 2, int(top.max()) + 2
    # the pixels around all places, zeros beyond the picture
    part = np.zeros((y1 - y0, x1 - x0, channels), np.uint8)
    inside = pixels[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
    part[max(0, -y0) : max(0, -y0) + inside.shape[0], max(0, -x0) : max(0, -x0) + inside.shape[1]] = inside
    line = x1 - x0
    differ = np.zeros(part.shape[:2], bool)
    edge = (part[1:, :-1] != part[:-1, :-1]) | (part[:-1, 1:] != part[:-1, :-1]) | (part[1:, 1:] != part[:-1, :-1])
    differ[:-1, :-1] = edge.any(axis=2)
    flat, at = part.reshape(-1, channels), (top - y0) * line + (left - x0)
    out = flat.take(at, axis=0)
    mixed = np.nonzero(differ.ravel().take(at))
    if len(mixed[0]):
        x, y, at = x[mixed] - left[mixed], y[mixed] - top[mixed], at[mixed]
        total = np.zeros((len(at), channels))
        for dx, wx in ((0, 1 - x), (1, x)):
            for dy, wy in ((0, 1 - y), (1, y)):
                total += (wx * wy)[:, None] * flat.take(at + (dy * line + dx), axis=0)
        out[mixed] = np.rint(total).astype(np.uint8)
    return out


def cut(pixels: np.ndarray, poly: Sequence[float] | None) -> np.ndarray | None:
    """The crop of a polygon by ``quad``; None without one, outside the picture, or beyond MOST_PIXELS."""
    found = quad(poly)
    if found is None or found["width"] * found["height"] > MOST_PIXELS:
        return None
    if found["m"] is not None:
        return warped(pixels, found["m"], found["width"], found["height"])
    x, y = int(found["corners"][0]), int(found["corners"][1])
    part = pixels[max(0, y) : max(0, y + found["height"]), max(0, x) : max(0, x + found["width"])]
    return part if part.size else None


def region(pixels: np.ndarray, box: Sequence[float] | None) -> np.ndarray | None:
    """The upright box of four numbers (x1, y1, x2, y2) or of a polygon's points, kept inside the picture."""
    if box is None or len(box) != 4 and len(box) < 6 or not np.isfinite(np.asarray(box, float)).all():
        return None
    x1, y1, x2, y2 = box if len(box) == 4 else (min(box[::2]), min(box[1::2]), max(box[::2]), max(box[1::2]))
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(pixels.shape[1], x2), min(pixels.shape[0], y2)
    if x2 <= x1 or y2 <= y1:
        return None
    part = pixels[round(y1) : round(y2), round(x1) : round(x2)]
    return part if part.size else None
