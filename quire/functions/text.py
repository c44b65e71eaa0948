"""Text predicates, similarity and clean-up as columns."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col_of(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    return F.length(strip(c)) == 0


def shortened(c: Column | str, n: int) -> Column:
    c = col_of(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def contains_ci(c: Column | str, query: str) -> Column:
    return F.contains(F.lower(col_of(c)), F.lit(query.lower()))


def search(df: DataFrame, text: str, query: str, shown: int = 200) -> DataFrame:
    """Rows whose text has the query, in any case, with the text cut to *shown*; an empty query finds nothing."""
    if not query:
        return df.limit(0)
    return df.filter(contains_ci(text, query)).withColumn(text, shortened(text, shown))


def safe_name(c: Column | str) -> Column:
    """A name that may be part of a path."""
    return F.regexp_replace(col_of(c), r"(?U)[^\w\-_\. ]", "_")


def page_number(file: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col_of(file), r"_page_(\d+)\.json$", 1), F.lit("")).cast("int")


def rgb(hex_color: Column | str) -> Column:
    part = lambda i: F.conv(F.substring(F.ltrim(col_of(hex_color), F.lit("#")), 1 + 2 * i, 2), 16, 10).cast("int")
    return F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def type_by_first_token(file: Column | str, known: list[str], fallback: str = "DEFAULT") -> Column:
    """Document type by the name's first part, for rule lookup."""
    code = F.upper(F.split_part(_base(file), F.lit("_"), F.lit(1)))
    return F.when(code.isin(known), code).otherwise(fallback)


def type_by_two_letters(file: Column | str, known: list[str], fallback: str = "ETC") -> Column:
    """Document type by the name's first two letters, for sampling."""
    code = F.upper(F.substring(_base(file), 1, 2))
    return F.when(code.isin(known), code).otherwise(fallback)


def type_by_prefix(file: Column | str) -> Column:
    """Document type for cluster statistics: what stands before the first underscore."""
    return F.when(F.contains(col_of(file), F.lit("_")), F.split_part(_base(file), F.lit("_"), F.lit(1))).otherwise("UNKNOWN")


def _base(file: Column | str) -> Column:
    return F.element_at(F.split(col_of(file), "/"), -1)


def _run(a: str, b: str, i: int, j: int) -> int:
    """How many letters from a[i] and b[j] on agree: strides double while they do, then halve."""
    start, step = i, 8
    while (part := a[i : i + step]) and part == b[j : j + step]:
        i, j, step = i + len(part), j + len(part), 2 * step
    while step > 1:
        step //= 2
        if (part := a[i : i + step]) and part == b[j : j + step]:
            i, j = i + len(part), j + len(part)
    return i - start


def _differences(a: str, b: str, most: int, replacing: bool) -> int | None:
    """Letters to insert, delete and (if *replacing*) replace to make *b* of *a*; None if there are more than *most*.

    For each number of differences the furthest place that each diagonal (place
    in a less place in b) can reach is kept, so the cost grows with the
    differences, not with the letters.
    """
    goal = len(a) - len(b)
    if abs(goal) > most:
        return None
    reach = {0: _run(a, b, 0, 0)}
    for n in range(most + 1):
        if reach.get(goal, -1) >= len(a):
            return n
        after: dict[int, int] = {}
        left = most - n - 1
        for k in range(max(-n - 1, goal - left), min(n + 1, goal + left) + 1):
            i = max(reach.get(k - 1, -2) + 1, reach.get(k + 1, -1), reach.get(k, -2) + 1 if replacing else -1)
            i = min(i, len(a), len(b) + k)
            if i >= max(0, k):
                after[k] = i + _run(a, b, i, i - k)
        reach = after
    return None


def _worth(a: str, b: str) -> int:
    """Differences up to which diagonals are cheaper than ``len(b)`` steps on numbers of ``len(a)`` bits."""
    return math.isqrt(len(b) * (4 + len(a) // 4096)) // 4


def _apart(a: str, b: str) -> int:
    """Differences that there are at least, from how often letters occur."""
    have, want = Counter(a), Counter(b)
    return max((have - want).total(), (want - have).total())


def _trimmed(a: str, b: str) -> tuple[str, str, int]:
    """Both texts without the beginning and the end that they share, and its length."""
    head = _run(a, b, 0, 0)
    a, b = a[head:], b[head:]
    tail = _run(a[::-1], b[::-1], 0, 0)
    return a[: len(a) - tail], b[: len(b) - tail], head + tail


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: by the differences if they are few, else by bit-parallel steps."""
    a, b, shared = _trimmed(a, b)
    if not a or not b:
        return shared
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    most = _worth(a, b)
    if _apart(a, b) <= most and (n := _differences(a, b, most, False)) is not None:
        return shared + (len(a) + len(b) - n) // 2
    places = _places(a, b)
    row = full = (1 << len(a)) - 1
    hits = [hit for ch in b if (hit := places.get(ch))]
    for at in range(0, len(hits), 512):
        # what is carried beyond the last bit grows by a bit a step and touches no other
        for hit in hits[at : at + 512]:
            hit = hit & row
            row = row + hit | row ^ hit
        row &= full
    return shared + len(a) - row.bit_count()


def _places(a: str, b: str) -> dict[str, int]:
    """For each letter of *b* that *a* has, a number whose bits are its places in *a*."""
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    both = set(a).intersection(b)
    return {ch: int.from_bytes(np.packbits(codes == ord(ch), bitorder="little").tobytes(), "little") for ch in both}


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty texts."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def ratio_as_given(a: Column | str, b: Column | str) -> Column:
    """The ratio of both texts with their outer white space; 0 without a first text."""
    return _ratio(col_of(a), F.coalesce(col_of(b), F.lit("")))


@F.pandas_udf(T.DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([ratio(a, b) if a else 0.0 for a, b in zip(left, right, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([ratio(a.strip(), b.strip()) if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype=float)


def similarity(a: Column | str, b: Column | str) -> Column:
    """0 if either text is null or empty, else the ratio of both without outer white space."""
    return _similarity(col_of(a), col_of(b))


def band(score: Column | str) -> Column:
    s = col_of(score)
    return F.when(s >= 0.9, "Pass").when(s >= 0.5, "Warning").otherwise("Fail")


def edits(a: str, b: str) -> int:
    """Edit distance: by the differences if they are few, else by bit-parallel steps.

    In the latter the differences of a column's cells are the bits of two
    numbers; of the last column their sum is the distance less the top cell.
    """
    a, b, _ = _trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    most = _worth(a, b)
    if _apart(a, b) <= most and (n := _differences(a, b, most, True)) is not None:
        return n
    places = _places(a, b)
    up = full = (1 << len(a)) - 1
    down = 0
    for ch in b:
        same = places.get(ch, 0)
        diagonal = (((same & up) + up ^ up) | same | down) & full
        rises = (down | full ^ (diagonal | up)) << 1 | 1
        # a bit beyond the last one is cut off
        up, down = ((up & diagonal) << 1 | full ^ (diagonal | rises)) & full, rises & diagonal
    return len(b) + up.bit_count() - down.bit_count()


@F.pandas_udf(T.DoubleType())
def _error_rate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        pairs = (((a or "").replace(" ", ""), (b or "").replace(" ", "")) for a, b in zip(left, right, strict=True))
        yield pd.Series([edits(a, b) / len(a) if a else float(bool(b)) for a, b in pairs], dtype=float)


def character_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edit distance over the reference's length, blanks left out; for an empty reference 0 or 1.

    Texts may be long: like ones cost by their differences, unlike ones a step
    for each character of one on all bits of the other.
    """
    return _error_rate(col_of(reference), col_of(hypothesis))


def flattened(c: Column | str) -> Column:
    """On one line, without outer white space."""
    return strip(F.translate(col_of(c), "\n\r", "  "))


def preview(c: Column | str, n: int = 100) -> Column:
    return shortened(F.translate(col_of(c), "\n", " "), n)


def badge_preview(html: Column | str) -> Column:
    """Images that stand for annotations as visible badges."""
    return F.regexp_replace(col_of(html), r"""(?i)<img[^>]*src\s*=\s*["']?anno_id_(\d+)["']?[^>]*>""", '<span class="badge">ID $1</span>')


def without_dollars(latex: Column | str) -> Column:
    return strip(F.replace(col_of(latex), F.lit("$$"), F.lit("")))


@F.pandas_udf(T.StringType())
def character_name(c: pd.Series) -> pd.Series:
    return c.map(lambda x: f"U+{ord(x):04X} ({unicodedata.name(x, 'UNKNOWN')})" if x else None)


def code_label(c: Column | str) -> Column:
    """U+XXXX of the first character."""
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(col_of(c))), 4, "0"))
