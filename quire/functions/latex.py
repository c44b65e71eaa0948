"""Checks of formulas in text and of formula fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import formula_parser
from quire.functions.text import col_of, is_blank
from quire.plans.rules import INLINE_PATTERNS, KNOWN_MACROS

# Formulas between two dollars (over lines) and between one (on a line).
DISPLAY = r"(?<!\\)\$\$(.+?)(?<!\\)\$\$"
INLINE = r"(?<!\\)\$(.+?)(?<!\\)\$"


def formulas(text: Column | str) -> Column:
    """All display formulas, then all inline ones; a display formula is met by both."""
    t = F.coalesce(col_of(text), F.lit(""))
    return F.concat(F.regexp_extract_all(t, F.lit(f"(?s){DISPLAY}"), 1), F.regexp_extract_all(t, F.lit(INLINE), 1))


_SPANS = T.ArrayType(T.StructType([T.StructField("formula", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def formula_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Formulas with their places in the text."""
    for batch in texts:
        yield batch.map(
            lambda t: [
                {"formula": m[1], "start": m.start(1), "end": m.end(1)}
                for pattern in (re.compile(DISPLAY, re.S), re.compile(INLINE))
                for m in pattern.finditer(t or "")
            ]
        )


def snippet(text: Column | str, start: Column, end: Column, around: int = 40) -> Column:
    """What stands around a place of the text."""
    lo = F.greatest(F.lit(0), start - around)
    return F.substring(col_of(text), lo + 1, end + around - lo)


def unmatched(formula: Column | str, opening: str, closing: str) -> Column:
    """struct(closers, openers): closing signs without an opening one, and opening ones left open."""
    signs = F.split(F.regexp_replace(col_of(formula), f"[^\\{opening}\\{closing}]", ""), "")
    start = F.struct(F.lit(0).alias("closers"), F.lit(0).alias("openers"))

    def step(s: Column, c: Column) -> Column:
        lone = (c == closing) & (s["openers"] == 0)
        return F.struct(
            (s["closers"] + lone.cast("int")).alias("closers"),
            (s["openers"] + (c == opening).cast("int") - ((c == closing) & ~lone).cast("int")).alias("openers"),
        )

    return F.aggregate(signs, start, step)


def unknown_macros(formula: Column | str) -> Column:
    found = F.regexp_extract_all(col_of(formula), F.lit(r"\\([A-Za-z]+)"), 1)
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, dict.fromkeys(KNOWN_MACROS)))))


@F.pandas_udf(T.StringType())
def _fault(formulas_: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in formulas_:
        found = [formula_parser.fault(f) if f else None for f in batch]
        yield pd.Series([f and f"{f[1]} at {f[0]}" for f in found], dtype=object)


def parse_fault(formula: Column | str) -> Column:
    """What a formula does not parse for, and its place in it; null if it parses.

    Only formulas with a brace or macro can fail, so only those leave the JVM.
    """
    f = col_of(formula)
    return _fault(F.when(f.rlike(r"[{}\\]"), f))


def needs_check(category: Column, latex: Column, text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (category == "equation_isolated") | (F.length(F.coalesce(latex, F.lit(""))) > 0) | F.contains(t, F.lit("$")) | F.contains(t, F.lit("\\"))


def violations(formulas_of: DataFrame, formula: str = "formula") -> DataFrame:
    """*formulas_of* with rule_id, severity and detail of each finding, one row each.

    An empty formula has that finding alone.  Each unmatched closing sign is a
    finding, all opening ones left open are one.  A formula that does not parse
    is an error that states the fault; in others unknown macros are a warning,
    wherever they stand, also inside arguments.
    """
    formulas_of = formulas_of.withColumn("__fault", parse_fault(formula))
    f = F.col(formula)
    braces, brackets = unmatched(f, "{", "}"), unmatched(f, "[", "]")
    mixed = F.contains(f, F.lit("$$")) & F.contains(F.replace(f, F.lit("$$"), F.lit("")), F.lit("$"))
    unknown = F.array_join(unknown_macros(f), ", ")

    def one(rule: str, severity: str, when: Column, detail: Column | None = None) -> Column:
        return F.when(when, F.array(_finding(rule, severity, detail))).otherwise(F.array().cast(_FINDINGS))

    def many(rule: str, n: Column) -> Column:
        return F.when(n > 0, F.array_repeat(_finding(rule, "ERROR"), n)).otherwise(F.array().cast(_FINDINGS))

    checks = F.concat(
        one("latex_mixed_delimiters", "ERROR", mixed),
        many("latex_unmatched_braces", braces["closers"] + (braces["openers"] > 0).cast("int")),
        many("latex_unmatched_brackets", brackets["closers"] + (brackets["openers"] > 0).cast("int")),
        one("latex_invalid_command", "ERROR", F.col("__fault").isNotNull(), F.col("__fault")),
        one("latex_invalid_command", "WARNING", F.col("__fault").isNull() & (F.length(unknown) > 0), unknown),
    )
    found = F.when(is_blank(f), F.array(_finding("latex_empty_formula", "ERROR"))).otherwise(checks)
    return formulas_of.withColumn("__f", F.explode(found)).drop("__fault").select(*[c for c in formulas_of.columns if c != "__fault"], "__f.rule_id", "__f.severity", "__f.detail")


_FINDINGS = "array<struct<rule_id: string, severity: string, detail: string>>"


def _finding(rule: str, severity: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def missing_markup(text: Column | str) -> Column:
    """struct(matched, reason) of the first pattern that hits outside formulas, else null."""
    clean = F.regexp_replace(col_of(text), r"\$.*?\$", " ")
    hits = [F.when(clean.rlike(p), F.struct(F.regexp_extract(clean, p, 0).alias("matched"), F.lit(why).alias("reason"))) for p, why in INLINE_PATTERNS]
    return F.coalesce(*hits)


def badge(found: DataFrame, keys: list[str]) -> DataFrame:
    """red, yellow or green of each key by its worst formula finding (rule_id, severity)."""
    rank = F.when(F.startswith("rule_id", F.lit("latex_")), F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARNING", 1)).otherwise(0)
    worst = F.coalesce(F.max(rank), F.lit(0))
    return found.groupBy(*keys).agg(F.when(worst == 2, "red").when(worst == 1, "yellow").otherwise("green").alias("badge"))
