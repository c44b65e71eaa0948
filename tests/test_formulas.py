import time

import pytest
from pyspark.sql import functions as F

from quire.functions import latex
from quire.functions.formula_parser import fault

FINE = [
    "", "x", "a + b", r"\frac{a}{b}", r"\frac12", r"\frac\alpha\beta", r"\sqrt[3]{x}", r"\sqrt x", r"\sqrt[\frac{1}{2}]{x}", r"\left( x \right)", r"\left\{ x \right.",
    r"\begin{a} x & y \\ z \end{a}", r"\begin{a}\begin{b}\end{b}\end{a}", r"\{ x", "[0, 1)", r"{\left( {a} \right)}", "a % { \n b", r"\frac{\sqrt{a}}{\frac{b}{c}}",
    r"\text {a}", r"\begin {a} x \end {a}", r"\overset{a}{b}", r"\frac{1}{2} \& \%", r"\left(\frac{a}{b}\right)^2", r"\foo \bar{x}", r"\frac\left(a\right)b",
]
FAULTY = [
    ("}", 0, "} without {"),
    ("a}", 1, "} without {"),
    ("a {b {c}", 2, "{ is not closed"),
    (r"\frac{a}", 0, r"\frac lacks an argument"),
    (r"{\frac a}b", 1, r"\frac lacks an argument"),
    (r"x \sqrt", 2, r"\sqrt lacks an argument"),
    (r"\sqrt[3", 5, "[ is not closed"),
    (r"\sqrt[3}]", 5, "[ is not closed"),
    (r"\sqrt[3]", 0, r"\sqrt lacks an argument"),
    (r"\begin{a} x", 0, r"\begin{a} is not closed"),
    (r"\begin{a} \end{b}", 0, r"\begin{a} is not closed"),
    (r"x \end{b}", 2, r"\end{b} without \begin{b}"),
    (r"\begin", 0, r"\begin lacks an argument"),
    (r"\left( x", 0, r"\left is not closed"),
    (r"x \right)", 2, r"\right without \left"),
    (r"{\left( x}", 1, r"\left is not closed"),
    (r"\left( {x \right)", 7, "{ is not closed"),
    (r"\left", 0, r"\left lacks a delimiter"),
    (r"\left( x \right", 9, r"\right lacks a delimiter"),
    (r"\begin{a} \frac{1} & 2 \end{a}", 10, r"\frac lacks an argument"),
    (r"\frac{1} \\ 2", 0, r"\frac lacks an argument"),
    ("a \\", 2, "\\ without a name"),
    ("% }\n}", 4, "} without {"),
]


def test_what_parses_and_what_does_not():
    for formula in FINE:
        assert fault(formula) is None, formula
    for formula, at, what in FAULTY:
        assert fault(formula) == (at, what), formula


def test_long_formulas_are_parsed_in_one_pass():
    started = time.perf_counter()
    n = 200_000
    assert fault("{" * n + "}" * n) is None and fault("{" * n) == (n - 1, "{ is not closed")
    assert fault(r"{\left(" * n) == (7 * n - 6, r"\left is not closed")
    assert fault(r"\begin{" * n) == (0, r"\begin lacks an argument") or fault(r"\begin{" * n)[1].endswith("closed")
    assert fault(r"\frac" * n) == (5 * n - 5, r"\frac lacks an argument")
    assert fault("x" * n + " " * n) is None
    assert time.perf_counter() - started < 20


def test_findings_of_formulas(spark):
    rows = [(i, f) for i, f in enumerate([r"\foo{x}", r"\foo \frac{1}", "a", "a}", " ", None, "", r"\begin{a} x"])]
    found = latex.violations(spark.createDataFrame(rows, "n int, formula string")).filter("rule_id = 'latex_invalid_command'")
    assert sorted((r["n"], r["severity"], r["detail"]) for r in found.collect()) == [
        (0, "WARNING", "foo"),
        (1, "ERROR", r"\frac lacks an argument at 5"),
        (3, "ERROR", "} without { at 1"),
        (7, "ERROR", r"\begin{a} is not closed at 0"),
    ]
    assert found.columns == ["n", "formula", "rule_id", "severity", "detail"]


@pytest.mark.parametrize("formula", ["a $ b", "x^2", "y"])
def test_plain_formulas_do_not_leave_the_jvm(spark, formula):
    df = spark.createDataFrame([(formula,)], "formula string")
    assert df.select(latex.parse_fault("formula").alias("f")).filter(F.col("f").isNotNull()).count() == 0


def test_needs_change_no_result():
    """Every rule's result on odd texts is the same when its search is never left out, and plain texts are hardly searched."""
    import random
    from dataclasses import replace

    from quire.functions import rewrite

    bare = lambda rules: [replace(r, needs=()) if isinstance(r, rewrite.Rule) else r for r in rules]
    signs = list("aAnNpPQIxk19 .:/$()<>@&-'=°") + ["씨", "사람", "과 ", "시리즈", "갤럭시 ", "제1호 I", "형", "명", "학생 ", "I. ", "p. 3", "<td>Q</td>", "http://", rewrite.MARK, "\n", "한"]
    rng = random.Random(7)
    for _ in range(4000):
        made = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        assert rewrite.variables(made) == rewrite.run(made, bare(rewrite._VARIABLES)), made
        assert rewrite.fractions(made) == rewrite.run(made, bare(rewrite._FRACTIONS)), made
    used = [r for r in rewrite._VARIABLES if not r.needs or any(n in "plain words, and more." for n in r.needs)]
    assert len(used) <= 10 < len(rewrite._VARIABLES)
