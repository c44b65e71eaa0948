"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote for or against a document or abstain.  Expectation-maximisation over
the counted vote patterns estimates how accurate each rule is; the posterior
probability of quality replaces "all rules must pass".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import staged

_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
EM_ROUNDS = 25
START_PRIOR = 0.9
#: An accuracy at the start: votes for quality on good rows, votes against on bad ones.
START_GOOD, START_BAD = 0.9, 0.6
#: The start values weigh as much as so many rows.
SMOOTHING = 2.0
PRIOR, GOOD, BAD = (0.05, 0.99), (0.55, 0.9999), (0.02, 0.98)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(ws: Column) -> Column:
    """Words in three-word windows that the text holds twice or more."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3),
        lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)),
    )

    def repeated(pairs: Column) -> Column:
        same = lambda a, b: F.get(pairs, a)["h"] == F.get(pairs, b)["h"]
        places = F.transform(
            F.filter(pairs, lambda p, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
            lambda p: p["i"],
        )
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(ordered, repeated))

    return F.when(F.size(ws) < 3, 0).otherwise(_let(windows, covered))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of each whole text; a null text has no words.

    One row for each row of *docs*; repeated rows are repeated, and further
    columns are left out.
    """
    lines = F.filter(F.split("body", "\n", -1), lambda x: x.rlike(_WORD))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    by_words = _let(
        F.regexp_extract_all("body", F.lit(_WORD), 0),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        ),
    )
    by_lines = _let(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")
        ),
    )
    symbols = F.length("body") - F.length(F.regexp_replace("body", _SYMBOL, ""))
    ends = F.regexp_count("body", F.lit(_SYMBOL + r"(?![^\x20\x09-\x0D])"))
    return texts.select(
        "doc_id", by_words.alias("f"), by_lines.alias("g"), symbols.cast("long").alias("n_symbols"), ends.cast("long").alias("n_symbol_ends")
    ).select(
        "doc_id", "f.n_words", "f.word_chars", "n_symbols", "g.n_dup_lines", "f.n_repeat_words", "g.n_lines", "f.n_letter_words", "n_symbol_ends"
    )


def rules() -> dict[str, Column]:
    """Votes on the figures: 1 for quality, -1 against it, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    def at_most(share: Column, good: float, bad: float) -> Column:
        return vote(share <= good, share > bad)

    per_word = F.col("word_chars") / n
    letters = F.col("n_letter_words") / n
    return {
        "long_enough": vote(n >= 80, F.col("n_words") < 50),
        "word_length": vote((per_word >= 3.5) & (per_word <= 7), (per_word < 3) | (per_word > 10)),
        "few_symbols": at_most(F.col("n_symbols") / n, 0.02, 0.1),
        "few_symbol_ends": at_most(F.col("n_symbol_ends") / n, 0.01, 0.1),
        "letter_words": vote(letters >= 0.95, letters < 0.8),
        "few_repeats": at_most(F.col("n_repeat_words") / n, 0.2, 0.5),
        "few_dup_lines": at_most(F.col("n_dup_lines") / lines, 0.1, 0.3),
        "line_length": vote(n / lines >= 8, n / lines < 3),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _posterior(votes: list[Column], prior: Column, good: list[Column], bad: list[Column]) -> Column:
    """Probability of quality, given each rule's accuracy on good and on bad rows."""
    total = F.log(prior / (1 - prior))
    for v, g, b in zip(votes, good, bad, strict=True):
        total += F.when(v == 1, F.log(g / (1 - b))).when(v == -1, F.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def estimate(voted: DataFrame, names: list[str], rounds: int = EM_ROUNDS) -> tuple[float, list[float], list[float]]:
    """(prior, each rule's accuracy on good rows, on bad rows) by
    expectation-maximisation over all rows.

    Rows are counted by vote pattern first: at most 3 ** len(names) patterns,
    whatever the input's size, meet in one row, and one expression runs the
    rounds.  Counts are smoothed by the start values, so those hold without
    rows and for a rule that never votes.
    """
    patterns = voted.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n"))
    gathered = patterns.agg(F.collect_list(F.struct(F.array(*names).alias("v"), "n")).alias("ps"))
    k = range(len(names))

    def share(ps: Column, of: Callable[[Column], Column], among: Callable[[Column], Column], start: float, bounds: tuple) -> Column:
        total = lambda f: F.aggregate(ps, F.lit(0.0), lambda a, p: a + f(p))
        raw = (total(of) + SMOOTHING * start) / (total(among) + SMOOTHING)
        return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), raw))

    def maximised(ps: Column) -> Column:
        is_good, is_bad = (lambda p: p["n"] * p["g"]), (lambda p: p["n"] * (1 - p["g"]))

        def accuracy(j: int, weight: Callable, vote: int, start: float, bounds: tuple) -> Column:
            when = lambda test: lambda p: F.when(test(p["v"][j]), weight(p)).otherwise(0.0)
            return share(ps, when(lambda v: v == vote), when(lambda v: v != 0), start, bounds)

        return F.struct(
            share(ps, is_good, lambda p: p["n"], START_PRIOR, PRIOR).alias("prior"),
            F.array(*(accuracy(j, is_good, 1, START_GOOD, GOOD) for j in k)).alias("good"),
            F.array(*(accuracy(j, is_bad, -1, START_BAD, BAD) for j in k)).alias("bad"),
        )

    def turned(m: Column) -> Column:
        """No rule's vote may count for the opposite of what it says."""
        bad = F.array(*(F.greatest(m["bad"][j], 1.01 - m["good"][j]) for j in k))
        return F.struct(m["prior"].alias("prior"), m["good"].alias("good"), bad.alias("bad"))

    def step(state: Column, _: Column) -> Column:
        def scored(p: Column) -> Column:
            g = _posterior([p["v"][j] for j in k], state["prior"], [state["good"][j] for j in k], [state["bad"][j] for j in k])
            return F.struct(p["v"].alias("v"), p["n"].alias("n"), g.alias("g"))

        return _let(_let(F.transform(F.col("ps"), scored), maximised), turned)

    start = F.struct(
        F.lit(START_PRIOR).alias("prior"), F.array(*[F.lit(START_GOOD) for _ in k]).alias("good"), F.array(*[F.lit(START_BAD) for _ in k]).alias("bad")
    )
    m = gathered.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).first()["m"]
    return m["prior"], list(m["good"]), list(m["bad"])


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: the base figures, base_failed, the votes' posterior, kept.

    ``kept`` is false where the base rules fail, else whether the posterior
    reaches *threshold*.  Null, empty and very long texts: see ``features``;
    an empty table gives no rows.  Texts are read once: the figures, a few
    numbers per document, are staged in the shared folder.
    """
    figures = staged(features(docs), "quality")
    ballot = rules()
    names = list(ballot)
    voted = figures.select("*", *(c.alias(f"vote_{k}") for k, c in ballot.items()))
    votes = [f"vote_{k}" for k in names]
    prior, good, bad = estimate(voted, votes)
    posterior = _posterior([F.col(v) for v in votes], F.lit(prior), [F.lit(x) for x in good], [F.lit(x) for x in bad])
    judged = voted.withColumn("base_failed", base_failed()).withColumn("posterior", posterior)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


#: The query on ``documents``, for DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 2], ' ') AS phrase FROM d, generate_series(1, len(ws) - 2) AS s(i)
), rep AS (
  SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, phrase) AS c FROM win) AS x, generate_series(i, i + 2) AS s(k) WHERE c > 1 GROUP BY rid
), f AS (
  SELECT doc_id, d.rid, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ws, lambda w: regexp_matches(w, '\p{L}'))) AS n_letter_words, len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&|<>]$'))) AS n_symbol_ends
  FROM d LEFT JOIN rep ON rep.rid = d.rid
), g AS (
  SELECT *, CAST(greatest(n_words, 1) AS DOUBLE) AS n, CAST(greatest(n_lines, 1) AS DOUBLE) AS l FROM f
), v AS (
  SELECT *, [
    CASE WHEN n_words < 50 THEN -1 WHEN n >= 80 THEN 1 ELSE 0 END,
    CASE WHEN word_chars / n < 3 OR word_chars / n > 10 THEN -1 WHEN word_chars / n >= 3.5 AND word_chars / n <= 7 THEN 1 ELSE 0 END,
    CASE WHEN n_symbols / n > 0.1 THEN -1 WHEN n_symbols / n <= 0.02 THEN 1 ELSE 0 END,
    CASE WHEN n_symbol_ends / n > 0.1 THEN -1 WHEN n_symbol_ends / n <= 0.01 THEN 1 ELSE 0 END,
    CASE WHEN n_letter_words / n < 0.8 THEN -1 WHEN n_letter_words / n >= 0.95 THEN 1 ELSE 0 END,
    CASE WHEN n_repeat_words / n > 0.5 THEN -1 WHEN n_repeat_words / n <= 0.2 THEN 1 ELSE 0 END,
    CASE WHEN n_dup_lines / l > 0.3 THEN -1 WHEN n_dup_lines / l <= 0.1 THEN 1 ELSE 0 END,
    CASE WHEN n / l < 3 THEN -1 WHEN n / l >= 8 THEN 1 ELSE 0 END] AS votes FROM g
), ps AS (
  SELECT list({'v': votes, 'n': c}) AS ps FROM (SELECT votes, CAST(count(*) AS DOUBLE) AS c FROM v GROUP BY votes)
), em(k, prior, good, bad) AS (
  SELECT 0, CAST(0.9 AS DOUBLE), list_transform(range(1, 9), lambda j: CAST(0.9 AS DOUBLE)), list_transform(range(1, 9), lambda j: CAST(0.6 AS DOUBLE))
  UNION ALL
  SELECT k + 1, prior2, good2, list_transform(range(1, 9), lambda j: greatest(bad2[j], 1.01 - good2[j])) FROM (
    SELECT k, least(0.99, greatest(0.05, (list_sum(list_transform(qs, lambda p: p.n * p.g)) + 2 * 0.9) / (list_sum(list_transform(qs, lambda p: p.n)) + 2))) AS prior2,
           list_transform(range(1, 9), lambda j: least(0.9999, greatest(0.55, (list_sum(list_transform(qs, lambda p: CASE WHEN p.v[j] = 1 THEN p.n * p.g ELSE 0.0 END)) + 2 * 0.9)
             / (list_sum(list_transform(qs, lambda p: CASE WHEN p.v[j] <> 0 THEN p.n * p.g ELSE 0.0 END)) + 2)))) AS good2,
           list_transform(range(1, 9), lambda j: least(0.98, greatest(0.02, (list_sum(list_transform(qs, lambda p: CASE WHEN p.v[j] = -1 THEN p.n * (1 - p.g) ELSE 0.0 END)) + 2 * 0.6)
             / (list_sum(list_transform(qs, lambda p: CASE WHEN p.v[j] <> 0 THEN p.n * (1 - p.g) ELSE 0.0 END)) + 2)))) AS bad2
    FROM (SELECT k, list_transform(ps, lambda p: {'v': p.v, 'n': p.n, 'g': 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 9), lambda j: 
            CASE p.v[j] WHEN 1 THEN ln(good[j] / (1 - bad[j])) WHEN -1 THEN ln((1 - good[j]) / bad[j]) ELSE 0.0 END)))))}) AS qs FROM em, ps WHERE k < 25) AS scored) AS next
), m AS (
  SELECT * FROM em WHERE k = 25
), j AS (
  SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 9), lambda i: 
    CASE votes[i] WHEN 1 THEN ln(good[i] / (1 - bad[i])) WHEN -1 THEN ln((1 - good[i]) / bad[i]) ELSE 0.0 END))))) AS posterior FROM v, m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, round(posterior, 6) AS posterior FROM j
"""
