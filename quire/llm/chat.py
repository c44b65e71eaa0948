"""Chat formatting: collapse of cumulative snapshots, then rendering.

Services log a conversation again after each turn, so most logged conversations
are prefixes of longer ones.  A rolling hash of each turn prefix identifies
them; an anti-join keeps the maximal conversations, and only those are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One rendered turn.
TURN = ("<|im_start|>", "\n", "<|im_end|>\n")
#: What stands for ``<|`` in a text or role, so that none holds a marker: one backslash
#: more between the two.
_OPENING = r"<(\\*)\|"


def _plain(c: str) -> Column:
    return F.regexp_replace(c, _OPENING, r"<\\$1|")


def _role() -> Column:
    """The role on one line."""
    return F.replace(F.replace(_plain("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _clean(turns: DataFrame) -> DataFrame:
    """The four columns; a null text is an empty one, a null role is ``unknown``."""
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, pos (from 1), two 64-bit hashes of the prefix
    that ends there, and whether it is the conversation's last turn.

    Turns are ordered by turn number (null first), then role, then md5 of the
    text, so ties and repeated rows have a fixed order; repeated rows are turns
    of their own.  Only hashes are shuffled, never texts.
    """
    hashed = _clean(turns).select(
        "conv_id",
        "turn",
        "role",
        F.md5("text").alias("m"),
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit(1), "text", "role").alias("b"),
    )
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "m")
    placed = hashed.select("conv_id", "turn", "role", "m", "a", "b", F.row_number().over(w).alias("pos"))
    rolling = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv_id",
        "pos",
        F.bit_xor(F.xxhash64("a", "b", "pos")).over(rolling).alias("h1"),
        F.bit_xor(F.xxhash64("pos", "b", "a", F.lit(7))).over(rolling).alias("h2"),
        F.lead("pos").over(w).isNull().alias("is_last"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of each maximal conversation.

    A conversation that equals a proper prefix of another goes.  Of equal
    conversations the one with the least conv_id stays (null is least) and
    ``n_copies`` counts them.  An empty table gives no rows.
    """
    prefixes = turn_prefixes(turns)
    least = F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), F.col("conv_id")))
    whole = (
        prefixes.filter("is_last")
        .groupBy(F.col("pos"), "h1", "h2")
        .agg(least.alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    proper = prefixes.filter("NOT is_last").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies"
    )


def render(turns: DataFrame) -> DataFrame:
    """The maximal conversations in chat markup: conv_id, n_turns, n_copies, rendered.

    A text that holds ``<|`` gets a backslash between the two signs (one more
    where it has some), a role's line ends and backslashes are escaped, so no
    two conversations are rendered alike.  Nulls, ties, repeated rows and empty
    tables: see the functions above.  Texts are rendered whole, however long; a
    conversation is one row and must fit into one, as its turns meet there.
    Further columns of *turns* are ignored.
    """
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "kept_id")
    texts = _clean(turns).join(kept.select("kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    piece = F.concat(F.lit(TURN[0]), _role(), F.lit(TURN[1]), _plain("text"), F.lit(TURN[2]))
    ordered = F.array_sort(
        F.collect_list(F.struct(F.col("turn").isNotNull().alias("k"), "turn", "role", F.md5("text").alias("m"), piece.alias("piece")))
    )
    rendered = texts.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("rendered"))
    return rendered.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select(
        "conv_id", "n_turns", "n_copies", "rendered"
    )


#: The query on ``conversations``, for DuckDB.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id,
         list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, md5(text)) AS turns,
         string_agg('<|im_start|>' || replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') || chr(10)
                    || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role, md5(text)) AS rendered
  FROM t GROUP BY conv_id
), u AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM c GROUP BY turns
), p AS (
  SELECT DISTINCT turns[1:k] AS head FROM u, generate_series(1, len(turns) - 1) AS s(k)
)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, rendered
FROM u WHERE turns NOT IN (SELECT head FROM p)
"""
