"""Preference formatting of chosen and rejected conversations, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHOSEN, REJECTED, PROMPT, UNPAIRED = "chosen", "rejected", "prompt", "unpaired"


def paired(turns: DataFrame) -> DataFrame:
    """Neighbouring conversations as pairs: 2k is chosen over 2k + 1.  Adds pair_id and side; a null conv_id has neither."""
    return turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"),
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, F.lit(CHOSEN)).when(F.col("conv_id").isNotNull(), F.lit(REJECTED)).alias("side"),
    )


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat template; a missing role is named unknown."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """Training segments of preference pairs: pair_id, part, turn, copy, role, segment, trained.

    ``turns`` has pair_id, side (chosen or rejected), turn, role, text.  The longest prefix of turns that both sides share, same
    number, role and text, comes out once with part ``prompt``; the other turns follow as part ``chosen`` and ``rejected``.
    Joined in order of (turn, copy), a pair's prompt and one of its other parts are one sample.  Only assistant turns of a
    completion are trained; prompt, system and user turns are masked.

    One row per turn, so neither a long conversation nor a common first turn meets in one task: turns are compared by (pair,
    turn), and only the first difference of a pair is carried back.  Rows with equal (side, turn) are numbered by role and text in
    ``copy``.  A pair that lacks a side, and turns without a pair or side, come out as part ``unpaired``, all masked.  Null
    turns stand first, null roles and texts equal each other; an empty table gives no rows.
    """
    at = Window.partitionBy("pair_id", "side", "turn").orderBy("role", "text")
    rows = turns.select("pair_id", "side", "turn", "role", "text", F.row_number().over(at).alias("copy"))
    # Null turns sort before all numbers; a struct's order compares its parts in turn.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "copy")
    own = rows.where("pair_id IS NOT NULL AND side IS NOT NULL").withColumn("place", place)
    compared = own.groupBy("pair_id", "place").agg(
        F.count(F.when(F.col("side") == CHOSEN, 1)).alias("a"), F.count(F.when(F.col("side") == REJECTED, 1)).alias("b"),
        F.count_distinct(F.struct(F.coalesce(F.concat(F.lit("r"), "role"), F.lit("")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")))).alias("kinds"),
    )
    shared = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("kinds") == 1)
    pairs = compared.groupBy("pair_id").agg(
        F.min(F.when(~shared, F.col("place"))).alias("first"), ((F.sum("a") > 0) & (F.sum("b") > 0)).alias("whole")
    )
    placed = own.join(pairs, "pair_id").withColumn("part", (
        F.when(~F.col("whole"), F.lit(UNPAIRED)).when(F.col("first").isNull() | (F.col("place") < F.col("first")), F.lit(PROMPT)).otherwise(F.col("side"))
    ))
    # The prompt once: both sides have it, the chosen side gives it.
    placed = placed.where((F.col("part") != PROMPT) | (F.col("side") == CHOSEN)).drop("place", "first", "whole")
    lone = rows.where("pair_id IS NULL OR side IS NULL").withColumn("part", F.lit(UNPAIRED))
    return placed.unionByName(lone).select(
        "pair_id", "part", "turn", "copy", "role", rendered(F.col("role"), F.col("text")).alias("segment"),
        (F.col("part").isin(CHOSEN, REJECTED) & F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("trained"),
    )


#: The same over the table ``conversations``, pairs as in ``paired``.
SQL = r"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id,
         CASE WHEN conv_id % 2 = 0 THEN 'chosen' WHEN conv_id IS NOT NULL THEN 'rejected' END AS side, turn, role, text,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS copy
  FROM conversations
), c AS (
  SELECT pair_id, turn, copy, count(*) FILTER (side = 'chosen') AS a, count(*) FILTER (side = 'rejected') AS b,
         count(DISTINCT (coalesce('r' || role, ''), coalesce('t' || text, ''))) AS kinds
  FROM t GROUP BY ALL
), p AS (
  SELECT pair_id, min(CASE WHEN NOT (a > 0 AND b > 0 AND kinds = 1) THEN turn * 1000000 + copy END) AS first, sum(a) > 0 AND sum(b) > 0 AS whole
  FROM c GROUP BY pair_id
), f AS (
  SELECT t.*, CASE WHEN NOT whole THEN 'unpaired' WHEN first IS NULL OR turn * 1000000 + copy < first THEN 'prompt' ELSE side END AS part
  FROM t JOIN p USING (pair_id)
)
SELECT pair_id, part, turn, CAST(copy AS INTEGER) AS copy, role,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS segment,
       part IN ('chosen', 'rejected') AND coalesce(role = 'assistant', false) AS trained
FROM f WHERE part <> 'prompt' OR side = 'chosen'
"""
