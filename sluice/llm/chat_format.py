"""Chat formatting: cumulative snapshots are collapsed, maximal conversations rendered. DataFrame functions only.

A conversation logged after each turn leaves snapshots that are prefixes of the longest one. Each turn gets a
128-bit digest before any shuffle; a conversation's rolling hash (a running xor of hashes of digest and place) names its
prefixes. A conversation is dropped if its full hash is a proper prefix hash of another (anti-join on distinct prefix hashes),
and of conversations with all turns equal the smallest conv_id stays. Only digests go through these joins; the
texts of kept conversations are shuffled once, to be rendered. Work is linear in turns but for sorting them.

Turns are ordered by turn, role, then digest. Defined results: null role or text is empty; a null turn comes
first; rows with a null conv_id form one conversation, which wins ties as smallest; exactly repeated rows
of a conversation count once; empty conversations don't exist, an empty table gives no rows; other columns are
ignored. A conversation becomes one row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.util import saved

#: One turn as rendered, and the end of a conversation.
TURN = ("<|", "|>\n", "\n")
END = "<|end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def _hashed(turns: DataFrame) -> DataFrame:
    """Adds a and b, two hashes of role and text."""
    return turns.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit("second"), "text", "role")})


def _once(hashed: DataFrame) -> DataFrame:
    """Without exact repeats of a conversation's rows: one shuffle and sort by conversation."""
    key = F.struct("turn", "role", "a", "b")
    return hashed.withColumn("before", F.lag(key).over(_order())).where(~key.eqNullSafe(F.col("before"))).drop("before")


def _order() -> Window:
    return Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "a", "b")


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and, for each number k of first turns, their hash (a, b)."""
    rows = _once(_hashed(_turns(conversations)).drop("text"))
    placed = rows.withColumns({"k": F.row_number().over(_order()), "n_turns": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))})
    so_far = _order().rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("conv_id", "n_turns", "k", F.bit_xor(F.xxhash64("k", "a", "b")).over(so_far).alias("a"), F.bit_xor(F.xxhash64("b", "k", "a")).over(so_far).alias("b"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that stay."""
    known = saved(prefixes(conversations), "prefixes")
    full = known.where("k = n_turns").groupBy("a", "b", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.max(F.col("conv_id").isNull()).alias("has_null"), F.count(F.lit(1)).alias("n_copies"))
    full = full.withColumn("conv_id", F.when(~F.col("has_null"), F.col("conv_id"))).drop("has_null")
    shorter = known.where("k < n_turns").select("a", "b", F.col("k").cast("long").alias("n_turns")).distinct()
    return full.join(shorter, ["a", "b", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text: maximal conversations as one text each."""
    kept = maximal(conversations).withColumnRenamed("conv_id", "kept_id")
    met = _hashed(_turns(conversations)).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).drop("kept_id")
    turn = F.struct(F.col("turn"), "role", "a", "b", "text")
    out = _once(met).groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(turn)).alias("xs"))
    # array_sort puts null fields first within structs, as the order above does
    text = F.array_join(F.transform("xs", lambda x: F.concat(F.lit(TURN[0]), x["role"], F.lit(TURN[1]), x["text"], F.lit(TURN[2]))), "")
    return out.select("conv_id", "n_turns", "n_copies", F.concat(text, F.lit(END)).alias("text"))
