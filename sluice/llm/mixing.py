"""Mixing sources to target weights by Pareto order sampling.

Sources in code point order (null last) weigh 3, 1, 2, repeating; together they get ``share`` of all
words. A target stops at ``cap`` times its source's words and the excess is shared again by weight until
none is above. Within a source a document of size class k (bit length of its word count) expects
min(cap, c * (k + 1)) copies, c solved so that expected words meet the target. Whole copies are certain;
the fraction left is the inclusion probability p of a Pareto order sample: with u a hash-based uniform
number of the document, rank u / (1 - u) / (p / (1 - p)) ascending, documents are taken while their words
fit what the target leaves. A second pass fills what the first document that did not fit left open.

Ranks are dealt into fine log-scale bins first; only the bin where the target falls is ordered by row, so
a source with most rows is summed in parallel. Sizes are computed once and kept as a small table.

Defined results: null or empty text has size 0 and is taken 0 times in words; the null source is a source;
repeated rows with one doc_id, source and size are drawn alike; a null doc_id draws like an empty one, and rows of equal rank in
ascending doc_id order, nulls first; an empty table gives no rows; reruns agree; other columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.util import SPACE, saved

#: Weights of sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Rank bins per factor of two, and of the finer second level.
BINS = 256
FINE = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the md5 of a key: the same in any engine and on every run."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: source_size and target. One row per source is shared out in a single group of such rows."""
    w_all = Window.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(w_all) - 1) % len(weights) + 1).cast("int")).cast("double"))
    # water-filling in closed form: by cap * size / weight ascending, a source is full if sharing what the fuller ones leave gives it its cap
    level = F.col("source_size") * cap / F.col("weight")
    order = Window.orderBy(level.asc(), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("budget", F.sum("source_size").over(everything) * share).withColumn("level", level)
    per = per.withColumn("left_words", F.col("budget") - F.coalesce(F.sum(F.col("source_size") * cap).over(below), F.lit(0.0)))
    per = per.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    per = per.withColumn("each", F.col("left_words") / F.col("left_weight"))
    # the first source (in that order) that is not full fixes the level of all behind it
    water = F.min(F.when(F.col("each") < F.col("level"), F.struct("level", F.col("each").alias("each")))).over(everything)["each"]
    return per.withColumn("water", water).select(
        "source", "source_size", F.least(F.col("source_size") * cap, F.coalesce(F.col("water"), F.lit(float("inf"))) * F.col("weight")).alias("target")
    )


def _met(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join a small table by source, the null source included."""
    return left.join(right.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def _class(size: Column) -> Column:
    """Bit length of a size: 0 for none."""
    return F.when(size > 0, F.floor(F.log2(size)) + 1).otherwise(0).cast("int")


def copies_by_class(sized: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, class, expected copies): c * (class + 1), at most cap, words meeting the target."""
    cells = sized.where("size > 0").groupBy("source", _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    # at most 63 cells a source; full classes are the longest ones: c from each split, the valid one chosen
    up = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(0, Window.unboundedFollowing)
    cells = _met(cells, goals)
    cells = cells.withColumn("c", F.greatest(F.lit(0.0), F.col("target") - cap * F.coalesce(F.sum("words").over(up), F.lit(0))) / F.sum(F.col("words") * (F.col("class") + 1)).over(down))
    whole = Window.partitionBy("source")
    fits = F.col("c") * (F.col("class") + 1) <= cap
    c = F.max(F.when(fits, F.struct("class", "c"))).over(whole)["c"]
    return cells.withColumn("c1", F.coalesce(c, F.lit(float("inf")))).select("source", "class", F.least(F.lit(cap), F.col("c1") * (F.col("class") + 1)).alias("copies"))


def mixed(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of docs."""
    sized = saved(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    return _drawn(sized, share, cap, weights)


def _drawn(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    goals = saved(targets(sized, share, cap, weights), "targets")
    cells = saved(copies_by_class(sized, goals, cap), "cells")
    out = sized.withColumn("class", _class(F.col("size")))
    # one row per source and size class: a handful for each source, and checked by Spark against its broadcast limit
    cells = cells.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "copies")
    out = out.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")), "left").drop("_s", "_c")
    copies = F.coalesce(F.col("copies"), F.lit(0.0))
    whole = F.floor(copies + 1e-9)
    p = F.greatest(copies - whole, F.lit(0.0))
    u = uniform(F.col("doc_id"))
    rank = u / (1 - u) * F.try_divide(1 - p, p)
    out = out.select("doc_id", "source", "size", whole.cast("long").alias("whole"), F.when(p > 1e-9, F.log2(rank)).alias("rank"))
    sure = out.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    room = _met(goals, sure).select("source", "source_size", "target", (F.col("target") - F.col("sure")).alias("room"))
    first = saved(_taken(out.withColumn("drawn", F.lit(False)), saved(room, "room")), "first")
    used = first.where("drawn").groupBy("source").agg(F.sum("size").alias("used"))
    room2 = _met(room, used, "left").select("source", "source_size", "target", (F.col("room") - F.coalesce(F.col("used"), F.lit(0))).alias("room"))
    second = _taken(first, saved(room2, "room2"))
    taken_copies = F.col("whole") + F.col("drawn").cast("long")
    second = second.select("doc_id", "source", "size", taken_copies.alias("copies"), (taken_copies * F.col("size")).alias("taken"))
    return _met(second, goals).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _taken(rows: DataFrame, room: DataFrame) -> DataFrame:
    """Mark drawn rows: undrawn ones of at most the room's size, by rank, while their words fit the room."""
    small = room.select("source", "room")
    out = _met(rows, small)
    out = out.withColumn("open", (~F.col("drawn")) & F.col("rank").isNotNull() & (F.col("size") <= F.col("room")))
    out = out.withColumn("bin", F.floor(F.col("rank") * BINS)).withColumn("fine", F.floor((F.col("rank") * BINS - F.col("bin")) * FINE))
    # bins of all sources: their number follows BINS and the spread of ranks, not the rows
    sums = out.where("open").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    sums = _met(sums, small)
    edge = sums.where("before + words > room").groupBy("source").agg(F.min(F.struct("bin", "before")).alias("e"))
    edge = saved(edge.select("source", F.col("e.bin").alias("edge_bin"), F.col("e.before").alias("edge_before")), "edge")
    out = _met(out, edge, "left")
    inner = out.where("open and bin = edge_bin").groupBy("source", "fine").agg(F.sum("size").alias("words"), F.first("edge_before").alias("edge_before"), F.first("room").alias("room"))
    w = Window.partitionBy("source").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("before", F.col("edge_before") + F.coalesce(F.sum("words").over(w), F.lit(0)))
    fine = inner.where("before + words > room").groupBy("source").agg(F.min(F.struct("fine", "before")).alias("e"))
    fine = saved(fine.select("source", F.col("e.fine").alias("edge_fine"), F.col("e.before").alias("fine_before")), "fine")
    out = _met(out, fine, "left")
    # the few rows of the one fine bin where the room ends are ordered by row
    at = (F.col("bin") == F.col("edge_bin")) & (F.col("fine") == F.col("edge_fine"))
    w = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = out.where(F.col("open") & at).select("source", "doc_id", "size", "rank", "room", "fine_before").withColumn("upto", F.col("fine_before") + F.sum("size").over(w))
    over = last.where("upto > room").groupBy("source").agg(F.min(F.struct("rank", "doc_id")).alias("stop")).select("source", "stop")
    over = saved(over, "stop")
    out = _met(out, over, "left")
    before_edge = F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & (F.col("edge_fine").isNull() | (F.col("fine") < F.col("edge_fine"))))
    now = F.col("open") & (before_edge | (at & (F.struct("rank", "doc_id") < F.col("stop"))))
    return out.select("doc_id", "source", "size", "whole", "rank", (F.col("drawn") | F.coalesce(now, F.lit(False))).alias("drawn"))
