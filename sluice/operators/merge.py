"""Merging rows of many statements into one table by (directory, file base), with positional width rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.names import file_base, limited_name
from sluice.operators.stored import stored

KEY = ("dir", "base")
#: Keys whose table is sent to all tasks at most; tasks that rows of one key are dealt to where there are more keys.
FEW = 2_000
SALTS = 1_024


def keyed(rows: DataFrame) -> DataFrame:
    """Adds base, the name of the key's file, to rows with dir and table."""
    return rows.withColumn("base", limited_name(file_base(F.col("table"))))


def cell_texts(cells: Column) -> Column:
    """Texts of cells; null and missing become empty only here."""
    return F.transform(cells, lambda c: F.coalesce(c["text"], F.lit("")))


def first_schema(rows: DataFrame) -> DataFrame:
    """(dir, base, header, width) of each key: from its first row in (path, offset, row) order. Aggregates before its shuffle.

    The first rows of all statements (insert_dump.first_rows()) are enough.
    """
    at = F.struct("path", "offset", "row")
    first = F.min_by(F.struct("columns", F.size("cells").alias("n")), at)
    got = rows.groupBy(*KEY).agg(first.alias("f"))
    has = F.size(F.coalesce("f.columns", F.array().cast("array<string>"))) > 0
    return got.select(*KEY, F.when(has, F.col("f.columns")).alias("header"), F.when(has, F.size("f.columns")).otherwise(F.col("f.n")).alias("width"))


def heads(reports: DataFrame) -> DataFrame:
    """(dir, base, header, width) of each key from reports with dir: its first unit in (path, offset) order that gave rows, or columns alone.

    Reports are one row a unit, so nothing is parsed or shuffled again for the keys' widths.
    """
    fine = keyed(reports).where(F.col("status").isin("ok", "cut") & F.col("width").isNotNull())
    first = F.min_by(F.struct("columns", "width"), F.struct("path", "offset"))
    got = fine.groupBy(*KEY).agg(first.alias("f"))
    return got.select(*KEY, F.when(F.size("f.columns") > 0, F.col("f.columns")).alias("header"), F.col("f.width").alias("width"))


def padded(values: Column, width: Column) -> Column:
    return F.concat(values, F.array_repeat(F.lit(""), F.greatest(width.cast("int") - F.size(values), F.lit(0))))


def by_key(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows (with path, offset and row) joined to a table of one row for each key, without a key's rows meeting in one task.

    The table is computed at once. One of a few keys is broadcast, and rows stay where they are; rows of more keys are dealt out by key and salt.
    """
    few = table.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(few, table.schema).coalesce(1)), list(KEY), how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("path", "offset", "row"), F.lit(SALTS)))
    dealt = salted.select(*KEY, "_salt").distinct().join(table, list(KEY))  # a key has SALTS rows here at most
    return salted.join(dealt, [*KEY, "_salt"], how).drop("_salt")


def merged(rows: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """dir, base, header, width, path, offset, row, values: rows of a key padded to its width, wider ones left out.

    The schema is that of heads() or of first_schema(), with one row for each key; without it, rows are read once more for it.
    """
    df = keyed(rows) if "base" not in rows.columns else rows
    met = by_key(df, first_schema(df) if schema is None else schema).where(F.size("cells") <= F.col("width"))
    return met.select(*KEY, "header", "width", "path", "offset", "row", padded(cell_texts(F.col("cells")), F.col("width")).alias("values"))


def too_wide(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """Rows lost to their key's width: (dir, base, path, offset, n_lost, n_rows); a unit that lost all is rejected."""
    df = keyed(rows) if "base" not in rows.columns else rows
    lost = F.sum((F.size("cells") > F.col("width")).cast("long"))
    got = by_key(df, schema).groupBy(*KEY, "path", "offset").agg(lost.alias("n_lost"), F.count(F.lit(1)).alias("n_rows"))
    return got.where("n_lost > 0").withColumn("rejected", F.col("n_lost") == F.col("n_rows"))


def refused_targets(targets: DataFrame) -> DataFrame:
    """Of producers (target, rank, path) of one target all but the first source are refused; returns those."""
    first = targets.groupBy("target").agg(F.min(F.struct("rank", "path")).alias("f"))
    return targets.join(first, "target").where(F.col("path") != F.col("f.path")).select("target", "rank", "path")


def csv_line(values: Column) -> Column:
    """One CSV record: every value quoted, quotes doubled, a line feed at the end."""
    quoted = F.transform(values, lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')))
    return F.concat(F.array_join(quoted, ","), F.lit("\n"))


def ordered(df: DataFrame) -> DataFrame:
    """Rows of a key together and in source order, for writing."""
    return df.repartition(*KEY).sortWithinPartitions(*KEY, "path", "offset", "row")


def numbered(df: DataFrame, keys: list[str], order: list[str], size: int, above: int = 0) -> DataFrame:
    """Adds part (1, 2, ...) of at most ``size`` rows by order within keys; keys of no more than ``above`` rows are one part.

    Counts by range partition and prefix sums number rows without bringing a key into one task. Ties in the order may fall either way.
    """
    # range bounds are sampled anew in each run, so the partition of a row is written down once
    ranged = stored(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_p", *keys).orderBy(*order)
    counts = ranged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    of_key = Window.partitionBy(*keys)
    before = counts.withColumn("_b", F.sum("_c").over(of_key.orderBy("_p")) - F.col("_c")).withColumn("_n", F.sum("_c").over(of_key))
    out = ranged.withColumn("_r", F.row_number().over(within)).join(before.drop("_c"), [*keys, "_p"])
    part = F.floor((F.col("_r") + F.col("_b") - 1) / size) + 1
    return out.withColumn("part", F.when(F.col("_n") > above, part).otherwise(F.lit(1))).drop("_p", "_r", "_b", "_n")
