"""From a folder of dumps, tables and books to one CSV file for each (directory, table): the whole plan in DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.names import DEFAULT_TERMS, table_wanted, verdict
from sluice.operators import merge, publish, state
from sluice.operators.split import CHUNK, THRESHOLD
from sluice.operators.stored import stored
from sluice.sources import files, mixed, records

POLICIES = ("tag", "keep", "drop", "mask")
#: A file of more bytes has its rows dealt out to all tasks before values are parsed.
SPREAD_BYTES = 64 << 20


def contents(spark: SparkSession, root: str, closed: list[str] = (), pattern: str = mixed.GLOB) -> DataFrame:
    """path, length and content of input files; completed top folders are neither listed nor read."""
    return files.loaded(spark, files.unfinished(spark, root, list(closed)), pattern)


def items(spark: SparkSession, root: str, closed: list[str] = (), wanted=None) -> DataFrame:
    """All units and rows of dumps, tables and books below root, each file parsed once, as a written table."""
    found = contents(spark, files.checked_root(spark, root), closed)
    largest = found.agg(F.max("length")).first()[0] or 0
    spread = int(spark.conf.get("spark.sql.shuffle.partitions")) if largest > SPREAD_BYTES else 0
    return stored(mixed.read(found, wanted, spread), "items")


def _closed(done: DataFrame | None) -> list[str]:
    return [r.top_folder for r in done.select("top_folder").distinct().collect()] if done is not None else []


def dump_rows(spark: SparkSession, root: str, done: DataFrame | None = None, wanted=None) -> DataFrame:
    """Rows of all statements and tables in .sql files and of all sheets of .xlsx books below root, with dir and top_folder."""
    return files.described(mixed.read_rows(contents(spark, root, _closed(done)), wanted), root)


def dump_reports(spark: SparkSession, root: str, done: DataFrame | None = None, wanted=None) -> DataFrame:
    """What became of each statement, table and sheet, .xls and damaged books included."""
    return files.described(mixed.read_reports(contents(spark, root, _closed(done)), wanted), root)


def classified(rows: DataFrame, policy: str = "tag", terms: tuple[str, ...] = DEFAULT_TERMS) -> DataFrame:
    """Adds personal (a verdict on table and column names) and applies a policy to it.

    tag keeps all rows; keep and drop filter; mask empties the cells of personal tables. For keep, readers can be given
    names.table_wanted(terms) instead, which decides before values are parsed.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    heads = rows.select("table", "columns").distinct()
    said = heads.withColumn("personal", verdict(F.col("table"), F.coalesce("columns", F.array().cast("array<string>")), terms))
    out = rows.join(said, rows["table"].eqNullSafe(said["table"]) & rows["columns"].eqNullSafe(said["columns"])).drop(said["table"]).drop(said["columns"])
    if policy in ("keep", "drop"):
        return out.where(F.col("personal") if policy == "keep" else ~F.col("personal"))
    if policy == "mask":
        return out.withColumn("cells", F.when(F.col("personal"), F.transform("cells", lambda c: F.struct(c["kind"].alias("kind"), F.lit(None).cast("string").alias("text")))).otherwise(F.col("cells")))
    return out


def producers(reports: DataFrame) -> DataFrame:
    """(target, rank, path) of units with output: dumps of a directory share their keys and count as one; a sheet is one of its own."""
    fine = merge.keyed(reports).where(F.col("status").isin("ok", "cut") & F.col("width").isNotNull())
    owner = F.when(F.col("rank") == 0, F.lit("")).otherwise(F.concat_ws("#", "path", "offset"))
    return fine.select(F.concat_ws("/", "dir", F.lower("base")).alias("target"), "rank", owner.alias("path")).distinct()


@dataclass
class Result:
    reports: DataFrame
    refused: DataFrame
    lost: DataFrame
    files: list[str]
    failures: int


def convert(spark: SparkSession, root: str, out: str, *, personal_only: bool = False, terms: tuple[str, ...] = DEFAULT_TERMS, threshold: int = THRESHOLD, chunk: int = CHUNK, fold: bool = False) -> Result:
    """Convert everything below root that its state lists leave open, publish CSV below out, and record the state.

    ``personal_only`` keeps the dumps and tables whose names carry personal data and skips the others before their values are read;
    sheets are not judged. Sources are never changed.
    """
    root = files.checked_root(spark, root)
    with state.RootLock(spark, root):
        known = state.read_lists(spark, root, fold)
        closed = _closed(state.completed(known)) if not fold else [t for t in files.top_folders(spark, root) if t.lower() in set(_closed(state.completed(known)))]
        got = items(spark, root, closed, table_wanted(terms) if personal_only else None)
        reports = stored(files.described(mixed.reports(got), root), "reports")
        producing = producers(reports)
        refused = stored(merge.refused_targets(producing), "refused")
        ours = merge.keyed(files.described(mixed.rows(got), root))
        barred = refused.select(F.col("target").alias("_t"), F.col("path").alias("_p"))
        owner = F.when(F.col("rank") == 0, F.lit("")).otherwise(F.concat_ws("#", "path", "offset"))
        told = lambda df: df.withColumn("_t", F.concat_ws("/", "dir", F.lower("base"))).withColumn("_p", owner)
        bar = lambda df: told(df).join(barred, ["_t", "_p"], "left_anti").drop("_t", "_p")
        heads = stored(merge.heads(bar(merge.keyed(reports))), "heads")
        rows = bar(ours)
        lost = stored(merge.too_wide(rows, heads), "lost")
        taken = publish.occupied(publish.files_below(spark, out), out)
        named = publish.publish(publish.lines(merge.merged(rows, heads), heads, taken, threshold, chunk), out)
        blocked = files.skips(files.walk(spark, root, closed)).where("blocks") if files.local_path(root) else spark.createDataFrame([], "top_folder string")
        bad = F.col("status").isin("rejected", "cut") & ~F.col("quiet")
        whole = lost.where("rejected").select("path", "offset")
        second = told(merge.keyed(reports)).join(barred, ["_t", "_p"], "left_semi").select("path", "offset")
        units = reports.join(whole.union(second).distinct().withColumn("wide", F.lit(True)), ["path", "offset"], "left")
        per = units.groupBy("top_folder").agg(
            F.sum((F.col("status").isin("ok", "cut") & F.col("width").isNotNull() & F.col("wide").isNull()).cast("long")).alias("convert_files"),
            F.sum((bad | F.col("wide").isNotNull()).cast("long")).alias("failures"),
        )
        stopped = blocked.select("top_folder").distinct().withColumn("_b", F.lit(True))
        results = stored(per.join(stopped, "top_folder", "left").select("top_folder", "convert_files", F.lit(0).cast("long").alias("split_files"), "failures", F.col("_b").isNotNull().alias("blocked")), "results")
        tops = spark.createDataFrame([(t,) for t in files.top_folders(spark, root)] or [("",)], "top_folder string").where("top_folder <> ''")
        seen = files.described(contents(spark, root, closed, "*.*").select("path"), root)
        idle = state.empty_tops(tops, seen, blocked, known)
        state.append(spark, root, state.outcomes(results).where("stage = 'convert'").unionByName(idle), fold)
        failures = results.agg(F.sum("failures")).first()[0] or 0
        return Result(reports, refused, lost, named, failures)


def split_files(spark: SparkSession, root: str, out: str, mode: str = "header", threshold: int = THRESHOLD, chunk: int = CHUNK, closed: list[str] = ()) -> tuple[list[str], list[str]]:
    """Parts of the .csv and .txt files below root that have more rows than the threshold, published below out, and files that failed.

    A file whose part names are taken below out, or with an overlong record, fails and stays whole. Other files need no copy.
    """
    found = contents(spark, files.checked_root(spark, root), closed, "*.{[cC][sS][vV],[tT][xX][tT]}")
    kept = files.described(found, root).select("path", "content")
    made = stored(records.part_lines(kept, mode, threshold, chunk), "parts")
    name = F.element_at(F.split("path", "/"), -1)
    named = files.described(made, root).withColumns({"base": F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), "ext": F.regexp_extract(name, r"(\.[^.]*)$", 1)})
    taken = publish.occupied(publish.files_below(spark, out), out).withColumnRenamed("dir", "at")
    barred = named.select("path", "dir", "base").distinct().join(taken, (F.lower("base") == F.col("stem")) & (F.col("dir") == F.col("at")), "left_semi").select("path")
    failed = made.where("error is not null").select("path").union(barred).distinct()
    good = named.join(failed, "path", "left_anti").select("dir", "base", "ext", "part", (F.col("row") < 0).alias("header"), "path", F.lit(0).cast("long").alias("offset"), "row", "line")
    return publish.publish(good, out, F.col("ext")), sorted(r.path for r in failed.collect())  # one row for each file that failed
