"""Publishing tables as CSV files: written to a stage by many tasks, then moved into place, parts before the file they belong to."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.names import part_name
from sluice.operators.merge import KEY, by_key, csv_line
from sluice.operators.split import CHUNK, THRESHOLD, parts
from sluice.operators.stored import dropped, fs_of, stored


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files below a folder; none if it does not exist."""
    fs, at = fs_of(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], "path string, length long")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def occupied(files: DataFrame, out: str) -> DataFrame:
    """(dir, stem) whose part names (``stem_2.csv`` and so on) are taken by files that are there already."""
    base = re.sub(r"^file:(//)?", "", out).split("://")[-1].rstrip("/") + "/"
    rel = F.substring("path", F.instr("path", base) + len(base), F.length("path"))
    got = files.select(F.regexp_replace(rel, "^/+", "").alias("rel"))
    found = got.select(F.regexp_extract("rel", "^(?:(.*)/)?[^/]*$", 1).alias("dir"), F.regexp_extract("rel", r"([^/]*)_0*([0-9]+)\.(?i:csv)$", 1).alias("stem"), F.regexp_extract("rel", r"_0*([0-9]+)\.(?i:csv)$", 1).alias("n"))
    return found.where("n <> '' and n <> '0' and n <> '1'").select("dir", F.lower("stem").alias("stem")).distinct()


def lines(tables: DataFrame, heads: DataFrame, taken: DataFrame | None = None, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """dir, base, part, header, path, offset, row, line: CSV records of merged rows and one header record for each part.

    Tables with a header and no rows have their header; tables without column names have none. Keys in ``taken`` (dir, stem) are not split.
    """
    cut = parts(tables, list(KEY), ["path", "offset", "row"], threshold, chunk)
    if taken is not None:
        free = cut.select(*KEY).distinct().join(taken.withColumnRenamed("dir", "at"), (F.lower("base") == F.col("stem")) & (F.col("dir") == F.col("at")), "left_semi").withColumn("whole", F.lit(True))
        cut = by_key(cut, free, "left").withColumn("part", F.when(F.col("whole"), F.lit(1)).otherwise(F.col("part"))).drop("whole")
    body = cut.select(*KEY, F.col("part").cast("long").alias("part"), F.lit(False).alias("header"), "path", "offset", "row", csv_line(F.col("values")).alias("line"))
    each = body.groupBy(*KEY).agg(F.max("part").alias("last"))
    tops = heads.where("header is not null").join(each, list(KEY), "left").withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("last", F.lit(1).cast("long")))))
    named = F.concat("header", F.array_repeat(F.lit(""), F.greatest(F.col("width").cast("int") - F.size("header"), F.lit(0))))
    top = tops.select(*KEY, "part", F.lit(True).alias("header"), F.lit(None).cast("string").alias("path"), F.lit(-1).cast("long").alias("offset"), F.lit(-1).cast("long").alias("row"), csv_line(named).alias("line"))
    return body.union(top)


def publish(written: DataFrame, out: str, ext: Column | str = ".csv") -> list[str]:
    """Write lines() below out as ``dir/base.csv`` and ``dir/base_n.csv``; returns the files, by name.

    A part is one task, so a large key is written by as many tasks as it has parts. Files are staged beside their place and then moved: higher parts
    first, the first one last; if a move fails, the parts moved for that table are taken back and the old files stay.
    """
    spark = written.sparkSession
    stage = f"{out.rstrip('/')}/_stage-{uuid.uuid4().hex}"
    target = F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.concat(part_name(F.col("base"), F.col("part")), F.lit(ext) if isinstance(ext, str) else ext))
    rows = stored(written.withColumn("target", target).withColumn("id", F.md5("target")), "lines")
    ordered = rows.repartition("id").sortWithinPartitions("id", F.desc("header"), "path", "offset", "row")
    try:
        ordered.select("id", F.substring("line", F.lit(1), F.char_length("line") - 1).alias("value")).write.partitionBy("id").text(stage)
        names = rows.select("id", "dir", "base", "part", "target").distinct().orderBy("dir", "base", F.desc("part")).collect()  # one row for each file
        moved: list[str] = []
        for k, r in enumerate(names):
            try:
                _move(spark, f"{stage}/id={r.id}", f"{out.rstrip('/')}/{r.target}")
            except Exception:
                for x in names[:k]:
                    if (x.dir, x.base) == (r.dir, r.base):
                        dropped(spark, f"{out.rstrip('/')}/{x.target}")
                raise
            moved.append(r.target)
    finally:
        dropped(spark, stage)
    return sorted(moved)


def _move(spark: SparkSession, folder: str, target: str) -> None:
    """Move the one file in a folder to its place; what stood there goes only once the new file is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, to = fs_of(spark, target)
    aside = path(f"{target}.old-{uuid.uuid4().hex}")
    found = [s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-")]
    if len(found) != 1:
        raise OSError(f"{target}: staged as {len(found)} files")
    fs.mkdirs(to.getParent())
    old = fs.exists(to)
    if old and not fs.rename(to, aside):
        raise OSError(f"{target}: the old file cannot be moved")
    if not fs.rename(found[0], to):
        if old:
            fs.rename(aside, to)
        raise OSError(f"{target}: cannot be moved into place")
    if old:
        fs.delete(aside, False)
