"""Discovery of inputs below a root: path, kind, directory, top folder and rank; contents are not read.

``inputs`` takes Spark's listing, wherever the files are; that has no empty files and no names that begin with ``_`` or ``.``. ``walk`` is for folders that all executors mount: it also meets
hidden names, does not follow links, and reports links and unreadable entries; tops are walked in parallel.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds by extension with their rank (dumps, books, files only split), names of state lists, and names that are never inputs.
RANKS = {"sql": 0, "xlsx": 1, "xls": 1, "csv": 2, "txt": 2}
KINDS = tuple(RANKS)
STATE_LISTS = {"_convert_done_.txt": ("convert", "done"), "_convert_passed_.txt": ("convert", "passed"), "_splitter_done_.txt": ("split", "done"), "_splitter_passed_.txt": ("split", "passed")}
IGNORED = ("readme.txt", "_log.txt", *STATE_LISTS)
ENTRIES = "path string, rel string, length long, reason string, blocks boolean"


def local_path(root: str) -> str | None:
    """The root as a folder of the file system, or None if it is in another store."""
    if "://" in root and not root.startswith("file://"):
        return None
    return re.sub("^file:(//)?", "", root).rstrip("/") or "/"


def _status(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def checked_root(spark: SparkSession, root: str) -> str:
    """The root itself; an error if it does not exist or is no folder."""
    fs, path = _status(spark, root)
    if not fs.exists(path):
        raise FileNotFoundError(f"root {root} not found")
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"root {root} is no folder")
    return root


def top_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders right below root, sorted; links are none."""
    at = local_path(root)
    if at is not None:
        return sorted(e.name for e in os.scandir(at) if e.is_dir(follow_symlinks=False))
    fs, path = _status(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def _entries(at: str, rel: str) -> Iterator[tuple[str, str, int | None, str | None, bool | None]]:
    """Files below a folder, with links and what can't be read."""
    try:
        found = sorted(os.scandir(at), key=lambda e: e.name)
    except OSError as e:
        yield at, rel, None, e.strerror or str(e), True
        return
    for e in found:
        name = f"{rel}/{e.name}" if rel else e.name
        try:
            if e.is_symlink():
                yield e.path, name, None, "link, not followed", False
            elif e.is_dir(follow_symlinks=False):
                yield from _entries(e.path, name)
            else:
                yield e.path, name, e.stat(follow_symlinks=False).st_size, None, None
        except OSError as x:
            yield e.path, name, None, x.strerror or str(x), True


def walk(spark: SparkSession, root: str, done: list[str] = ()) -> DataFrame:
    """Everything below a mounted root but completed tops: inputs, and entries with a reason why they are none."""
    at = local_path(checked_root(spark, root))
    if at is None:
        raise ValueError("walk() needs a mounted folder; inputs() reads other stores")
    tops = [(t,) for t in top_folders(spark, root) if t not in set(done)]

    def run(batches):
        for batch in batches:
            for top in batch.column("top").to_pylist():
                if top is None:  # files and links right below the root
                    got = [(e.path, e.name, None, "link, not followed", False) if e.is_symlink() else (e.path, e.name, e.stat().st_size, None, None) for e in os.scandir(at) if e.is_symlink() or not e.is_dir()]
                else:
                    got = list(_entries(f"{at}/{top}", top))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=[x.split()[0] for x in ENTRIES.split(", ")])

    one = spark.createDataFrame([(None,), *tops], "top string")
    return _kinds(one.repartition(max(1, min(len(tops) + 1, spark.sparkContext.defaultParallelism))).mapInArrow(run, ENTRIES))


def skips(found: DataFrame) -> DataFrame:
    """Of walk(): what is no input, with the folders that it keeps from completion."""
    return found.where("reason is not null").select("path", "reason", "top_folder", "blocks")


def inputs(spark: SparkSession, root: str, done: DataFrame | None = None) -> DataFrame:
    """files(path, rel, kind, dir, top_folder, rank, length); completed tops are not listed at all."""
    checked_root(spark, root)
    closed = [r.top_folder for r in done.select("top_folder").distinct().collect()] if done is not None else []
    return described(loaded(spark, unfinished(spark, root, closed)).select("path", "length"), root)


def loaded(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """path, length and content of the files below paths whose names match; contents are read only where they are selected."""
    if not paths:
        return spark.createDataFrame([], "path string, length long, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths).select("path", "length", "content")


def unfinished(spark: SparkSession, root: str, closed: list[str]) -> list[str]:
    """What to load: the root, or its tops and files without completed tops (names of tops are few); nothing if all are completed."""
    if not closed:
        return [root]
    fs, path = _status(spark, root)
    kept = [s.getPath().toString() for s in fs.listStatus(path) if not (s.isDirectory() and s.getPath().getName() in set(closed))]
    return [x for x in kept if not x.rsplit("/", 1)[-1].startswith(("_", "."))]


def described(df: DataFrame, root: str, done: DataFrame | None = None) -> DataFrame:
    """Adds rel, kind, dir, top_folder and rank to a DataFrame with a path column; keeps inputs of tops that are not in done."""
    base = (local_path(root) or root.rstrip("/").split("://")[-1]).rstrip("/") + "/"
    rel = F.substring("path", F.instr("path", base) + len(base), F.length("path"))
    out = _kinds(df.withColumn("rel", F.regexp_replace(rel, "^/+", "")))
    return out.join(done.select("top_folder"), "top_folder", "left_anti") if done is not None else out


def _kinds(df: DataFrame) -> DataFrame:
    out = df.withColumn("kind", F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)))
    name = F.lower(F.element_at(F.split("rel", "/"), -1))
    fine = F.col("kind").isin(*KINDS) & ~name.isin(*IGNORED)
    out = out.where(fine | F.col("reason").isNotNull() if "reason" in df.columns else fine)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("kind"))
    top = F.when(F.contains("rel", F.lit("/")), F.split("rel", "/")[0]).otherwise("")
    return out.withColumn("dir", F.regexp_extract("rel", "^(.*)/[^/]*$", 1)).withColumn("top_folder", top).withColumn("rank", rank)


def in_order(found: DataFrame) -> DataFrame:
    """Inputs by path, bytewise."""
    return found.orderBy("path")


def by_top(found: DataFrame) -> DataFrame:
    """(top_folder, place, n_files): tops in the order in which paths first meet them."""
    got = found.groupBy("top_folder").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n_files"))
    # one row for each top folder
    return got.select("top_folder", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"), "n_files")


def by_directory(found: DataFrame) -> DataFrame:
    """Adds place: within a directory dumps come first, then books, then files that are only split, each by path."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("dir").orderBy("rank", "path")).cast("long"))
