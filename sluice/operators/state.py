"""Per-folder, per-stage state: what is done, what runs, and summaries. Sources are never deleted; eligibility is reported."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.stored import fs_of
from sluice.sources.files import STATE_LISTS

STAGES = ("convert", "split")


def folded(name: Column, fold: bool) -> Column:
    """Names as compared: by lower case where the file system folds them."""
    return F.lower(name) if fold else name


def decoded(lists: DataFrame, fold: bool = False) -> DataFrame:
    """top_folder, stage, outcome from state lists (path, text): one name a line; a torn last line, a byte order mark and line feeds' CRs go."""
    file = F.element_at(F.split("path", "/"), -1)
    kinds = [(k, *v) for k, v in STATE_LISTS.items()]
    whole = F.regexp_replace(F.regexp_extract("text", r"(?s)^\x{FEFF}?(.*\n)", 1), r"\r\n", "\n")
    names = lists.select(F.lower(file).alias("file"), F.explode(F.split(whole, "\n")).alias("top_folder")).where("top_folder <> ''")
    said = names.select("file", folded(F.col("top_folder"), fold).alias("top_folder"))
    of = F.create_map(*[F.lit(x) for k, stage, outcome in kinds for x in (k, f"{stage} {outcome}")])
    got = said.withColumn("is", F.element_at(of, F.col("file"))).where("is is not null")
    return got.select("top_folder", F.split("is", " ")[0].alias("stage"), F.split("is", " ")[1].alias("outcome")).distinct()


def read_lists(spark: SparkSession, root: str, fold: bool = False) -> DataFrame:
    """The state that is kept in root's four lists; missing lists are empty."""
    texts = [(f"{root}/{name}", _text(spark, f"{root.rstrip('/')}/{name}")) for name in STATE_LISTS]
    return decoded(spark.createDataFrame([(p, t or "") for p, t in texts], "path string, text string"), fold)


def _text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if it is not there. Hidden names are read too."""
    fs, at = fs_of(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def append(spark: SparkSession, root: str, outcomes: DataFrame, fold: bool = False) -> None:
    """Add outcomes (top_folder, stage, outcome) to root's lists: known names are not repeated, a torn last line goes, split lists first.

    A list is written whole to a new file that takes its place. Outcomes are one row for each top folder and stage.
    """
    new: dict[str, list[str]] = {}
    for r in outcomes.select("top_folder", "stage", "outcome").distinct().orderBy(F.desc("stage"), "top_folder").collect():
        if not r.top_folder or "\n" in r.top_folder or "\r" in r.top_folder:
            raise ValueError(f"no name of a top folder: {r.top_folder!r}")
        new.setdefault(next(k for k, v in STATE_LISTS.items() if v == (r.stage, r.outcome)), []).append(r.top_folder)
    for name, tops in new.items():
        path = f"{root.rstrip('/')}/{name}"
        text = _text(spark, path) or ""
        kept = text[: text.rfind("\n") + 1]
        known = {(x.lower() if fold else x) for x in kept.removeprefix("\ufeff").replace("\r\n", "\n").split("\n")}
        more = [t for t in tops if (t.lower() if fold else t) not in known]
        if not more:
            continue
        fs, at = fs_of(spark, path)
        _, beside = fs_of(spark, f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray((kept + "".join(f"{t}\n" for t in more)).encode()))
            stream.flush()
        finally:
            stream.close()
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"{path}: cannot be written")


def empty_tops(tops: DataFrame, units: DataFrame, blocked: DataFrame, state: DataFrame) -> DataFrame:
    """(top_folder, stage, outcome): folders without any input, not blocked, have passed the stages that are still open."""
    idle = tops.select("top_folder").distinct().join(units.select("top_folder"), "top_folder", "left_anti").join(blocked.select("top_folder"), "top_folder", "left_anti")
    return open_stages(idle, state).withColumn("outcome", F.lit("passed"))


class RootLock:
    """One run a root: a file that only one run can create, and takes away at its end."""

    NAME = "_sluice.lock"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.fs, self.path = fs_of(spark, f"{root.rstrip('/')}/{self.NAME}")

    def __enter__(self) -> RootLock:
        if not self.fs.createNewFile(self.path):
            raise BlockingIOError(f"another run holds {self.path.toString()}")
        return self

    def __exit__(self, *_: object) -> None:
        self.fs.delete(self.path, False)


def completed(state: DataFrame) -> DataFrame:
    """Top folders with all stages closed."""
    return state.where(F.col("stage").isin(*STAGES)).groupBy("top_folder").agg(F.count_distinct("stage").alias("n")).where(F.col("n") == len(STAGES)).select("top_folder")


def open_stages(folders: DataFrame, state: DataFrame) -> DataFrame:
    """(top_folder, stage) to run: not closed yet; files at the root, folder '', always run."""
    wanted = folders.select("top_folder").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, STAGES))))
    return wanted.join(state.where("top_folder <> ''").select("top_folder", "stage"), ["top_folder", "stage"], "left_anti")


def outcomes(results: DataFrame) -> DataFrame:
    """(top_folder, stage, outcome) to record from results(top_folder, convert_files, split_files, failures, blocked).

    done if the stage produced output, else passed; nothing is recorded for folders with a failure or an unreadable entry.
    """
    fine = results.where((F.col("failures") == 0) & (~F.col("blocked")) & (F.col("top_folder") != ""))
    both = F.array(F.struct(F.lit("split").alias("stage"), F.col("split_files").alias("n")), F.struct(F.lit("convert").alias("stage"), F.col("convert_files").alias("n")))
    return fine.select("top_folder", F.explode(both).alias("s")).select("top_folder", "s.stage", F.when(F.col("s.n") > 0, "done").otherwise("passed").alias("outcome"))


def summary(units: DataFrame) -> DataFrame:
    """Counters and an overall result for each folder from units(top_folder, outcome): failed before created before skipped.

    Units that were skipped for carrying no personal data, with the outcome ``unwanted``, are counted apart and as skipped.
    """
    n = lambda k: F.sum(F.when(F.col("outcome") == k, 1).otherwise(0))
    skipped = F.sum(F.when(F.col("outcome").isin("skipped", "unwanted"), 1).otherwise(0)).alias("n_skipped")
    got = units.groupBy("top_folder").agg(F.count(F.lit(1)).alias("n_units"), n("created").alias("n_created"), skipped, n("unwanted").alias("n_unwanted"), n("rejected").alias("n_rejected"), n("failed").alias("n_failed"))
    result = F.when(F.col("n_failed") > 0, "failed").when(F.col("n_rejected") > 0, "partial").when(F.col("n_created") > 0, "created").when(F.col("n_skipped") > 0, "skipped").otherwise("empty")
    return got.withColumn("result", result)


def source_status(results: DataFrame) -> DataFrame:
    """Whether each folder's sources are fully represented in outputs (eligible for archiving by their owner)."""
    return results.select("top_folder", ((F.col("convert_files") + F.col("split_files") > 0) & (F.col("failures") == 0) & ~F.col("blocked")).alias("eligible"))
