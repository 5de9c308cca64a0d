"""Helpers shared by the corpus operators: scratch tables, word splitting, hashing, block shuffles.

A *block shuffle* moves numpy arrays instead of rows: a map task packs the entries for each
hash range into one binary value, Spark moves a few large values, and the receiving task
concatenates arrays. Every entry is still dealt by its own hash, so a frequent key is summed
in the map task first and never gathers more than one entry per map flush.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word.
SPACE = r"\x20\x09-\x0D"
#: Words a worker's hash cache holds before it is emptied.
CACHE_WORDS = 600_000
#: Entries a map task buffers before it flushes blocks.
FLUSH_ENTRIES = 2_000_000


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sluice-{uuid.uuid4().hex}"


def _context_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


#: Spark's setting that drops an action's shuffle files when it ends.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back. Its shuffle files go with the write, which nothing else reads them for."""
    spark = df.sparkSession
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df into a new shared scratch folder and read it back: lineage ends there."""
    return _written(df, f"{scratch_dir(df.sparkSession)}/{name}")


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems keep it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that an operator needs only until its result is written: they go when the block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.dir, self.n = spark, scratch_dir(spark), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        dropped(self.spark, self.dir)

    def saved(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        return _written(df, f"{self.dir}/{self.n}-{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the cluster's knob for task size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """id, UTF-8 bytes of the text (null: empty) and more columns, under fixed names."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        *[F.col(c) for c in more],
    )


class WordHashes:
    """64-bit hashes of words, cached per worker."""

    def __init__(self) -> None:
        self.of: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        of = self.of
        if len(of) > CACHE_WORDS:
            of.clear()
        try:
            return np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            for w in set(words):
                if w not in of:
                    of[w] = digest(w)
            return np.fromiter(map(of.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; fixed multipliers of a public mixer."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def blocks_of(keys: np.ndarray, n_blocks: int, order: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(block, indices of its entries) by the high bits of 64-bit keys; keys need no order."""
    block = ((keys >> np.uint64(40)) % np.uint64(n_blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(n_blocks + 1))
    for b in range(n_blocks):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def dealt(df: DataFrame, n_blocks: int) -> DataFrame:
    """Deal block rows to as many partitions as there are blocks."""
    return df.repartition(n_blocks, F.col("block"))


def read_blocks(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    """All entries of a partition's block rows."""
    got = [np.frombuffer(x, kind) for b in batches for x in b.column("payload").to_pylist()]
    return np.concatenate(got) if got else np.empty(0, kind)


def byte_lower_words(text: bytes) -> list[bytes]:
    """Words of the text with A-Z lowered; other letters stay as they are."""
    return text.lower().split()


def native_words(text: Column) -> Column:
    """Array of words (SPACE splits); empty for null or blank text."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) > 0, F.split(bare, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))
