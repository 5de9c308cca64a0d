"""Incremental discovery: new dump files as a stream, each parsed once, with Trigger.AvailableNow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.sources.mixed import GLOB, read_rows


def new_rows(spark: SparkSession, root: str) -> DataFrame:
    """A streaming DataFrame of rows of .sql and .xlsx files that appear below root."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(root)
    return read_rows(files.select("path", "content"))


def ingest_available(spark: SparkSession, root: str, out: str, checkpoint: str) -> None:
    """Append rows of files not seen yet to Parquet at out, then stop."""
    new_rows(spark, root).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
