"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster has to name one."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sluice-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet and read it back: it is computed once, and lineage ends there."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fs_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it; a local one without checksum files beside ours, which others may edit."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs.getRawFileSystem() if fs.getScheme() == "file" else fs), at


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store."""
    fs, at = fs_of(spark, path)
    fs.delete(at, True)
