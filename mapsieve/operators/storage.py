"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process has written there.
_held: list[str] = []


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a folder of this machine if all of Spark runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints/mapsieve"
    _held.append(f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return _held[-1]


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, so that what is read from it does not change when a task runs again."""
    path = shared_path(df.sparkSession, "s")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file through Spark's file system for the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content))
    out.close()


def release(spark: SparkSession) -> None:
    """Delete what this process has written; results that still read it must have been written elsewhere before."""
    while _held:
        at = spark._jvm.org.apache.hadoop.fs.Path(_held.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
