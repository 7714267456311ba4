"""Incremental ingest and expiring caches as streams.

The store this library serves has batch jobs only; these are the streaming forms of its
incremental run, its processing log and its cache with a time to live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream of the rows of files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append what is there now, and stop; the checkpoint remembers what is done."""
    stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()


def status_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and status of a log stream (ts, status); rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def write_status_counts(events: DataFrame, out: str, checkpoint: str, window: str = "1 hour", late: str = "2 hours") -> None:
    """Append the counts that every batch changed, with the batch's number, to a table; the watermark lets old windows go."""

    def append(rows: DataFrame, batch: int) -> None:
        # a batch that runs again after a failure takes the place of what it had written
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    counts = status_counts(events, window, late)
    counts.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_status_counts(spark: SparkSession, out: str) -> DataFrame:
    """The last count of every window and status."""
    rows = spark.read.schema("start timestamp, status string, n long, batch int").parquet(out)
    return rows.groupBy("start", "status").agg(F.max_by("n", "batch").alias("n"))


def live_entries(writes: DataFrame, seconds: int = 3600) -> DataFrame:
    """Cache entries of a stream of writes (ts, query_hash) with their expiry, each entry once."""
    return writes.withWatermark("ts", f"{seconds} seconds").dropDuplicatesWithinWatermark(["query_hash"]).withColumn("expires_at", F.col("ts") + F.make_interval(secs=F.lit(seconds)))
