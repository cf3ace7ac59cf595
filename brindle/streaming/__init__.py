"""Structured Streaming: event-time windows, deduplication and sinks that run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files with a bounded number of files for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Count by event-time window; state older than the watermark is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there as a Parquet sink with a checkpoint (exactly once), then stop."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def run_in_memory(df: DataFrame, mode: str) -> DataFrame:
    """For small results: the final table of a streaming query, through the memory sink."""
    name = f"s_{uuid.uuid4().hex[:12]}"
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)
