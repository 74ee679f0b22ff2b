"""Committing turns and experience as they arrive, and event telemetry over time windows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyglass.operators.memory import merged


def commit_experience(arriving: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Add a stream of (db, question, sql, frequency, at) to the store, one folder of merged increments a batch.

    A batch writes its own rows only, already merged among themselves, under a name of the checkpoint and the batch: a
    retried batch overwrites itself, and a stream with another checkpoint adds beside it. read_experience() merges on
    reading, compact_experience() for good.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        merged(batch.limit(0), batch).write.mode("overwrite").parquet(f"{store}/stream={stream}/batch={number}")

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_experience(spark: SparkSession, store: str) -> DataFrame:
    """The store's exemplars: all increments, merged by (db, question)."""
    parts = spark.read.parquet(store).drop("stream", "batch")
    return merged(parts.limit(0), parts)


def compact_experience(spark: SparkSession, store: str, into: str) -> None:
    """All increments as one, in a new store."""
    read_experience(spark, store).write.mode("overwrite").parquet(f"{into}/stream=compacted/batch=0")


def event_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, event_type, n, total: tumbling windows with a watermark; a batch table gives the same rows."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    found = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
