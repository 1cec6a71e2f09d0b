"""Audit events as a stream: windows with a watermark, deduplication, an exactly-once append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def counts(events: DataFrame, ts: str, kind: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by tumbling (or sliding) window and kind; what comes later than the watermark is dropped."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(window, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def once(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are forgotten after the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, then stop; the checkpoint makes a repeat of a batch write nothing twice."""
    return events.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)
