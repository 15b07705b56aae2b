"""Structured Streaming forms of the operators that suit endless input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def line_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New transcript files as they arrive, as lines."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))


def deduplicated(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once while its watermark lasts; state is dropped behind the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and group, with late data up to the watermark."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def session_gaps(events: DataFrame, key: str, at: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Runs of events with no pause longer than ``gap``; the same plan for tables and streams."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n_events")).select(key, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n_events")


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, then stop; exactly once into Parquet through the checkpoint."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
