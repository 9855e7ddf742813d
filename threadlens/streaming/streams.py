"""Structured Streaming: incremental ingestion and windowed, deduplicated event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import PROVIDER_A


def event_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Parquet files of a folder as a stream; the schema comes from a static read."""
    return spark.readStream.schema(like.schema).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their value by window and type; late rows beyond the watermark are dropped, unless the stream's output is complete."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of a user's events with no gap longer than given."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now into Parquet, and end; the checkpoint makes each file count once."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def follow_transcripts(spark: SparkSession, root: str, checkpoint: str, each: Callable[[DataFrame, int], None], max_files: int | None = None) -> StreamingQuery:
    """New transcript files as micro-batches of whole files; modified ones are found by cursors instead (see sources)."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(root).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.unix_timestamp("_metadata.file_modification_time").alias("mtime_unix"), F.lit(PROVIDER_A).alias("provider"), F.lit("legacy").alias("account"))
    query = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
