"""Frames as they arrive. Lifting and per-frame counts need one frame only, so they run on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_points(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16, sep: str = ",") -> DataFrame:
    """CSV files of detections, each new file once."""
    return spark.readStream.schema(schema).option("header", True).option("sep", sep).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def stream_counts(points: DataFrame, key: str = "cell_id", delay: int | None = None, frame_seconds: int = 60) -> DataFrame:
    """Counts by key and frame. With delay, frames that lie that many frames behind the latest one are closed: they can be appended
    to a table, rows that come in a later batch are dropped, and their state is forgotten. Without it counts run for ever, and so does their state."""
    if delay is None:
        return points.groupBy(key, "t").agg(F.count("*").alias("n"))
    ends = points.withColumn("_end", F.timestamp_seconds((F.col("t").cast("long") + 1) * frame_seconds)).withWatermark("_end", f"{delay * frame_seconds} seconds")
    return ends.groupBy("_end", key, "t").agg(F.count("*").alias("n")).select(key, "t", "n")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that writes Parquet and ends when what is there has been read."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
