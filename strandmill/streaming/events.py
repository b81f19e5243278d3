"""Structured Streaming counters over event files: late-data windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Events as a stream of Parquet files, schema taken from what is there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, events, value): tumbling windows; events later than ``late`` are left out."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(session, user_id, events): runs of a user's events with no longer pause than ``gap``."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))


def run_to_table(stream: DataFrame, checkpoint: str, name: str) -> DataFrame:
    """Run a streaming aggregate over what is there and return the complete result as a table."""
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
