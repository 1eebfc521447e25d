"""Streaming counters over the events table: an extension for live interaction data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events as a stream, time as a zoned timestamp (watermarks need one)."""
    schema = spark.read.parquet(path).schema
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isFile():  # a stream reads a folder
        reader, path = reader.option("pathGlobFilter", there.getName()), there.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(rows: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than ``late`` are dropped in a stream."""
    marked = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def popularity(rows: DataFrame) -> DataFrame:
    """Running counts of each user and type."""
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    marked = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
