"""Windowed event metrics that run alike over a batch and over a stream, and incremental upkeep of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    by = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    by = events.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    by = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, late: str = "2 hours") -> DataFrame:
    """A file stream of events with a watermark, repeated events dropped within it."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def maintain(base: DataFrame, batch: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """base(file_path, ...) after a batch: rows of its files are evicted, then its own added; removed(file_path) only go."""
    gone = batch.select("file_path") if removed is None else batch.select("file_path").unionByName(removed.select("file_path"))
    return base.join(gone.distinct(), "file_path", "left_anti").unionByName(batch)
