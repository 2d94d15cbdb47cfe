"""Structured Streaming over events: windows, sessions, late data (beyond batch parity).

Event times are timestamps without zone and become UTC timestamps first, as
watermarks need them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, late: str = "1 hour", files: int = 10) -> DataFrame:
    """A stream of Parquet files of events with a watermark."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; partial sums before the shuffle."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions by user; an event exactly at the gap joins the session before it."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    """Repeated deliveries go, within the watermark: the state is bounded."""
    return events.dropDuplicatesWithinWatermark(["event_id"])
