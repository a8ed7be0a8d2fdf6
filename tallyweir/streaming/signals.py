"""Telemetry as streams: an extension of the batch readers, which know none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reports import SIGNALS, valid_signal


def signal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Signals with window_end from JSON lines that arrive in a folder; invalid ones have a reason instead of failing the stream."""
    rows = spark.readStream.schema(f"window_end timestamp, {SIGNALS}").json(folder)
    return rows.withColumn("reason", F.when(F.col("window_end").isNull(), "no window end").when(~F.coalesce(valid_signal(), F.lit(False)), "invalid signal"))


def latest_breaches(signals: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Signals and breaches of each service and window of event time; a repeated delivery counts once.

    State is bounded by the watermark: windows older than ``late`` are closed.
    """
    good = signals.filter("reason is null").withWatermark("window_end", late).dropDuplicatesWithinWatermark(["id", "window_end"])
    return good.groupBy(F.window("window_end", window), "service").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "breached").alias("breached")).select(F.col("window.start").alias("start"), "service", "n", "breached")


def event_rates(spark: SparkSession, folder: str, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Events of each type and day from parquet files that arrive in a folder."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))
    return rows.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")
