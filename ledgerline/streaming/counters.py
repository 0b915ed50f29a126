"""Live counts over the upload history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_counts(history: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Records per window and status. Records later than ``late`` behind the
    newest are dropped in append and update mode."""
    timed = history.select(F.col("timestamp").cast("timestamp").alias("timestamp"), "status")
    counted = (
        timed.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", every).alias("w"), "status")
        .agg(F.count("*").alias("count"))
    )
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "count")


def live_totals(history: DataFrame) -> DataFrame:
    """Running counts by status, and the bytes of successes."""
    size = F.sum(F.when(F.col("status") == "success", F.col("size")).otherwise(F.lit(0)))
    return history.groupBy("status").agg(F.count("*").alias("count"), size.alias("size"))
