"""Event-time windows.  Sizes and lateness are this library's own choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late an event may come.
LATENESS = "10 minutes"


def _counted(events: DataFrame, window) -> DataFrame:
    late = events.withWatermark("ts", LATENESS) if events.isStreaming else events
    found = late.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "event_type", "n", "total")


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return _counted(events, F.window("ts", size))


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    return _counted(events, F.window("ts", size, step))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, w_start, w_end, n): events of a user with no longer pause than ``gap``."""
    late = events.withWatermark("ts", LATENESS) if events.isStreaming else events
    found = late.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n")


def alerts(rates: DataFrame, threshold: float, periods: int) -> DataFrame:
    """Windows (w_start, rate) in which the rate has been over the threshold for so many windows in a row."""
    from pyspark.sql import Window

    order = Window.partitionBy("series").orderBy("w_start").rowsBetween(1 - periods, 0)
    over = F.col("rate") > threshold
    return rates.withColumn("firing", (F.min(over.cast("int")).over(order) == 1) & (F.count("*").over(order) == periods))
