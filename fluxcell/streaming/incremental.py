"""Additive statistics over event streams: the batch aggregates that a stream can keep up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``(start, state, n, total)`` per tumbling window and state; rows later than ``late`` are dropped
    when the source is a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", window).alias("w"), "state").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "state", "n", "total")


def windowed_moments(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean and population variance of the value in each window and state."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", window).alias("w"), "state").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return g.select(F.col("w.start").alias("start"), "state", "m", "v")
