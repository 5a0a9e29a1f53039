"""Popularity of items kept up to date from a stream of events: the batch operator's sums as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def popularity_stream(events: DataFrame, weight: float = 0.1, window: str | None = None, delay: str = "1 day") -> DataFrame:
    """(item, popularity) of (item, ts, kind) events; with a window, also its start, closed once events are later than the delay."""
    points = F.when(F.col("kind") == "purchase", 1.0).when(F.col("kind").isin("view", "click"), weight).otherwise(0.0)
    keys = ["item"]
    if window:
        events = events.withWatermark("ts", delay)
        keys = [F.window("ts", window).alias("w"), "item"]
    out = events.where("kind in ('purchase', 'view', 'click')").groupBy(*keys).agg(F.sum(points).alias("popularity"))
    return out.select(F.col("w.start").alias("start"), "item", "popularity") if window else out
