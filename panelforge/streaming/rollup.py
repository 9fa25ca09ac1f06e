"""Weeks and months of bars, from a panel or a stream of bars.

Weeks are event-time windows from Monday, closed by the watermark (append); months have no
fixed length, so they are groups by their first day and a stream updates them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folded(grouped):
    first, last = F.min_by("open", "date").alias("open"), F.max_by("close", "date").alias("close")
    return grouped.agg(first, F.max("high").alias("high"), F.min("low").alias("low"), last, F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"))


def weekly(bars: DataFrame, late: str = "7 days") -> DataFrame:
    """ticker, week (its Monday), open, high, low, close, volume, n_bars; bars later than late may be left out of a stream."""
    rows = bars.withColumn("_ts", F.col("date").cast("timestamp")).withWatermark("_ts", late)
    week = F.window("_ts", "7 days", startTime="4 days")  # the epoch was a Thursday
    return _folded(rows.groupBy("ticker", week.alias("_w"))).select("ticker", F.to_date("_w.start").alias("week"), "open", "high", "low", "close", "volume", "n_bars")


def monthly(bars: DataFrame) -> DataFrame:
    """ticker, month (its first day), open, high, low, close, volume, n_bars; write a stream of it in update mode."""
    return _folded(bars.groupBy("ticker", F.trunc("date", "month").alias("month")))
