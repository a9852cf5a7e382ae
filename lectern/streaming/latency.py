"""Latency over event-time windows, for streams and tables alike (an extension: the last-minute mean as a window)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_windows(events: DataFrame, ts: str, value: str, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """(start, n, mean) of each window; in a stream, rows later than `late` behind the newest are dropped and state is bounded by it."""
    seen = events.withWatermark(ts, late) if events.isStreaming else events
    found = seen.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return found.select(F.col("w.start").alias("start"), "n", "mean")
