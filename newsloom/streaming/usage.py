"""Usage by day as a stream: event-time windows under a declared watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_windows(usage: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Calls and failures per window and task; rows later than ``late`` are left out of a stream."""
    seen = usage.withWatermark("created_at", late)
    by = seen.groupBy(F.window("created_at", width).alias("w"), "task_type").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"))
    return by.select(F.col("w.start").alias("start"), "task_type", "calls", "failures")
