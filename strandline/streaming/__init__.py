"""Incremental refresh: counts of newly arrived scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(scenes: DataFrame, at: str = "ts", late: str = "7 days", width: str = "1 day") -> DataFrame:
    """A streaming count and mean value of scenes in tumbling windows; late rows within the watermark still count."""
    return scenes.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select("w.start", "w.end", "n", "mean_value")
