"""The recent-memory count over a stream: per window, how many memories came in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time_col: str = "ts", key_col: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n), final once the watermark, ``late`` behind the newest time, has passed a window.

    State is one counter per open window and key; rows later than that are dropped by Spark.
    On a table that isn't a stream the watermark has no effect and all rows count.
    """
    counted = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "key", "n")
