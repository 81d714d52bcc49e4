"""Tumbling-window statistics of an unbounded signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_stats(stream: DataFrame, at: str, size: str, late: str, by: list[str]) -> DataFrame:
    """(by, start, n, mean, rms) of event-time windows; rows later than ``late`` are dropped, so state is bounded."""
    v = F.col("value")
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms")).select(*by, F.col("w.start").alias("start"), "n", "mean", "rms")
