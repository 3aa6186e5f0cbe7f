"""Structured Streaming forms of the summaries: an extra beside the batch engine.

State is bounded by the watermark: late rows beyond it are dropped by Spark, and windows
before it leave the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(events: DataFrame, time: str, keys: list[str], value: str, window: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, end, keys, n, sum, mean, min, max) per window of event time; works on
    streams (append mode) and, with the same result, on tables."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    x = F.col(value).cast("double")
    out = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(x).alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "sum", "mean", "min", "max")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, keys, n) of runs of events with no longer pause than ``gap``."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
