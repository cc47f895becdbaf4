"""Runs over a stream: sessions of high events, closed by a gap in time, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_runs(events: DataFrame, key: str, ts: str, holds: Column, gap: str = "1 hour", late: str = "2 hours", least: int = 2) -> DataFrame:
    """(key, start, stop, n): maximal runs in time of events where ``holds``; ``events`` may be a stream or a table."""
    kept = events.filter(holds)
    if events.isStreaming:
        kept = kept.withWatermark(ts, late)
    grouped = kept.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.filter(F.col("n") >= least).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
