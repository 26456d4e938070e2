"""Windows over event time, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """The frame with a time-zoned event time and a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggregates: list[Column], *, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates by key and window of ``width`` (hopping by ``slide``): columns window_start, window_end, keys, aggregates."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = _timed(df, ts, late).groupBy(window.alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], *, late: str = "10 minutes") -> DataFrame:
    """Aggregates by key and session: runs of rows less than ``gap`` apart."""
    out = _timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def deduplicate(df: DataFrame, ts: str, keys: list[str], *, late: str = "10 minutes") -> DataFrame:
    """The first row seen of each key within the watermark."""
    timed = _timed(df, ts, late)
    return timed.dropDuplicatesWithinWatermark(keys) if df.isStreaming else timed.dropDuplicates(keys)
