"""Event-time windows over streams or tables. An extension: each function takes either kind of DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, lateness: str | None) -> DataFrame:
    return df.withWatermark(time, lateness) if df.isStreaming and lateness else df


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], aggs: dict[str, Column], slide: str | None = None, lateness: str | None = "10 minutes") -> DataFrame:
    """Aggregates of fixed windows, overlapping if they slide: (start, end, *keys, *aggs). Rows later than `lateness` are left out of streams."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = _late(df, time, lateness).groupBy(w.alias("__w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *keys, *aggs)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: dict[str, Column], lateness: str | None = "10 minutes") -> DataFrame:
    """Aggregates of stretches of a key's rows without a gap: (start, end, *keys, *aggs)."""
    out = _late(df, time, lateness).groupBy(F.session_window(time, gap).alias("__w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *keys, *aggs)
