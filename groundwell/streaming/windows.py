"""Event-time windows, usable on batches and streams alike (extensions beyond parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.operators.sizing import broadcast_if_small


def _late(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(ts, watermark) if watermark and df.isStreaming else df


def windowed(df: DataFrame, ts: str, size: str, keys: list[str], slide: str | None = None, watermark: str | None = "1 hour", value: str = "value") -> DataFrame:
    """(start, end, keys, n, total) per tumbling window, or hopping with ``slide``."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    agg = _late(df, ts, watermark).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], watermark: str | None = "1 hour") -> DataFrame:
    agg = _late(df, ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(df: DataFrame, keys: list[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Stream-static join to a price list, broadcast if it is small."""
    return usage.join(broadcast_if_small(prices), "event_type", "left")
