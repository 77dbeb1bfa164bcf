"""Windows over event time. The same functions take a batch or a stream; a stream gets a watermark first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, late: str | None, ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, size: str, by: list[str], *aggregates: Column, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """bucket (its start), the keys and the aggregates of fixed windows."""
    return sliding(events, size, size, by, *aggregates, ts=ts, late=late)


def sliding(events: DataFrame, size: str, slide: str, by: list[str], *aggregates: Column, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """The same for windows of ``size`` that begin every ``slide``."""
    grouped = watermarked(events, late, ts).groupBy(F.window(ts, size, slide).alias("_w"), *by).agg(*aggregates)
    return grouped.select(F.col("_w.start").alias("bucket"), *[c for c in grouped.columns if c != "_w"])


def sessions(events: DataFrame, gap: str, by: list[str], ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """keys, first_ts, last_ts, n: runs of events less than ``gap`` apart."""
    grouped = watermarked(events, late, ts).groupBy(F.session_window(ts, gap).alias("_w"), *by)
    return grouped.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")).drop("_w")
