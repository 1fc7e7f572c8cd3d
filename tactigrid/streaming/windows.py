"""Event-time windows that run in batch and as Structured Streaming alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.operators.aggregates import exact_sum


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late else df
    x = df.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), exact_sum(value).alias("total"))
    return x.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, ts: str, width: str, slide: str, by: list[str], late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late else df
    return df.groupBy(F.window(ts, width, slide), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late else df
    x = df.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("session_window.start").alias("start"), *by, "n")


def deduplicated(df: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """A stream without repeated keys, as far as the watermark looks back."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
