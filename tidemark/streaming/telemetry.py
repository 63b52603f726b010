"""Telemetry and rolling counts, the same code for batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling(events: DataFrame, size: str, group: str, item: str, ts: str = "ts", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, group, users): distinct items in windows of time; on a stream the watermark bounds the state and the
    distinct count is approximate, as exact ones can't be kept."""
    count = F.approx_count_distinct(item) if events.isStreaming else F.count_distinct(item)
    src = events.withWatermark(ts, late) if events.isStreaming and late else events
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    return src.groupBy(w.alias("w"), group).agg(count.alias("users")).select(F.col("w.start").alias("start"), group, "users")


def aggregates(events: DataFrame, late: str = "1 hour", every: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Per time window, finding type and language: n, means and mean absolute error; times cut to seconds."""
    e = events.withColumn(ts, F.date_trunc("second", ts))
    e = e.withWatermark(ts, late) if events.isStreaming else e
    err = F.abs(F.col("predicted_delta") - F.col("actual_delta"))
    return e.groupBy(F.window(ts, every).alias("w"), "smell_type", "language").agg(F.count("*").alias("n"), F.avg("predicted_delta").alias("mean_predicted"), F.avg("actual_delta").alias("mean_actual"), F.avg(err).alias("mae"))


def append(batch: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    batch.write.mode("append").json(path)
