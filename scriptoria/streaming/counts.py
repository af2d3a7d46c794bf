"""Windowed counts of an event stream. An addition: nothing streams in the batch analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) per window; on a stream, rows later than `late` are dropped. Works on a batch alike."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    return df.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
