"""Streams: fixed-frequency bins with late data, and range checks with fitted bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..operators.validation import OutsideRangeValidator


def binned(stream: DataFrame, time_col: str, value_col: str, freq: str, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """``start`` and count, mean, smallest and largest value of each bin and key; rows later than ``late`` are dropped.
    On a plain table the result is the same with nothing dropped."""
    rows = stream.withColumn(time_col, col(time_col).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark(time_col, late)
    found = rows.groupBy(F.window(col(time_col), freq).alias("w"), *[col(c) for c in by])
    out = found.agg(F.count(col(value_col)).alias("n"), F.avg(col(value_col)).alias("mean"), F.min(col(value_col)).alias("least"), F.max(col(value_col)).alias("most"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "mean", "least", "most")


def checked(stream: DataFrame, validator: OutsideRangeValidator) -> DataFrame:
    """A stream with values outside fitted bounds missing; no state is kept."""
    return validator.transform(stream)
