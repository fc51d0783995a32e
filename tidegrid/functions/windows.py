"""Window specifications over series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .durations import micros
from .names import col


def ordered(by: Sequence[str], order: Sequence[str] | str) -> WindowSpec:
    """A series' rows in order."""
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*[col(c) for c in by]).orderBy(*[col(c) for c in order])


def turned(by: Sequence[str], order: Sequence[str] | str) -> WindowSpec:
    """A series' rows from the last to the first."""
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*[col(c) for c in by]).orderBy(*[col(c).desc() for c in order])


def last_rows(by: Sequence[str], order: Sequence[str] | str, n: int) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def last_span(by: Sequence[str], time: str, us: int) -> WindowSpec:
    """Rows of the span ``(t - us, t]``."""
    return Window.partitionBy(*[col(c) for c in by]).orderBy(micros(col(time))).rangeBetween(-(us - 1), 0)


def before(value: Column, w: WindowSpec) -> Column:
    """The last value that is not missing, up to this row."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def after(value: Column, back: WindowSpec) -> Column:
    """The first value that is not missing, from this row on, by the turned order (a frame that only grows)."""
    return before(value, back)


def interpolated(value: Column, place: Column, w: WindowSpec, back: WindowSpec) -> Column:
    """Missing values filled linearly by place; leading gaps stay, trailing gaps hold the last value."""
    known = F.when(value.isNotNull(), F.struct(place.cast("double").alias("t"), value.cast("double").alias("x")))
    a, b, t = before(known, w), after(known, back), place.cast("double")
    return F.when(value.isNotNull(), value.cast("double")).when(a.isNull(), None).when(b.isNull(), a["x"]).otherwise(a["x"] + (b["x"] - a["x"]) * (t - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0)))
