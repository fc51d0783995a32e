"""Time spans written as text, and times as microseconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"us": 1, "ms": 1000, "s": 10**6, "sec": 10**6, "min": 60 * 10**6, "t": 60 * 10**6, "h": 3600 * 10**6, "hour": 3600 * 10**6, "d": 86400 * 10**6, "day": 86400 * 10**6, "days": 86400 * 10**6, "w": 7 * 86400 * 10**6}


def duration(span: str | int) -> int:
    """Microseconds of a span such as ``"15min"``, ``"1h"`` or ``"30D"``; a number counts as microseconds."""
    if isinstance(span, int):
        return span
    parts = re.findall(r"([0-9.]*)\s*([A-Za-z]+)", span)
    if not parts or any(u.lower() not in _UNITS for _, u in parts) or re.sub(r"[0-9.]*\s*[A-Za-z]+\s*", "", span):
        raise ValueError(f"not a time span: {span!r}")
    return round(sum(float(n or 1) * _UNITS[u.lower()] for n, u in parts))


def micros(time: Column) -> Column:
    """A timestamp as microseconds since 1970 in UTC."""
    return F.unix_micros(time.cast("timestamp"))


def moment(us: Column) -> Column:
    """Microseconds since 1970 as a timestamp."""
    return F.timestamp_micros(us)
