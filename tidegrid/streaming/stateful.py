"""Features of streams that need a series' past: lags, rolling windows, flat lines, and incidents that bridge gaps.

Rows of a series wait in state until the watermark has passed them, so late rows find their place; a timer then takes them in
order. Behind them only the last values that windows reach are kept, and the rows of a gap that may still be bridged. An entry of the
state holds many rows, as each costs a call to the store; state of an earlier form isn't read. The
results are those of the batch operators over the same rows (those that are too late, and those that still wait, left out).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import ranges
from ..functions.durations import micros
from ..functions.names import col

#: Rows in an entry of the state, at most.
ENTRY = 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    """Sets the state store that these operators need, for the session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


@dataclass(frozen=True)
class Wanted:
    """What to add to each row. ``lags``: rows back; ``rolling``: aggregates of the last rows, as ``(kind, rows)``; ``flat``:
    ``(rows, margin)`` of flat lines, whose first rows are not flagged; ``limits``: values outside are outliers, and
    ``max_gap`` rows between two of them are bridged."""

    lags: tuple[int, ...] = ()
    rolling: tuple[tuple[str, int], ...] = ()
    flat: tuple[int, float] | None = None
    limits: tuple[float, float] | None = None
    max_gap: int = 0

    def names(self) -> list[str]:
        """The new columns."""
        return [f"lag_{n}" for n in self.lags] + [f"{k}_{n}" for k, n in self.rolling] + ["flat"] * (self.flat is not None) + ["incident"] * (self.limits is not None)

    def reach(self) -> int:
        """Rows before a row that its features need."""
        return max([0, *self.lags, *(n - 1 for _, n in self.rolling), *((self.flat[0] - 1,) if self.flat else ())])

    def made(self, x: np.ndarray, first: int) -> list[list]:
        """By feature but the incident, the values of the rows from ``first`` on; NaN is a missing value."""
        n, there = len(x), ~np.isnan(x)
        i, out = np.arange(first, n), []
        values = np.where(there, x, 0.0)
        for lag in self.lags:
            out.append([None if k < lag or not there[k - lag] else float(x[k - lag]) for k in i])
        for kind, size in self.rolling:
            v, ok = ranges.rolling(kind, size)(values, there, np.maximum(i - size + 1, 0), i + 1)
            out.append([float(a) if b else None for a, b in zip(v, ok, strict=True)])
        if self.flat:
            size, margin = self.flat
            (low, ok), (high, _) = (ranges.rolling(k, size)(values, there, np.maximum(i - size + 1, 0), i + 1) for k in ("min", "max"))
            out.append([bool(o and b - a <= margin) for a, b, o in zip(low, high, ok, strict=True)])
        return out


class SeriesProcessor(StatefulProcessor):
    """One series: ``waiting`` rows, ``past`` values, the ``gap``'s rows with their features, and the incident's number."""

    def __init__(self, wanted: Wanted, keys: Sequence[str], ties: int, columns: Sequence[str]):
        self.wanted, self.keys, self.ties, self.columns = wanted, list(keys), ties, list(columns)

    def init(self, handle) -> None:
        """Opens the state."""
        ties = "".join(f", o{i} long" for i in range(self.ties))
        kinds = ", ".join(f"f{i} {'boolean' if n == 'flat' else 'double'}" for i, n in enumerate(n for n in self.wanted.names() if n != "incident"))
        self.handle = handle
        self.waiting = handle.getListState("waiting", "cells binary")
        self.past = handle.getValueState("past", "cells binary")
        self.gap = handle.getListState("gap", f"t long{ties}, x double" + (f", {kinds}" if kinds else ""))
        self.incident = handle.getValueState("incident", "number long, open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows wait; a timer is set for the first of them."""
        least = []
        for pdf in rows:
            *ties, x, t = (pdf.iloc[:, i] for i in range(-(self.ties + 2), 0))
            cells = np.array([*(c.astype("int64").to_numpy() for c in (t, *ties)), x.to_numpy(float, na_value=np.nan).view(np.int64)])
            if cells.size:
                self._wait(cells)
                least.append(int(cells[0].min()))
        if least:
            self.handle.registerTimer(-(-min(least) // 1000))
        return iter(())

    def _wait(self, cells: np.ndarray) -> None:
        """Adds rows to those that wait, many to an entry: times, ties and the bits of the values, one after the other."""
        self.waiting.appendList([(cells[:, i : i + ENTRY].tobytes(),) for i in range(0, cells.shape[1], ENTRY)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Takes the rows that the watermark has passed, in order."""
        until = timerValues.getCurrentWatermarkInMs() * 1000
        entries = [np.frombuffer(r[0], np.int64).reshape(self.ties + 2, -1) for r in self.waiting.get()]
        cells = np.concatenate([np.zeros((self.ties + 2, 0), np.int64), *entries], axis=1)
        ready, rest = cells[:, cells[0] <= until], cells[:, cells[0] > until]
        self.waiting.clear()
        if rest.size:
            self._wait(rest)
            self.handle.registerTimer(-(-int(rest[0].min()) // 1000))
        if ready.size:
            ready = ready[:, np.lexsort(ready[self.ties :: -1])]
            x = ready[-1].view(float)
            out = self._taken([(*r, None if v != v else v) for *r, v in zip(*ready[:-1].tolist(), x.tolist(), strict=True)])
            if out:
                yield pd.DataFrame([(*key, *r) for r in out], columns=self.columns).astype(object)

    def _taken(self, ready: list[tuple]) -> list[tuple]:
        reach = self.wanted.reach()
        before = self.past.get() if reach else None
        past = np.zeros(0) if before is None else np.frombuffer(before[0], float)
        x = np.concatenate([past, np.array([np.nan if r[-1] is None else r[-1] for r in ready], float)])
        features = self.wanted.made(x, len(past))
        if reach:
            self.past.update((x[-reach:].tobytes(),))
        rows = [(*r, *(f[i] for f in features)) for i, r in enumerate(ready)]
        if self.wanted.limits is None:
            return rows
        (low, high), number, opened = self.wanted.limits, 0, False
        if self.incident.exists():
            number, opened = self.incident.get()
        held = [tuple(r) for r in self.gap.get()] if self.gap.exists() else []
        out, at = [], self.ties + 1
        for r in rows:
            if r[at] is not None and (r[at] < low or r[at] > high):
                number += not opened
                opened = True
                out += [(*g, number) for g in held] + [(*r, number)]
                held = []
            elif opened:
                held.append(r)
                if len(held) > self.wanted.max_gap:
                    out += [(*g, 0) for g in held]
                    held, opened = [], False
            else:
                out.append((*r, 0))
        self.incident.update((number, opened))
        self.gap.put(held) if held else self.gap.clear()
        return out

    def close(self) -> None:
        """Nothing to close."""


def with_history(stream: DataFrame, time_col: str, value_col: str, by: Sequence[str], wanted: Wanted, ties: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """``by``, ``time_col``, ``ties`` (whole numbers that order rows of one time), ``value_col`` and the columns of ``wanted`` for
    each row of a stream, in append mode. A row comes out once the watermark (``late`` behind the newest time) has passed it,
    in an incident's gap once it is known whether that is bridged; rows that come later than that are dropped, as are rows
    without a time. Needs :func:`rocksdb`. The waiting rows of one series are held in a worker."""
    names = [*by, time_col, *ties, value_col, *wanted.names()]
    rows = stream.select(*[col(c) for c in by], col(time_col).cast("timestamp").alias("_at"), *[col(c).cast("long").alias(f"_o{i}") for i, c in enumerate(ties)], col(value_col).cast("double").alias("_x"))
    rows = rows.where("_at is not null").withColumn("_t", micros(F.col("_at"))).withWatermark("_at", late)
    inner = [*[f"_k{i}" for i in range(len(by))], "_t", *[f"_o{i}" for i in range(len(ties))], "_x", *[f"_f{i}" for i in range(len(wanted.names()))]]
    kinds = [rows.schema[c].dataType.simpleString() for c in by] + ["long"] * (1 + len(ties)) + ["double"] + ["long" if n == "incident" else "boolean" if n == "flat" else "double" for n in wanted.names()]
    schema = ", ".join(f"{n} {k}" for n, k in zip(inner, kinds, strict=True))
    out = rows.groupBy(*[col(c) for c in by]).transformWithStateInPandas(SeriesProcessor(wanted, by, len(ties), inner), schema, "Append", "EventTime")
    return out.withColumn("_t", F.timestamp_micros("_t")).toDF(*names)
