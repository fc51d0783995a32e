"""Aggregates of many ranges of an array at once, in time that doesn't depend on how long the ranges are.

Sums, moments and extremes come from tables of prefixes and suffixes around middles: a range is cut where its first and last
place part in their binary digits, and is the suffix up to there joined with the prefix from there. Nothing is subtracted, so
nothing cancels. Order statistics come from a wavelet matrix over the ranks: one step a binary digit of the rank.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np


def _scanned(values: np.ndarray, present: np.ndarray, kind: str) -> tuple[np.ndarray, ...]:
    """Running parts along the last axis: (sum), (least), (largest), or count, mean and squared deviations."""
    if kind == "min":
        return (np.fmin.accumulate(np.where(present, values, np.nan), -1),)
    if kind == "max":
        return (np.maximum.accumulate(np.where(present, values, -np.inf), -1),)
    if kind == "sum":
        return (np.cumsum(np.where(present, values, 0.0), -1),)
    n = np.cumsum(present, -1)
    mean = np.cumsum(np.where(present, values, 0.0), -1) / np.maximum(n, 1)
    before = np.concatenate([np.zeros_like(mean[..., :1]), mean[..., :-1]], -1)
    # Welford's steps: each adds a square, so the sums only grow.
    step = np.where(present, (values - before) ** 2 * (n - 1) / np.maximum(n, 1), 0.0)
    return n, mean, np.cumsum(step, -1)


def _joined(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], kind: str) -> tuple[np.ndarray, ...]:
    if kind == "min":
        return (np.fmin(a[0], b[0]),)
    if kind == "max":
        return (np.maximum(a[0], b[0]),)
    if kind == "sum":
        return (a[0] + b[0],)
    n, d = a[0] + b[0], b[1] - a[1]
    share = b[0] / np.maximum(n, 1)
    mean = np.where(a[0] == 0, b[1], np.where(b[0] == 0, a[1], a[1] + d * share))
    return n, mean, a[2] + b[2] + np.where((a[0] > 0) & (b[0] > 0), d * d * a[0] * share, 0.0)


def reduced(kind: str, values: np.ndarray, present: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts of the ranges ``[low, high)``, none of them empty: ``sum``, ``min``, ``max``, or ``moments`` (count, mean, squared
    deviations). Places that are not ``present`` don't count."""
    last = high - 1
    width = 3 if kind == "moments" else 1
    out = tuple(np.zeros(len(low), np.float64) for _ in range(width))
    level = np.zeros(len(low), np.int64)
    apart = low ^ last
    while apart.any():
        level += apart > 0
        apart = apart >> 1
    levels = np.unique(level)
    size = 1 << int(levels[-1]) if len(levels) else 1
    pad = -len(values) % size
    x, ok = np.concatenate([np.where(present, values, 0.0), np.zeros(pad)]), np.concatenate([present, np.zeros(pad, bool)])
    for k in levels.tolist():
        q = np.flatnonzero(level == k)
        if k == 0:
            found = tuple(p[low[q], 0] for p in _scanned(x[:, None], ok[:, None], kind))
        else:
            half = 1 << (k - 1)
            xs, oks = x.reshape(-1, 2, half), ok.reshape(-1, 2, half)
            left = tuple(p[:, ::-1].ravel() for p in _scanned(xs[:, 0, ::-1], oks[:, 0, ::-1], kind))
            right = tuple(p.ravel() for p in _scanned(xs[:, 1], oks[:, 1], kind))
            at = (low[q] >> k) * half
            found = _joined(tuple(p[at + (low[q] & (half - 1))] for p in left), tuple(p[at + (last[q] & (half - 1))] for p in right), kind)
        for o, p in zip(out, found, strict=True):
            o[q] = p
    return out


@dataclass(frozen=True)
class Core:
    """What every range holds besides its places: rows, values, positive ones, parts by kind as of :func:`reduced`, and the
    values with their counts for order statistics. Every range goes over the place ``middle``, or up to it, or from it on."""

    rows: int
    present: int
    positive: int
    parts: Mapping[str, tuple[float, ...]]
    values: np.ndarray
    counts: np.ndarray
    middle: int


class Ranked:
    """Order statistics of ranges of values: a wavelet matrix over their ranks, with sums (if asked for) of what goes left at
    each digit. What a core holds counts in each range."""

    def __init__(self, values: np.ndarray, sums: bool = False, core: Core | None = None):
        every = values if core is None else np.concatenate([values, core.values])
        order = np.argsort(every, kind="stable")
        self.sorted = every[order]
        now = np.empty(len(every), np.int64)
        now[order] = np.arange(len(every))
        self.bits = max(1, (len(every) - 1).bit_length())
        self.core = None
        if core is not None:
            weight = np.zeros((1 << self.bits) + 1, np.int64)
            weight[now[len(values) :] + 1] = core.counts
            self.core, now = np.cumsum(weight), now[: len(values)]
        finite = np.where(np.isfinite(self.sorted), self.sorted, 0.0) if sums else None
        self.zeros, self.sums = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (now >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32 if len(now) < 2**31 else np.int64))
            if sums:
                self.sums.append(np.concatenate([[0], np.cumsum(np.where(one, 0.0, finite[now]), dtype=np.longdouble)]))
            now = np.concatenate([now[~one], now[one]])

    def _walk(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rank, total = np.zeros(len(low), np.int64), np.zeros(len(low), np.longdouble if self.sums else np.float64)
        k = k.copy()
        for level, zero in enumerate(self.zeros):
            a, b = zero[low], zero[high]
            step = 1 << (self.bits - 1 - level)
            less = b - a if self.core is None else b - a + self.core[rank + step] - self.core[rank]
            right = k >= less
            if self.sums:
                total += np.where(right, self.sums[level][high] - self.sums[level][low], 0)
            rank |= np.where(right, step, 0)
            k -= np.where(right, less, 0)
            low, high = np.where(right, zero[-1] + low - a, a), np.where(right, zero[-1] + high - b, b)
        return rank, total, k

    def place(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) of each range ``[low, high)``."""
        return self.sorted[self._walk(low, high, k)[0]]

    def least(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The sum of the ``k`` smallest finite values of each range."""
        rank, total, left = self._walk(low, high, k)
        value = self.sorted[np.minimum(rank, len(self.sorted) - 1)]
        return total + np.where((left > 0) & np.isfinite(value), value, 0.0)


def median(values: np.ndarray, low: np.ndarray, high: np.ndarray, core: Core | None = None) -> np.ndarray:
    """Medians of ranges, none of them empty."""
    own, n = Ranked(values, core=core), high - low + (core.present if core else 0)
    a, b = own.place(low, high, (n - 1) // 2), own.place(low, high, n // 2)
    return a * 0.5 + b * 0.5  # as SQL has it, to the last digit


def trimmed(values: np.ndarray, low: np.ndarray, high: np.ndarray, proportion: float) -> np.ndarray:
    """Means without ``floor(n * proportion)`` values at either end; NaN where none is left."""
    own, n = Ranked(values, True), high - low
    cut = np.floor(n * proportion).astype(np.int64)
    left = n - 2 * cut
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(left > 0, ((own.least(low, high, n - cut) - own.least(low, high, cut)) / np.maximum(left, 1)).astype(np.float64), np.nan)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    for i in np.flatnonzero((odd[high] > odd[low]) & (left > 0)):  # windows that hold an infinite value
        out[i] = np.sort(values[low[i] : high[i]])[cut[i] : n[i] - cut[i]].mean()
    return out


def first_after(times: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By query the first place in ``[low, high)`` whose time is above ``bound``, else ``high``; times rise in each range."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        below = open_ & (times[np.minimum(mid, len(times) - 1)] <= bound)
        low, high = np.where(below, mid + 1, low), np.where(open_ & ~below, mid, high)
    return low


def _with_core(kind: str, values: np.ndarray, present: np.ndarray, low: np.ndarray, high: np.ndarray, core: Core | None) -> tuple[np.ndarray, ...]:
    """As :func:`reduced` with a core, beside which a range may be empty."""
    if core is None:
        return reduced(kind, values, present, low, high)
    none = {"sum": (0.0,), "min": (np.nan,), "max": (-np.inf,), "moments": (0.0, 0.0, 0.0)}[kind]
    m = core.middle
    left = [np.append(p[::-1], e) for p, e in zip(_scanned(values[:m][::-1], present[:m][::-1], kind), none, strict=True)]
    right = [np.insert(p.astype(np.float64), 0, e) for p, e in zip(_scanned(values[m:], present[m:], kind), none, strict=True)]
    ends = _joined(tuple(p[low] for p in left), tuple(p[high - m] for p in right), kind)
    return _joined(ends, tuple(np.full(len(low), v) for v in core.parts[kind]), kind)


Kernel = Callable[..., tuple[np.ndarray, np.ndarray]]


def rolling(kind: str, least: int, proportion: float = 0.1) -> Kernel:
    """A rolling aggregate: values, which are present, and ranges, to results and which of them are there: those of at
    least ``least`` values (``numpos``: rows). ``count`` and ``rows`` are always there; ``first`` is the first row's value. What a core
    holds counts in each range (not for ``first`` and ``trimmean``)."""

    def run(values: np.ndarray, present: np.ndarray, low: np.ndarray, high: np.ndarray, core: Core | None = None) -> tuple[np.ndarray, np.ndarray]:
        seen = np.concatenate([[0], np.cumsum(present)])
        n = seen[high] - seen[low] + (core.present if core else 0)
        rows = high - low + (core.rows if core else 0)
        if kind in ("count", "rows"):
            return (n if kind == "count" else rows).astype(np.float64), np.ones(len(low), bool)
        if kind == "first":
            return values[low], present[low]
        there = (rows if kind == "numpos" else n) >= max(least, 1)
        a, b = low[there], high[there]
        out = np.zeros(len(low))
        if not len(a):
            return out, there
        with np.errstate(invalid="ignore", over="ignore"):
            if kind == "numpos":
                positive = np.concatenate([[0], np.cumsum(present & ((values > 0) | np.isnan(values)))])
                out[there] = positive[b] - positive[a] + (core.positive if core else 0)
            elif kind in ("sum", "min", "max"):
                out[there] = _with_core(kind, values, present, a, b, core)[0]
            elif kind == "mean":
                out[there] = _with_core("sum", values, present, a, b, core)[0] / n[there]
            elif kind in ("var", "std"):
                count, _, squares = _with_core("moments", values, present, a, b, core)
                there[there] = count > 1
                out[there] = (squares[count > 1] / (count[count > 1] - 1)) ** (0.5 if kind == "std" else 1)
            else:
                own = values[present]
                found = median(own, seen[a], seen[b], core) if kind == "median" else trimmed(own, seen[a], seen[b], proportion)
                out[there] = found
                if kind == "trimmean":
                    cut = np.floor(n * proportion)
                    there = there & (n - 2 * cut > 0)
        return out, there

    return run
