"""Vectorised text primitives on Arrow buffers: words, rolling hashes, slices of bounded size.

Hashes are polynomial over bytes (or over word hashes) modulo 2**64 with odd multipliers, then mixed. They identify
words and windows within one table; callers that need certainty compare the words too.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = 0x20
BASE = 0x9E3779B97F4A7C15  # odd
STEP = 0xC2B2AE3D27D4EB4F  # odd
#: Text bytes that are worked on at once in a Python worker.
SLICE_BYTES = 2 << 20


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker does, across tasks."""
    return sys.modules.setdefault("_tidegrid_worker_cache", types.ModuleType("_tidegrid_worker_cache")).__dict__


def table_white(lower: bool) -> np.ndarray:
    """Byte table for words ``[^\\x20\\x09-\\x0D]+``: white space becomes a blank; A-Z are lowered on request."""
    t = np.arange(256, dtype=np.uint8)
    t[0x09:0x0E] = SPACE
    if lower:
        t[0x41:0x5B] += 32
    return t


def table_alnum() -> np.ndarray:
    """Byte table for words of lower-cased ASCII letters, digits and all characters beyond ASCII."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    for a, b in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
        t[a:b] = SPACE
    return t


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows whose text is about ``most`` bytes (one row at least): first row, end row, bytes, offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end
    tidy()


def tidy() -> None:
    """Gives freed memory back, so that a reused worker doesn't stay at its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """The words of consecutive texts. ``start`` and ``end``: byte positions in ``data``; ``first``: by text, its first
    word (one more entry at the end); ``doc``: the text of each word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        self.data = table[data]
        solid = self.data != SPACE
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        edges = bounds[:-1][bounds[:-1] < len(data)]
        before[edges] = False
        self.start = np.flatnonzero(solid & ~before)
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        last = bounds[1:][bounds[1:] > 0] - 1
        after[last] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        self.solid = solid

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        # Powers are kept per residue of the position inside a word: hash = sum of value(byte) * BASE**(offset in word).
        length = self.end - self.start
        out = np.zeros(len(self.start), np.uint64)
        at, power, step = 0, np.uint64(1), np.uint64(BASE)
        values = byte_values()
        active = np.arange(len(self.start))
        longest = int(length.max())
        with np.errstate(over="ignore"):
            while at < min(longest, 24):
                active = active[length[active] > at] if at else active
                out[active] += values[self.data[self.start[active] + at]] * power
                power *= step
                at += 1
            for i in np.flatnonzero(length > at):  # the few words of more bytes
                rest = self.data[self.start[i] + at : self.end[i]]
                p = np.cumprod(np.full(len(rest), step, np.uint64)) * power
                out[i] += (values[rest] * p).sum(dtype=np.uint64)
            return mix(out + length.astype(np.uint64) * np.uint64(STEP))

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive), joined by one blank."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def byte_values() -> np.ndarray:
    """256 fixed pseudo-random odd numbers, from a rule."""
    return mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes, by first word; they may cross texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, power = np.zeros(n, np.uint64), np.uint64(1)
        for i in range(size):
            out += words[i : i + n] * power
            power *= np.uint64(STEP)
        return mix(out + np.uint64(size))


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point of UTF-8."""
    return (data & 0xC0) != 0x80
