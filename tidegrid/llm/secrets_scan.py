"""Secret scans: fixed patterns, and a sliding-window entropy test over candidate strings.

The fixed patterns find assignments, access keys and long hexadecimal runs. The entropy test takes every run of token
characters of ``LEAST`` characters or more as a candidate and slides one window over it for each character class. The
window's Shannon entropy is kept by counts that each step changes by one character in and one out. A candidate with a window
above its class's threshold is a span as a whole, since a secret's ends may look plainer than its middle, unless an allow-list
pattern covers it or a fixed pattern's span holds it. The thresholds are about the hundredth part of the entropies of random
strings of the class. Measured on random strings, 0.9 of those of 16 characters are found in every class and nearly all of 20
and more (a test holds this); shorter ones never.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; overlapping kinds are all
reported; rows with a null or repeated ``doc_id`` are judged each by itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Any assignment holds one of these in lower case.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class CharClass:
    """A character class: its members, the window, the least entropy in bits, and least counts of kinds of members."""

    name: str
    members: frozenset[str]
    window: int
    bits: float
    digits: int
    lower: int
    upper: int


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("hex", frozenset(_DIGITS + "abcdef"), LEAST, 2.65, 5, 2, 0),
    CharClass("upper hex", frozenset(_DIGITS + "ABCDEF"), LEAST, 2.65, 5, 0, 2),
    CharClass("upper", frozenset(_DIGITS + _UPPER), LEAST, 3.15, 2, 0, 4),
    CharClass("lower", frozenset(_DIGITS + _LOWER), LEAST, 3.15, 2, 4, 0),
    CharClass("base64", frozenset(_DIGITS + _LOWER + _UPPER + "+/_=-"), LEAST, 3.37, 1, 2, 2),
)
#: Candidates that match one of these wholly are no secrets: UUIDs, digests named as such, dates and plain numbers.
ALLOWED = (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(sha(1|256|384|512)|md5)[-=].*", r"[0-9+/_=-]+", r"(0123456789)?(abcdefghijklmnopqrstuvwxyz)?(ABCDEFGHIJKLMNOPQRSTUVWXYZ)?(0123456789)?")


def entropy_runs(text: str, kind: CharClass) -> list[tuple[int, int]]:
    """Spans of ``text`` covered by windows of the class that reach its entropy; counts change by one step at a time."""
    size, least = kind.window, kind.bits
    plogp = [0.0, *(k * math.log2(k) for k in range(1, size + 1))]
    counts: dict[str, int] = {}
    total, held, digits, lower, upper = 0.0, 0, 0, 0, 0
    out: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        if c not in kind.members:
            counts.clear()
            total, held, digits, lower, upper = 0.0, 0, 0, 0, 0
            continue
        k = counts.get(c, 0)
        total += plogp[k + 1] - plogp[k] if k < size else 0.0
        counts[c] = k + 1
        held += 1
        digits, lower, upper = digits + ("0" <= c <= "9"), lower + ("a" <= c <= "z"), upper + ("A" <= c <= "Z")
        if held > size:
            x = text[i - size]
            k = counts[x]
            counts[x] = k - 1
            total -= plogp[k] - plogp[k - 1] if k <= size else 0.0
            held -= 1
            digits, lower, upper = digits - ("0" <= x <= "9"), lower - ("a" <= x <= "z"), upper - ("A" <= x <= "Z")
        if held == size and digits >= kind.digits and lower >= kind.lower and upper >= kind.upper and math.log2(size) - total / size >= least:
            if out and out[-1][1] >= i - size + 1:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - size + 1, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The fixed patterns' spans as (start, place of the kind, end)."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def allow_list(patterns: Sequence[str]) -> re.Pattern:
    """One pattern of an allow-list; an empty list allows nothing."""
    return re.compile("|".join(f"(?:{x})" for x in patterns) or r"(?!)")


def all_spans(text: str, classes: Sequence[CharClass] = CLASSES, allowed: re.Pattern | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the fixed patterns, and all spans, both in order."""
    allowed = allowed or allow_list(ALLOWED)
    base = sorted(base_spans(text))
    more: list[tuple[int, int, int]] = []
    for m in CANDIDATE.finditer(text):
        own = m.group()
        if not DIGIT.search(own) or allowed.fullmatch(own):
            continue
        if any(entropy_runs(own, kind) for kind in classes):
            more.append((m.start(), 3, m.end()))
    if more and base:  # both are in order; ends of the fixed spans that begin no later show whether any holds it
        starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
        more = [s for s in more if not (k := bisect_right(starts, s[0])) or reach[k - 1] < s[2]]
    return base, sorted(base + more)


def written(spans: Sequence[tuple[int, int, int]]) -> str:
    """``kind:start:end``, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame, *, text_col: str = "text", classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """By row ``doc_id``, counts of the fixed kinds, the digest of their spans, all spans, and their number. ``allowed``:
    patterns of candidates that are no secrets."""
    shared, kinds = tuple(allowed), tuple(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = allow_list(shared)
        for batch in batches:
            found = [all_spans(t or "", kinds, allow) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(3)]
            sha = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([written(x) for _, x in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; a column ``n_chars`` follows the text."""
    small_batches(docs.sparkSession)
    names, kind = docs.columns, docs.schema
    k = names.index(text_col)
    shared, own = tuple(allowed), tuple(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = allow_list(shared)
        for batch in batches:
            texts = batch.column(k).to_pylist()
            changed = False
            for i, t in enumerate(texts):
                _, spans = all_spans(t or "", own, allow)
                if spans:
                    changed, parts, at = True, [], 0
                    for a, _, b in spans:
                        if a >= at:
                            parts += [t[at:a], mark]
                        at = max(at, b)
                    texts[i] = "".join([*parts, t[at:]])
            yield batch.set_column(k, names[k], pa.array(texts, batch.column(k).type)) if changed else batch

    out = docs.mapInArrow(run, kind)
    return out.withColumn("n_chars", F.length(text_col).cast(kind["n_chars"].dataType)) if "n_chars" in names else out
