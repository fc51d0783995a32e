"""Quality rules as a learned decision list.

Exact statistics of every text (words, symbols, repeated lines, repeated eight-word windows, and a few shares for the
rules) feed an ordered list of rules. The list is learned from labelled rows by sequential covering: each rule grows by
the threshold test of the largest information gain, is pruned on a third of the rows that growing did not see, and stays
only if it is precise there; the rows it covers are set aside and the next rule is grown. The list is emitted as one
ordered Spark conditional expression over the statistics, so judging all rows needs no Python.

Defined results: a null text has no words; repeated rows are judged alike; labels without a document, null labels and
labels beyond the bounded sample are unused; without labelled rows of both kinds there are no rules and the base
verdict stands; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .textcore import Words, code_points, mix, slices, table_white, windows

#: Bound of the labelled sample that the rules are learned from (rows, by hash of the document id).
SAMPLE_ROWS = 40_000
REPEAT_WINDOW = 8
SYMBOLS = b"[#*$%&|<>]"[1:-1]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_bangs", "n_stops", "n_distinct", "n_bars")
#: Shares that rules may test: name, numerator, denominator (of ``variety`` the logarithms).
SHARES = (
    ("symbol_share", "n_symbols", "word_chars"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "n_letters"),
    ("digit_share", "n_digits", "word_chars"),
    ("bang_share", "n_bangs", "n_words"),
    ("stop_share", "n_stops", "n_words"),
    ("variety", "n_distinct", "n_words"),
    ("bar_share", "n_bars", "n_words"),
    ("word_length", "word_chars", "n_words"),
)
FEATURES = tuple(s[0] for s in SHARES)


def _by_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """By text the words that lie in a window of ``size`` words found twice or more in that text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    run = windows(hashes, size)
    if not len(run):
        return np.zeros(len(first) - 1, np.int64)
    inside = np.flatnonzero(doc[: len(run)] == doc[size - 1 :])
    with np.errstate(over="ignore"):
        key = run[inside] + mix(doc[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    twice = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    starts = inside[order[twice]]
    change = np.zeros(len(hashes) + 1, np.int64)
    change[: len(hashes)] += np.bincount(starts, minlength=len(hashes))[: len(hashes)]
    change -= np.bincount(starts + size, minlength=len(hashes) + 1)
    return _by_doc(np.cumsum(change[:-1]) > 0, first)


def statistics(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of consecutive texts."""
    w = Words(data, bounds, table_white(lower=False))
    hashes = w.hashes()
    members = np.zeros(256, bool)
    members[list(SYMBOLS)] = True
    upper = (data >= 0x41) & (data <= 0x5A)
    out = {
        "n_words": np.diff(w.first), "word_chars": _by_doc(w.solid & code_points(data), bounds), "n_symbols": _by_doc(members[data], bounds),
        "n_repeat_words": repeated_words(hashes, w.first), "n_upper": _by_doc(upper, bounds), "n_letters": _by_doc(upper | ((data >= 0x61) & (data <= 0x7A)), bounds),
        "n_digits": _by_doc((data >= 0x30) & (data <= 0x39), bounds), "n_bangs": _by_doc(data == 0x21, bounds), "n_stops": _by_doc((data == 0x2E) | (data == 0x2C), bounds),
        "n_bars": _by_doc(data == 0x7C, bounds),
    }
    order = np.lexsort((hashes, w.doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    out["n_distinct"] = np.bincount(w.doc[order][new], minlength=len(bounds) - 1)
    lines, dup = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(bounds) - 1):
        own = [x for x in data[bounds[i] : bounds[i + 1]].tobytes().split(b"\n") if x.strip()]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    return out | {"n_lines": lines, "n_dup_lines": dup}


def measured(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of every row."""
    small_batches(docs.sparkSession)
    columns = [F.col(c) for c in keep]
    fields = [docs.schema[c] for c in keep]
    kind = docs.select(*columns).schema
    for c in COUNTS:
        kind = kind.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(len(fields))):
                found = statistics(data, bounds)
                part = [batch.column(i).slice(a, b - a) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays(part + [pa.array(found[c].astype(np.int64)) for c in COUNTS], kind.names)

    return docs.select(*columns, F.col(text_col).cast("string").alias("_measured_text")).mapInArrow(run, kind)


def base_failed() -> Column:
    """Too few words, or too many inside repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def share(name: str) -> Column:
    """A share as a column over the counts; 0 where its denominator is 0."""
    _, top, bottom = next(s for s in SHARES if s[0] == name)
    if name == "variety":  # of logarithms, so that long texts are not judged by their length
        return F.when(F.col(bottom) > 0, F.log(F.col(top) + 1) / F.log(F.col(bottom) + 1)).otherwise(F.lit(0.0))
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass
class Rule:
    """A conjunction of tests ``(feature, ">=" or "<", threshold)`` and its verdict."""

    tests: list[tuple[str, str, float]] = field(default_factory=list)
    kept: bool = False

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """True for the rows that pass all tests."""
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, at in self.tests:
            hit &= x[name] >= at if sign == ">=" else x[name] < at
        return hit

    def column(self) -> Column:
        """The conjunction as a Spark condition."""
        out = F.lit(True)
        for name, sign, at in self.tests:
            out = out & (share(name) >= at if sign == ">=" else share(name) < at)
        return out


@dataclass
class DecisionList:
    """Ordered rules; rows that no rule covers are kept."""

    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """``kept`` as one ordered conditional."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(r.kept)) if out is None else out.when(r.column(), F.lit(r.kept))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """The same verdicts on arrays."""
        out, open_ = np.ones(len(next(iter(x.values()))), bool), np.ones(len(next(iter(x.values()))), bool)
        for r in self.rules:
            hit = r.covers(x) & open_
            out[hit] = r.kept
            open_ &= ~hit
        return out


def _gain(p0: float, n0: float, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))), -np.inf)


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> Rule:
    rule, inside = Rule(), np.ones(len(bad), bool)
    while len(rule.tests) < most_tests:
        p0, n0 = int(bad[inside].sum()), int((~bad)[inside].sum())
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for name in FEATURES:
            order = np.argsort(x[name][inside], kind="stable")
            v, y = x[name][inside][order], bad[inside][order]
            edge = np.flatnonzero(v[1:] > v[:-1])
            if not len(edge):
                continue
            below_p, below_n = np.cumsum(y)[edge], np.cumsum(~y)[edge]
            middle = (v[edge] + v[edge + 1]) / 2
            for sign, p1, n1 in (("<", below_p, below_n), (">=", p0 - below_p, n0 - below_n)):
                g = _gain(p0, n0, p1, n1)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (g[k], (name, sign, float(middle[k])))
        if best[1] is None:
            break
        rule.tests.append(best[1])
        inside = rule.covers(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 12, most_tests: int = 4, precision: float = 0.97, least: int = 4, seed: int = 7) -> DecisionList:
    """Sequential covering of the rows ``bad`` by precise rejecting rules."""
    out, rng = DecisionList(), np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    while len(out.rules) < most_rules and bad[left].sum() >= least:
        rows = np.flatnonzero(left)
        part = rng.permutation(len(rows)) % 3
        grow, prune = rows[part > 0], rows[part == 0]
        rule = _grown({k: v[grow] for k, v in x.items()}, bad[grow], most_tests)
        if not rule.tests:
            break
        held = {k: v[prune] for k, v in x.items()}

        def worth(r: Rule) -> float:
            hit = r.covers(held)
            p, n = int(bad[prune][hit].sum()), int((~bad)[prune][hit].sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule.tests) > 1:
            shorter = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests))]
            better = max(shorter, key=worth)
            if worth(better) < worth(rule):
                break
            rule = better
        hit = rule.covers(x) & left
        p, n = int(bad[hit].sum()), int((~bad)[hit].sum())
        # Precise on the held-out part and on all rows that are left.
        if p < least or p < precision * (p + n) or worth(rule) < 2 * precision - 1:
            break
        out.rules.append(rule)
        left &= ~hit
    return out


def learned(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, **options) -> DecisionList:
    """A decision list from labelled documents: at most ``sample_rows`` of them, those of the smallest id hashes."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")
    found = measured(own, keep=("doc_id", "quality")).where(~base_failed()).select("doc_id", "quality", *[share(n).alias(n) for n in FEATURES])
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), *[F.min(n).alias(n) for n in FEATURES]).orderBy("doc_id").limit(sample_rows).toPandas()
    if not len(found):
        return DecisionList()
    return learn({n: found[n].to_numpy() for n in FEATURES}, found["quality"].to_numpy() == 0, **options)


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``base_failed`` and ``kept`` beside the counts."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())


def filtered(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the base checks and the learned rules keep, with the columns of ``docs``."""
    rules = learned(docs, labels, **options)
    places = {f"_in{i}": c for i, c in enumerate(docs.columns)}  # the counts' names may clash with columns of docs
    inner = docs.toDF(*places)
    text = next(k for k, c in places.items() if c == "text")
    kept = judged(measured(inner, keep=tuple(places), text_col=text), rules).where("kept")
    return kept.select(*[F.col(k).alias(c) for k, c in places.items()])
