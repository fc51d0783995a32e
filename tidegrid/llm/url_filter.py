"""URL filters: host and path rules, then a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, are counted over labelled URLs: given
ones (``labelled``), or else the table's own, by a seed labeller (rejected are hosts with a label that holds a seed word,
accepted are those without). An order is used as far as its context was seen; each is smoothed by the next shorter one
(Witten-Bell). One in ``HELD`` of the labelled URLs (by a hash of the URL) trains no model; the threshold is a quantile of
the scores of the accepted ones among these. A URL without a rule is blocked when its log-likelihood difference by
character exceeds it. Counts are summed inside tasks before they are shuffled. No count is left out: up to ``max_contexts``
entries both models are broadcast (about 100 bytes an entry); beyond it the distinct contexts and symbols of the rows
are joined with the counts, and what they add to a score is joined with the rows. Both ways add the same whole numbers,
so that scores are equal to the last bit.

Rules: a rule ``host/path`` fits its host and all subdomains if the URL's path starts with the rule's ("/" and what
follows); of those that fit, the longest wins.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed, as has
no evidence against it; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .store import persisted, scope

#: The contract's rules: verdict and rule, in natural order.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words that mark a rejected host in the seed labels.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "free", "pills", "poker", "porn", "slots", "spam", "track", "viagra", "win", "xxx")
ORDER, MAX_CONTEXTS = 4, 400_000
#: One in so many labelled URLs only calibrates the threshold.
HELD = 5
#: Contexts of so many symbols at most are broadcast in any case; the alphabet bounds them.
LOW = 2
#: Log-likelihood differences are summed as whole numbers of this part.
PARTS = 1 << 32
START, OTHER = "^", "~"
_PLAIN = set("abcdefghijklmnopqrstuvwxyz0123456789-./_")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        own, _, rest = name.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def seeded(host: Column, seeds: Sequence[str] = SEEDS) -> Column:
    """True for a host with a seed word between dots or hyphens, false for other hosts, null without a host."""
    return F.when(host != "", host.rlike(r"(?:^|[.\-])(?:" + "|".join(seeds) + r")(?=$|[.\-])"))


def symbols(url: str) -> str:
    """A URL as the models read it."""
    return START * ORDER + "".join(c if c in _PLAIN else OTHER for c in url)


def counted(rows: DataFrame) -> DataFrame:
    """``rejected, context, symbol, times`` for every order; ``rows``: ``rejected`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(own)
            rows_ = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays([*rows_, pa.array([own[k] for k in keys], pa.int64())], ["rejected", "context", "symbol", "times"])

        for batch in batches:
            for rejected, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = symbols(text)
                for i in range(ORDER, len(s)):
                    for k in range(ORDER + 1):
                        own[rejected, s[i - k : i], s[i]] += 1
            if len(own) > 500_000:  # keeps a task's memory bounded
                yield out()
                own.clear()
        yield out()

    return rows.select("rejected", "text").mapInArrow(run, "rejected boolean, context string, symbol string, times long").groupBy("rejected", "context", "symbol").agg(F.sum("times").alias("times"))


class Markov:
    """A smoothed variable-order model over symbols."""

    def __init__(self, counts: dict[str, dict[str, int]], alphabet: int = len(_PLAIN) + 1):
        self.counts, self.alphabet = counts, alphabet
        self.sums = {c: (sum(v.values()), len(v)) for c, v in counts.items()}
        self.known: dict[tuple[str, str], float] = {}

    def chance(self, context: str, symbol: str) -> float:
        """Witten-Bell: seen counts, and the shorter context's chance with the weight of the distinct symbols seen."""
        kept = self.known.get((context, symbol))
        if kept is not None:
            return kept
        shorter = self.chance(context[1:], symbol) if context else 1 / self.alphabet
        total, kinds = self.sums.get(context, (0, 0))
        out = (self.counts[context].get(symbol, 0) + kinds * shorter) / (total + kinds) if total else shorter
        if len(self.known) < 1_000_000:
            self.known[context, symbol] = out
        return out


def smoothed(own: dict[str, int], symbol: str, shorter: float) -> float:
    """Witten-Bell: seen counts, and the shorter context's chance with the weight of the distinct symbols seen."""
    total, kinds = sum(own.values()), len(own)
    return (own.get(symbol, 0) + kinds * shorter) / (total + kinds) if total else shorter


def parts(bad: float, good: float) -> int:
    """The difference of two chances' logarithms, as a whole number of parts."""
    return round((math.log(bad) - math.log(good)) * PARTS)


def collected(counts: DataFrame) -> dict[bool, dict[str, dict[str, int]]]:
    """Both models' counts on the driver, by ``rejected``."""
    out: dict[bool, dict[str, dict[str, int]]] = {False: {}, True: {}}
    for r in counts.collect():
        out[r.rejected].setdefault(r.context, {})[r.symbol] = r.times
    return out


def scores(rows: DataFrame, counts: dict, column: str = "text") -> DataFrame:
    """``rows`` with ``score``: the rejected model's mean log-likelihood less the accepted model's. Counts are broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    place, names = rows.columns.index(column), [*rows.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = Markov(shared.value[False]), Markov(shared.value[True])
        known: dict[tuple[str, str], int] = {}

        def score(text: str) -> float:
            s, total = symbols(text), 0
            for i in range(ORDER, len(s)):
                key = s[i - ORDER : i], s[i]
                d = known.get(key)
                if d is None:
                    d = parts(bad.chance(*key), good.chance(*key))
                    if len(known) < 1_000_000:
                        known[key] = d
                total += d
            return float(total) / float((len(s) - ORDER) * PARTS)

        for batch in batches:
            own = [score(t) if t else 0.0 for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.float64())], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def joined_scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """As :func:`scores`, for counts too many to broadcast; ``rows`` has a column ``text`` and is written once."""
    rows = persisted(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")  # row numbers must hold over two passes
    low = rows.sparkSession.sparkContext.broadcast(collected(counts.where(f"length(context) <= {LOW}")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                out: list[tuple[int, str, str, int]] = []
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = symbols(text)
                    out += [(row, *k, n) for k, n in Counter((s[i - ORDER : i], s[i]) for i in range(ORDER, len(s))).items()]
                columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "context", "symbol", "times"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Markov(low.value[k]) for k in (True, False)]
        for batch in batches:
            keys, out = [], []
            for context, wanted, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [dict(x or ()) for x in own]
                for symbol in wanted:
                    both = []
                    for model, longer in zip(models, (own[0::2], own[1::2]), strict=True):
                        chance = model.chance(context[ORDER - LOW :], symbol)
                        for x in longer:
                            chance = smoothed(x, symbol, chance)
                        both.append(chance)
                    keys.append((context, symbol))
                    out.append(parts(*both))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(out, pa.int64())], ["context", "symbol", "parts"])

    places = rows.select("row", "text").mapInArrow(read, "row long, context string, symbol string, times long")
    keys = places.groupBy("context").agg(F.collect_set("symbol").alias("wanted"))
    symbol = F.struct("symbol", "times")
    for n in range(LOW + 1, ORDER + 1):
        own = counts.where(f"length(context) = {n}").groupBy(F.col("context").alias(f"c{n}")).agg(
            F.map_from_entries(F.collect_list(F.when(F.col("rejected"), symbol))).alias(f"bad{n}"), F.map_from_entries(F.collect_list(F.when(~F.col("rejected"), symbol))).alias(f"good{n}")
        )
        keys = keys.withColumn(f"c{n}", F.substring("context", ORDER - n + 1, n)).join(own, f"c{n}", "left")
    rated = keys.select("context", "wanted", *[f"{k}{n}" for n in range(LOW + 1, ORDER + 1) for k in ("bad", "good")]).mapInArrow(rate, "context string, symbol string, parts long")
    sums = places.join(rated, ["context", "symbol"]).groupBy("row").agg(F.sum(F.col("times") * F.col("parts")).cast("double").alias("_sum"), (F.sum("times") * PARTS).cast("double").alias("_all"))
    out = rows.join(sums, "row", "left").withColumn("score", F.coalesce(F.col("_sum") / F.col("_all"), F.lit(0.0)))
    return persisted(out.drop("row", "_sum", "_all"), "url-scores")


def judged(pages: DataFrame, *, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS, false_blocks: float = 0.002, max_contexts: int = MAX_CONTEXTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row. The models read host and path. ``labelled``: columns
    ``url`` and ``accepted``; rows with a null in either, or without a host, teach nothing."""
    with scope() as here:
        return here.result(_judged(pages, labelled, rules, seeds, false_blocks, max_contexts, id_col, url_col), "url-verdicts")


def _judged(pages: DataFrame, labelled: DataFrame | None, rules: Sequence[tuple[str, str]], seeds: Sequence[str], false_blocks: float, max_contexts: int, id_col: str, url_col: str) -> DataFrame:
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("text", F.concat("host", "path"))
    if labelled is None:
        known = rows.select("text", seeded(F.col("host"), seeds).alias("rejected"))
    else:
        given = F.col("url").cast("string")
        known = labelled.where(host_of(given) != "").select(F.concat(host_of(given), path_of(given)).alias("text"), (~F.col("accepted").cast("boolean")).alias("rejected"))
    known = known.where("rejected is not null").withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0)
    counts = persisted(counted(known.where("not held")), "url-counts")
    entries = {r.rejected: r["count"] for r in counts.groupBy("rejected").count().collect()}
    threshold = math.inf
    if len(entries) < 2:
        out = rows.withColumn("score", F.lit(0.0))
    else:
        held = known.where("held and not rejected").select("text")
        if sum(entries.values()) <= max_contexts:
            shared = collected(counts)
            out, good = scores(rows, shared), scores(held, shared)
        else:
            out, good = joined_scores(rows, counts), joined_scores(held, counts)
        got = good.select(F.percentile_approx("score", 1 - false_blocks, 10_000)).first()[0]
        threshold = max(0.0, got if got is not None and not np.isnan(got) else 0.0)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")
