"""One long series in many tasks.

A window without a key is one task in Spark. Here the order of a table is cut by approximate quantiles of its time:

* bounded frames: rows are dealt into blocks with a halo, copies of the rows before and behind that the frames of a block's
  own rows reach. Inside a block any window does (:func:`by_rows`, :func:`by_span`);
* unbounded frames: a window inside each part, and what the parts before (or behind) hand on, which is one value a part
  (:func:`carried`, :func:`numbered`). These few values pass through the driver.

Cuts only spread the work, results are those of one task. Times that repeat stay in one part. Tables are read more than once
and must give the same rows each time. :func:`framed` is for long frames: rows stream through a task in order, with as many
of the rows before as frames reach back, and aggregates don't redo the frame for each row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, NumericType, StructField, StructType, TimestampNTZType, TimestampType

from . import ranges
from .durations import micros
from .names import col
from .order import BUCKETS, cuts
from .tables import persisted

#: Rows of a block at least.
BLOCK_ROWS = 4096
#: Rows that are worked on at once in a task.
CHUNK_ROWS = 100_000
#: Frames of more rows than this go through :func:`framed`.
LONG = 32


def names_of(order: Sequence[str] | str) -> list[str]:
    """The columns of an order."""
    return [order] if isinstance(order, str) else list(order)


def place(df: DataFrame, order: Sequence[str] | str) -> Column:
    """The first column of an order as a number: microseconds of times; a constant where it is neither time nor number."""
    first = names_of(order)[0]
    kind = df.schema[first].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return micros(col(first))
    return col(first) if isinstance(kind, NumericType) else F.lit(0)


def _rows(order: Sequence[str] | str, down: bool = False) -> list[Column]:
    return [col(c).desc() if down else col(c) for c in names_of(order)]


def _below(value: Column, at: Sequence[float]) -> Column:
    """As :func:`tidegrid.functions.order.bucket_of`, in less code: by sixteenths, then inside one."""
    if not at:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    count = lambda a: F.size(F.filter(a, lambda c: c <= value))
    step = max(1, math.isqrt(len(at)))
    coarse = count(F.lit([float(c) for c in at[step - 1 :: step]]))
    return F.when(value.isNull(), F.lit(-1)).otherwise(coarse * step + count(F.slice(F.lit([float(c) for c in at]), coarse * step + 1, F.lit(step))))


def numbered(df: DataFrame, order: Sequence[str] | str, name: str = "_no") -> tuple[DataFrame, int]:
    """``df`` with each row's place in the whole order, from 0, and the number of rows."""
    at = cuts(df, place(df, order))
    parts = df.withColumn("_part", _below(place(df, order), at))
    counts = {r._part: r["count"] for r in parts.groupBy("_part").count().collect()}  # a row for each part
    before = np.cumsum([0, *(counts.get(k, 0) for k in range(-1, len(at) + 1))]).tolist()
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*_rows(order)))
    return parts.withColumn(name, F.get(F.lit(before[:-1]), F.col("_part") + 1) + inside - 1).drop("_part"), before[-1]


def by_rows(df: DataFrame, order: Sequence[str] | str, before: int, after: int, run: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``run(df, key)`` for frames of at most ``before`` rows before and ``after`` behind: its windows take the key. It finds each
    row's place in the whole order as ``_no``."""
    rows, n = numbered(df, order)
    size = max(BLOCK_ROWS, before + after, -(-n // BUCKETS))
    first = F.greatest(F.floor((F.col("_no") - after) / size), F.lit(0))
    last = F.least(F.floor((F.col("_no") + before) / size), F.lit(max(0, n - 1) // size))
    dealt = rows.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == F.floor(F.col("_no") / size))
    return run(dealt, ["_block"]).where("_own").drop("_block", "_own", "_no")


def by_span(df: DataFrame, time: str, before: int, after: int, run: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """As :func:`by_rows` for frames of ``before`` and ``after`` microseconds. A block holds the rows of such a span at least."""
    t, kept = micros(col(time)), []
    for c in cuts(df, t):
        if not kept or c - kept[-1] >= before + after:
            kept.append(c)
    near = F.sequence(_below(t - after, kept), _below(t + before, kept))
    dealt = df.withColumn("_block", F.explode(F.when(t.isNull(), F.array(F.lit(-1))).otherwise(near))).withColumn("_own", F.col("_block") == _below(t, kept))
    return run(dealt, ["_block"]).where("_own").drop("_block", "_own")


def carried(df: DataFrame, order: Sequence[str] | str, last: Mapping[str, Column] | None = None, following: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with, by name: the last value that is not missing up to each row, the first one from it on, and running sums."""
    last, following, sums = last or {}, following or {}, sums or {}
    at = cuts(df, place(df, order))
    parts = df.withColumn("_part", _below(place(df, order), at))
    key = F.struct(*[col(c) for c in names_of(order)])
    known = [(n, F.max_by(v, F.when(v.isNotNull(), key))) for n, v in last.items()] + [(n, F.min_by(v, F.when(v.isNotNull(), key))) for n, v in following.items()] + [(n, F.sum(v)) for n, v in sums.items()]
    made = parts.groupBy("_part").agg(*[e.alias(f"c{i}") for i, (_, e) in enumerate(known)])
    rows = sorted(made.collect(), key=lambda r: r._part)  # a row for each part
    table: list[list] = [[r._part] for r in rows]
    for i, (n, _) in enumerate(known):
        turned, held = n in following, 0 if n in sums else None
        for r, out in (list(zip(rows, table, strict=True))[::-1] if turned else zip(rows, table, strict=True)):
            out.append(held)
            own = r[f"c{i}"]
            held = held + (own or 0) if n in sums else held if own is None else own
    schema = StructType([StructField("_part", made.schema["_part"].dataType)] + [StructField(f"_carry{i}", made.schema[f"c{i}"].dataType) for i in range(len(known))])
    out = parts.join(F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in table], schema)), "_part", "left")
    up, down = (Window.partitionBy("_part").orderBy(*_rows(order, d)).rowsBetween(Window.unboundedPreceding, 0) for d in (False, True))
    new = {}
    for i, (n, _) in enumerate(known):
        carry = F.col(f"_carry{i}")
        if n in sums:
            new[n] = carry + F.coalesce(F.sum(sums[n]).over(up), F.lit(0))
        else:
            new[n] = F.coalesce(F.last(last[n] if n in last else following[n], ignorenulls=True).over(up if n in last else down), carry)
    return out.withColumns(new).drop("_part", *[f"_carry{i}" for i in range(len(known))])


def interpolated(df: DataFrame, column: str, value: Column, time: str, order: Sequence[str] | str) -> DataFrame:
    """``df`` with ``value`` filled linearly by time as ``column``; leading gaps stay, trailing gaps hold the last value."""
    known = F.when(value.isNotNull(), F.struct(micros(col(time)).cast("double").alias("t"), value.cast("double").alias("x")))
    out = carried(df.withColumn("_v", value.cast("double")), order, {"_a": known}, {"_b": known})
    a, b, t, x = F.col("_a"), F.col("_b"), micros(col(time)).cast("double"), F.col("_v")
    filled = F.when(x.isNotNull(), x).when(a.isNull(), None).when(b.isNull(), a["x"]).otherwise(a["x"] + (b["x"] - a["x"]) * (t - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0)))
    return out.withColumn(column, filled).drop("_a", "_b", "_v")


@dataclass(frozen=True)
class Frame:
    """From ``before`` before to ``after`` behind, both inclusive: rows, or (``span``) microseconds of time."""

    before: int
    after: int
    span: bool = False


@dataclass(frozen=True)
class Rolling:
    """A rolling aggregate of ``column`` as ``name``; missing below ``least`` values."""

    name: str
    column: str
    kind: str
    frame: Frame
    least: int = 1
    proportion: float = 0.1


def framed(df: DataFrame, by: Sequence[str], order: Sequence[str] | str, wanted: Sequence[Rolling], time: str | None = None) -> DataFrame:
    """``df`` with rolling aggregates, in time by row that doesn't grow with the frame (order statistics: with its logarithm).

    Rows are dealt by ``by`` and sorted; a task streams through them and holds a chunk and the rows that frames reach."""
    keys, order = list(by), names_of(order)
    columns = list(dict.fromkeys(w.column for w in wanted))
    given = df.columns
    extra = {f"_x{i}": col(c).cast("double") for i, c in enumerate(columns)} | {"_t": (micros(col(time or order[0])) if any(w.frame.span for w in wanted) else F.lit(0)).cast("long")}
    rows = df.withColumns(extra)
    rows = (rows.repartition(*[col(k) for k in keys]) if keys else rows.repartition(1)).sortWithinPartitions(*[col(c) for c in (*keys, *order)])
    at = {n: i for i, n in enumerate(rows.columns)}
    kernels = [(at[f"_x{columns.index(w.column)}"], w.frame, ranges.rolling(w.kind, w.least, w.proportion)) for w in wanted]
    key_at, time_at, width, names = [at[k] for k in keys], at["_t"], len(given), [*given, *[w.name for w in wanted]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        done = 0  # rows of ``held`` that have gone out; they are there for the frames of others

        def out(final: bool) -> pa.Table | None:
            nonlocal held, done
            n = len(held)
            new = np.zeros(n, bool)
            new[0] = True
            for k in key_at:
                c = held.column(k).combine_chunks()
                a, b = c.slice(0, n - 1), c.slice(1)
                differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
                new[1:] |= differs.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            low, high = starts[group], np.append(starts[1:], n)[group]
            t, i = held.column(time_at).fill_null(-(2**62)).to_numpy(), np.arange(n)
            spans = {}
            for _, f, _ in kernels:
                if f in spans:
                    continue
                if f.span:
                    spans[f] = ranges.first_after(t, t - f.before - 1, low, i), ranges.first_after(t, t + f.after, i, high)
                else:
                    spans[f] = np.maximum(low, i - f.before), np.minimum(high, i + f.after + 1)
            ready = n
            if not final:  # frames of the last group may go on
                ready = min(int(starts[-1] + np.searchsorted(b[starts[-1] :], n, "left")) for _, b in spans.values())
            own = slice(done, max(done, ready))
            made = []
            for k, f, kernel in kernels:
                x = held.column(k).combine_chunks()
                value, there = kernel(x.fill_null(0.0).to_numpy(), x.is_valid().to_numpy(zero_copy_only=False), spans[f][0][own], spans[f][1][own])
                made.append(pa.array(value, mask=~there))
            table = held.slice(own.start, own.stop - own.start).select(range(width))
            for name, m in zip(names[width:], made, strict=True):
                table = table.append_column(name, m)
            keep = n if final or own.stop >= n else min(int(a[own.stop]) for a, _ in spans.values())
            held, done = held.slice(keep), own.stop - keep
            return table

        waiting, count = [], 0
        for batch in batches:
            waiting.append(batch)
            count += len(batch)
            if count >= max(CHUNK_ROWS, done):  # longer frames take longer chunks, so that a row is looked at a few times
                held = pa.concat_tables(([held] if held is not None else []) + [pa.Table.from_batches(waiting)])
                waiting, count = [], 0
                yield from out(False).to_batches()
        if waiting:
            held = pa.concat_tables(([held] if held is not None else []) + [pa.Table.from_batches(waiting)])
        if held is not None and len(held):
            yield from out(True).to_batches()

    kind = StructType([*df.schema.fields, *[StructField(w.name, DoubleType()) for w in wanted]])
    return rows.mapInArrow(run, kind)


#: Kinds that :func:`spanned` takes.
SPANNED = ("sum", "mean", "min", "max", "var", "std", "median", "numpos")
#: Stands for the time of rows without one, as in :func:`framed`.
NO_TIME = -(2**62)


def spanned(df: DataFrame, time: str, wanted: Sequence[Rolling]) -> DataFrame:
    """``df``, one series, with rolling aggregates of spans, however many rows a span holds: no task gets a span whole.

    Time is cut into blocks. The frames of a stretch of times begin inside one block and end inside one; the blocks between
    (the core) lie in all of them, and count by their totals. A task gets a stretch's times and the rows of both end blocks. For medians it
    also gets the values of the core in those buckets of the value's order that the end blocks' rows can move the median to; the
    others count by their number. Rows of one time have one result, which is joined to them."""
    for frame in dict.fromkeys(w.frame for w in wanted):
        df = _spanned(df, time, frame, [w for w in wanted if w.frame == frame])
    return df


def _spanned(df: DataFrame, time: str, frame: Frame, wanted: Sequence[Rolling]) -> DataFrame:
    spark, at_time = df.sparkSession, F.coalesce(micros(col(time)), F.lit(NO_TIME))
    columns = list(dict.fromkeys(w.column for w in wanted))
    xs = [f"_x{i}" for i in range(len(columns))]
    ranked = [i for i, c in enumerate(columns) if any(w.column == c and w.kind == "median" for w in wanted)]
    rows = df.select(at_time.alias("_t"), *[col(c).cast("double").alias(x) for c, x in zip(columns, xs, strict=True)])
    n = rows.count()
    if not n:
        return df.withColumns({w.name: F.lit(None).cast("double") for w in wanted})
    at = np.array([int(c) for c in cuts(rows, F.col("_t"), max(1, min(BUCKETS, n // BLOCK_ROWS)))], np.int64)
    turns = np.unique(np.concatenate([at, at + frame.before, at - frame.after]))
    probe = np.concatenate([turns[:1] - 1, turns]) if len(turns) else np.zeros(1, np.int64)  # a time of each stretch
    ends = np.searchsorted(at, np.stack([probe - frame.before, probe + frame.after]), "right")  # by stretch, its two end blocks
    values = {i: cuts(rows, F.col(xs[i]), max(1, min(BUCKETS, n // BLOCK_ROWS))) for i in ranked}
    places = {"_b": ("_t", at), "_k": ("_t", turns)} | {f"_v{i}": (xs[i], np.array(v, np.float64)) for i, v in values.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, (c, cut) in places.items():
                x = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                batch = batch.append_column(name, pa.array(np.searchsorted(cut, x, "right").astype(np.int32)))
            yield batch

    rows = persisted(rows.mapInArrow(placed, StructType([*rows.schema.fields, *[StructField(p, IntegerType()) for p in places]])), "spans")

    # Totals by block, and by block and bucket: fixed numbers of rows.
    blocks, used = len(at) + 1, {r._k for r in rows.select("_k").distinct().collect()}
    parts = [F.count("*").alias("n")]
    for x in xs:
        c = F.col(x)
        parts += [e.alias(f"{m}{x}") for m, e in {"n": F.count(c), "p": F.count_if((c > 0) | F.isnan(c)), "s": F.sum(c), "a": F.min(c), "b": F.max(c), "m": F.avg(c), "v": F.var_pop(c)}.items()]
    totals = {r._b: r for r in rows.groupBy("_b").agg(*parts).collect()}
    counts, least = ({i: np.full((blocks, len(values[i]) + 1), v, t) for i in ranked} for v, t in ((0, np.int64), (np.inf, np.float64)))
    per = {i: rows.where(F.col(xs[i]).isNotNull()).groupBy("_b", f"_v{i}", xs[i]).agg(F.count("*").alias("_n")) for i in ranked}
    for i in ranked:
        for r in per[i].groupBy("_b", f"_v{i}").agg(F.sum("_n").alias("n"), F.min(xs[i]).alias("a")).collect():
            counts[i][r._b, r[f"_v{i}"]], least[i][r._b, r[f"_v{i}"]] = r.n, r.a

    # Which stretches get a block's rows, and those of its values that a median may fall on.
    open_, given = {}, [[] for _ in range(blocks)]
    picked: dict[int, dict[tuple[int, int], list[int]]] = {i: {} for i in ranked}
    for k in sorted(used):
        first, last = ends[:, k].tolist()
        for b in {first, last}:
            given[b].append(k)
        for i in ranked if last - first > 1 else ():
            upto = np.cumsum(counts[i][first + 1 : last].sum(0))
            c, edge = int(upto[-1]), int(counts[i][[first, last]].sum())
            if c:
                low, high = (int(np.searchsorted(upto, r, "right")) for r in (max(0, (c - edge) // 2 - 2), min(c - 1, (c + edge) // 2 + 2)))
                open_[k, i] = low, high
                for b, v in np.argwhere(counts[i][first + 1 : last, low : high + 1]).tolist():
                    picked[i].setdefault((b + first + 1, v + low), []).append(k)
    table = lambda cells, names: F.broadcast(spark.createDataFrame(pa.table({m: pa.array([c[j] for c in cells], pa.int32() if j < len(names) - 1 else pa.list_(pa.int32())) for j, m in enumerate(names)})))
    pick = lambda part, own, x, n: [F.lit(part).alias("_part"), own.alias("_t"), *x, n.cast("long").alias("_n")]
    none = [F.lit(None).cast("double").alias(x) for x in xs]
    dealt = rows.select("_k", "_t").distinct().select("_k", *pick(-2, F.col("_t"), none, F.lit(1)))
    edges = rows.join(table(list(enumerate(given)), ["_b", "_ks"]), "_b").select(F.explode("_ks").alias("_k"), "_t", *xs)
    dealt = dealt.unionByName(edges.select("_k", *pick(-1, F.col("_t"), xs, F.lit(1))))
    for i in ranked:
        if picked[i]:
            near = per[i].join(table([(b, v, ks) for (b, v), ks in picked[i].items()], ["_b", f"_v{i}", "_ks"]), ["_b", f"_v{i}"])
            near = near.select(F.explode("_ks").alias("_k"), xs[i], "_n").groupBy("_k", xs[i]).agg(F.sum("_n").alias("_n"))
            dealt = dealt.unionByName(near.select("_k", *pick(i, F.lit(0), [F.col(x) if x == xs[i] else e for x, e in zip(xs, none, strict=True)], F.col("_n"))))

    def number(r: object, m: str, x: str) -> float:
        v = r[f"{m}{x}"]
        return {"a": np.nan, "b": -np.inf}.get(m, 0.0) if v is None else v

    told = {b: {x: [number(r, m, x) for m in "npsabmv"] for x in xs} | {"n": r.n} for b, r in totals.items()}
    kernels = [(columns.index(w.column), w.kind, ranges.rolling(w.kind, w.least)) for w in wanted]
    before, after = frame.before, frame.after
    joined, core_of = ranges._joined, ranges.Core

    def core(k: int, i: int, near: np.ndarray, n_near: np.ndarray, middle: int) -> ranges.Core | None:
        first, last = ends[:, k].tolist()
        own = [told[b] for b in range(first + 1, last) if b in told]
        if first == last:
            return None
        got = {"sum": (0.0,), "min": (np.nan,), "max": (-np.inf,), "moments": (0.0, 0.0, 0.0)}
        for _, _, s, a, b, m, v, c in ((*o[xs[i]], o[xs[i]][0]) for o in own):
            for kind, p in (("sum", (s,)), ("min", (a,)), ("max", (b,)), ("moments", (c, m, v * c))):
                got[kind] = tuple(np.float64(e) for e in joined(got[kind], p, kind))
        if i in counts and own:
            n, a = counts[i][first + 1 : last].sum(0), least[i][first + 1 : last].min(0)
            if (k, i) in open_:
                n[open_[k, i][0] : open_[k, i][1] + 1] = 0
            near, n_near = np.concatenate([near, a[n > 0]]), np.concatenate([n_near, n[n > 0]])
        return core_of(sum(o["n"] for o in own), sum(o[xs[i]][0] for o in own), sum(o[xs[i]][1] for o in own), got, near, n_near, middle)

    def run(rows: pa.Table) -> pa.Table:
        k, part, t, n = (rows.column(c).to_numpy() for c in ("_k", "_part", "_t", "_n"))
        own, edge = np.sort(t[part == -2]), np.flatnonzero(part == -1)
        edge = edge[np.argsort(t[edge], kind="stable")]
        low, high = np.searchsorted(t[edge], own - before, "left"), np.searchsorted(t[edge], own + after, "right")
        last = int(ends[1, k[0]])
        middle = int(np.searchsorted(t[edge], at[last - 1], "left")) if last else 0  # where the rows of the second end block begin
        cells, cores = {}, {}
        for i, x in enumerate(xs):
            c = rows.column(x).combine_chunks()
            v, ok = c.fill_null(0.0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)
            cells[i], cores[i] = (v[edge], ok[edge]), core(int(k[0]), i, v[part == i], n[part == i], middle)
        out = [pa.array(own)]
        for i, _, kernel in kernels:
            value, there = kernel(*cells[i], low, high, cores[i])
            out.append(pa.array(value, mask=~there))
        return pa.table(out, names=["_t", *[w.name for w in wanted]])

    kind = StructType([StructField("_t", LongType()), *[StructField(w.name, DoubleType()) for w in wanted]])
    found = dealt.repartition(min(BUCKETS, max(1, len(used))), "_k").groupBy("_k").applyInArrow(run, kind)
    return df.withColumn("_t", at_time).join(found, "_t", "left").drop("_t")
