"""Order statistics and running sums of whole tables, without gathering a table's order in one task.

A table's order is cut into buckets by approximate quantiles. What needs the order inside a bucket is a window over the
bucket; what needs all before it is a sum over the few bucket totals. Cuts only spread the work: results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import col

#: Buckets of an order, and the values that an exact quantile may bring to the driver for each rank.
BUCKETS, MOST_VALUES = 256, 20_000


def cuts(df: DataFrame, value: Column, buckets: int = BUCKETS) -> list[float]:
    """At most ``buckets - 1`` different numbers that part the values into buckets of about the same size."""
    at = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(value.cast("double"), at, 4 * buckets).alias("c")).first()
    return sorted({c for c in row.c or () if not math.isnan(c)})


def bucket_of(value: Column, at: Sequence[float]) -> Column:
    """How many of the sorted numbers ``at`` lie at or below the value, as a tree of comparisons; null has bucket -1."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(number < float(at[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    number = value.cast("double")
    return F.when(number.isNull(), F.lit(-1)).otherwise(tree(0, len(at)))


def running(df: DataFrame, key: str, sums: Mapping[str, str], descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``df`` (one row for each ``key``, a number) with running sums: ``sums`` maps new names to the columns summed."""
    sign = -1 if descending else 1
    keyed = df.withColumn("_bucket", sign * bucket_of(col(key), cuts(df, col(key), buckets)))
    totals = keyed.groupBy("_bucket").agg(*[F.sum(col(c)).alias(f"_before_{i}") for i, c in enumerate(sums.values())])
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most buckets + 1 rows
    totals = totals.select("_bucket", *[F.coalesce(F.sum(f"_before_{i}").over(earlier), F.lit(0)).alias(f"_before_{i}") for i in range(len(sums))])
    inside = Window.partitionBy("_bucket").orderBy(col(key).desc() if descending else col(key)).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(F.broadcast(totals), "_bucket")
    out = out.withColumns({n: F.col(f"_before_{i}") + F.sum(col(c)).over(inside) for i, (n, c) in enumerate(sums.items())})
    return out.drop("_bucket", *[f"_before_{i}" for i in range(len(sums))])


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank of ``value`` (a number) in its group; equal values share the mean of their ranks, and missing
    ones have none. Equal values are counted first, so a group is ordered by distinct values, in buckets."""
    per = df.where(col(value).isNotNull()).groupBy(*[col(c) for c in by], col(value).alias("_v")).agg(F.count("*").alias("_n"))
    parts = 64
    at = per.groupBy(*by).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 4 * parts).alias("_cuts"))
    joined = per.join(at, [*by]) if by else per.crossJoin(F.broadcast(at))  # one row of cuts
    per = joined.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))).drop("_cuts")
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    totals = per.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0))).drop("_all")
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_upto", F.sum("_n").over(inside)).join(totals, [*by, "_bucket"])
    ranks = per.select(*by, F.col("_v").alias(value), (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, [*by, value], "left")


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column], at: Sequence[float]) -> dict[str, list[float | None]]:
    """By name the exact quantiles of a column, linear between neighbours; None without values.

    Each wanted rank is held between two values. A pass counts what lies below and between them, and takes approximate
    quantiles around the rank; these become the new ends. When few values are left between, they are fetched.
    """
    names = list(columns)
    rows = df.select(*[columns[n].cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    first = rows.agg(*[e for i in range(len(names)) for e in (F.count(f"x{i}").alias(f"n{i}"), F.min(f"x{i}").alias(f"a{i}"), F.max(f"x{i}").alias(f"b{i}"))]).first()
    ranks = {(i, k) for i in range(len(names)) if first[f"n{i}"] for q in at for k in (math.floor(q * (first[f"n{i}"] - 1)), math.ceil(q * (first[f"n{i}"] - 1)))}
    held = {r: (first[f"a{r[0]}"], first[f"b{r[0]}"]) for r in ranks}
    known = {r: low for r, (low, high) in held.items() if low == high}
    while len(known) < len(ranks):
        todo = sorted(ranks - set(known))
        parts = []
        for j, (i, k) in enumerate(todo):
            x, (low, high) = F.col(f"x{i}"), held[i, k]
            parts += [F.count_if(x <= low).alias(f"l{j}"), F.count_if(x < high).alias(f"h{j}")]
        row = rows.agg(*parts).first()
        step, small = [], []
        for j, (i, k) in enumerate(todo):
            below, upto = row[f"l{j}"], row[f"h{j}"]  # those at or below the lower end, and those below the upper end
            if k < below:
                known[i, k] = held[i, k][0]
            elif k >= upto:
                known[i, k] = held[i, k][1]
            elif upto - below <= MOST_VALUES:
                small.append((i, k, below))
            else:
                step.append((i, k, below, upto))
        inside = lambda i, k: F.when((F.col(f"x{i}") > held[i, k][0]) & (F.col(f"x{i}") < held[i, k][1]), F.col(f"x{i}"))
        if small:
            got = rows.agg(*[F.sort_array(F.collect_list(inside(i, k))).alias(f"v{j}") for j, (i, k, _) in enumerate(small)]).first()
            for j, (i, k, below) in enumerate(small):
                known[i, k] = got[f"v{j}"][k - below]
        if step:
            places = [[max(0.0, p - 0.002), min(1.0, p + 0.002)] for _, k, below, upto in step for p in ((k - below) / (upto - below),)]
            got = rows.agg(*[F.percentile_approx(inside(i, k), p, 2000).alias(f"c{j}") for j, ((i, k, _, _), p) in enumerate(zip(step, places, strict=True))]).first()
            count = rows.agg(*[c for j, (i, _, _, _) in enumerate(step) for c in (F.count_if(F.col(f"x{i}") <= got[f"c{j}"][0]).alias(f"l{j}"), F.count_if(F.col(f"x{i}") < got[f"c{j}"][1]).alias(f"h{j}"))]).first()
            for j, (i, k, _, _) in enumerate(step):
                (low, high), (a, b) = held[i, k], got[f"c{j}"]
                if k < count[f"l{j}"]:  # at or below the lower new end
                    held[i, k] = (low, a)
                elif k >= count[f"h{j}"]:
                    held[i, k] = (b, high)
                else:
                    held[i, k] = (a, b)
    out = {}
    for i, n in enumerate(names):
        out[n] = []
        for q in at:
            if not first[f"n{i}"]:
                out[n].append(None)
                continue
            place = q * (first[f"n{i}"] - 1)
            a, b = known[i, math.floor(place)], known[i, math.ceil(place)]
            share = place - math.floor(place)
            out[n].append(a if a == b else a * (1.0 - share) + b * share)  # as SQL has it, to the last digit
    return out
