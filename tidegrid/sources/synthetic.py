"""Synthetic sensor series: irregular times, seasonal patterns, noise, cut-offs and gaps. Random numbers are Spark's, by
seed; values differ from other generators', properties hold."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import duration, micros, moment
from ..functions.order import running


def synthetic_date_range(spark: SparkSession, start: str, end: str, freq: str = "1h", max_delay: float = 0, random_stop_freq: float = 0, random_stop_max_length: int = 1, seed: int = 0) -> DataFrame:
    """``TIME``: regular times before ``end``, each later by all random delays so far (up to ``max_delay`` seconds each),
    without random runs of up to ``random_stop_max_length`` rows that start with chance ``random_stop_freq``."""
    step = duration(freq)
    row = spark.sql(f"SELECT unix_micros(timestamp '{start}') AS a, unix_micros(timestamp '{end}') AS b").first()
    n = max(0, -(-(row.b - row.a) // step))
    df = spark.range(n).select("id", (F.lit(row.a) + F.col("id") * step).alias("us"))
    chance = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / F.lit(float(1 << 53))  # noqa: E731  of the row alone
    if max_delay:
        late = running(df.withColumn("r", F.round(chance(0) * F.lit(max_delay * 1e6)).cast("long")), "id", {"late": "r"})
        df = late.select("id", (F.col("us") + F.col("late")).alias("us"))
    if random_stop_freq:
        length = F.ceil(chance(2) * random_stop_max_length)
        gone = df.where(chance(1) < random_stop_freq).select(F.explode(F.sequence(F.col("id"), F.col("id") + F.greatest(length, F.lit(1)) - 1)).alias("id"))
        df = df.join(gone.distinct(), "id", "left_anti")
    return df.where(F.col("us") < row.b).select(moment(F.col("us")).alias("TIME"))


def spline(values: Sequence[float], place: Column) -> Column:
    """The periodic cubic spline through evenly spaced values, at ``place`` in units of their spacing."""
    n, y = len(values), np.array(values, float)
    # Second derivatives at the knots: a cyclic system of their number.
    system = 4 * np.eye(n) + np.roll(np.eye(n), 1, axis=1) + np.roll(np.eye(n), -1, axis=1)
    bend = np.linalg.solve(system, 6 * (np.roll(y, 1) - 2 * y + np.roll(y, -1)))
    knots, bends = (F.array(*[F.lit(float(v)) for v in a]) for a in (y, bend))
    i, f = F.pmod(F.floor(place).cast("int"), F.lit(n)), place - F.floor(place)
    j, g = F.pmod(i + 1, F.lit(n)), 1 - f
    return knots[i] * g + knots[j] * f + (g * g * g - g) * bends[i] / 6 + (f * f * f - f) * bends[j] / 6


def temporal_noise(kind: str, scales: Sequence[float], at: Column, seed: int) -> Column:
    """Noise whose size depends on a part of the time (``at``, from 0): ``normal`` with these deviations, or ``poisson`` with
    these means."""
    if kind == "normal":
        return F.array(*[F.lit(float(x)) for x in scales])[at.cast("int")] * F.randn(seed)
    if kind != "poisson":
        raise ValueError("noise is normal or poisson")
    tables = []
    for mean in scales:  # chances of at most 0, 1, 2 ...: the number of those below a uniform number is Poisson's
        upto, chance, k = [math.exp(-mean)], math.exp(-mean), 0
        while upto[-1] < 1 - 1e-12 and k < 1000:
            k += 1
            chance *= mean / k
            upto.append(upto[-1] + chance)
        tables.append(F.array(*[F.lit(x) for x in upto]))
    below = lambda u: F.aggregate(F.array(*tables)[at.cast("int")], F.lit(0), lambda n, x: n + (x < u).cast("int"))
    return F.transform(F.array(F.rand(seed)), below)[0].cast("double")  # so that one number is drawn for a row


def synthetic_timeseries(
    dates: DataFrame,
    monthly: float | Sequence[float] = 0,
    daily: float | Sequence[float] = 0,
    hourly: float | Sequence[float] = 0,
    monthnoise: tuple[str, float] | None = None,
    daynoise: tuple[str, float] | None = None,
    noise: float = 0,
    minmax_values: tuple[float, float] | None = None,
    cutoff_values: tuple[float, float] | None = None,
    negabs: float | None = None,
    random_missing: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """``TIME, VALUE``: smooth patterns over the months, days of the week and hours (knots given, or random up to a size), plus
    noise (by month and day with its own random scale), rescaled to ``minmax_values``, missing outside ``cutoff_values``,
    folded at ``negabs``; a share ``random_missing`` of rows, exactly, is missing."""
    rng = np.random.default_rng(seed)
    t = F.col("TIME")

    def part(size: float | Sequence[float], n: int, place: Column) -> Column:
        if isinstance(size, (int, float)):
            return spline(rng.uniform(0, size, n), place) if size else F.lit(0.0)
        if len(size) != n:
            raise ValueError(f"a pattern of {n} values is needed")
        return spline(size, place)

    day = F.dayofmonth(t) - 1 + F.hour(t) / 24
    value = part(monthly, 12, F.month(t) - 1 + day / 31) + part(daily, 7, F.weekday(t) + F.hour(t) / 24) + part(hourly, 24, F.hour(t) + F.minute(t) / 60)

    def spread(given: tuple[str, float] | None, n: int, at: Column, k: int) -> Column:
        if not given:
            return F.lit(0.0)
        kind, size = given
        return temporal_noise(kind, rng.poisson(size, n), at, seed + k)

    value = value + spread(monthnoise, 12, F.month(t) - 1, 11) + spread(daynoise, 7, F.weekday(t), 12) + (F.randn(seed + 13) * noise if noise else F.lit(0.0))
    df = dates.select("TIME", value.alias("VALUE"))
    if minmax_values:
        low, high = minmax_values
        seen = df.agg(F.min("VALUE").alias("_a"), F.max("VALUE").alias("_b"))
        df = df.crossJoin(F.broadcast(seen)).select("TIME", (F.lit(low) + (F.col("VALUE") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) * (high - low)).alias("VALUE"))  # one row
    if cutoff_values:
        df = df.withColumn("VALUE", F.when(F.col("VALUE").between(*cutoff_values), F.col("VALUE")))
    if negabs is not None:
        df = df.withColumn("VALUE", F.abs(F.col("VALUE") - negabs))
    if random_missing:
        n = round(df.count() * random_missing)
        gone = df.select("TIME").orderBy(F.xxhash64(micros(F.col("TIME")), F.lit(seed)), "TIME").limit(n).withColumn("_gone", F.lit(True))
        df = df.join(gone, "TIME", "left").select("TIME", F.when(F.col("_gone").isNull(), F.col("VALUE")).alias("VALUE"))
    return df
