"""Order statistics and running sums that no single task holds, against plain ones."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidegrid.functions import order
from tidegrid.sources import synthetic


def test_exact_quantiles(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(order, "MOST_VALUES", 20)  # several passes
    cases = {
        "plain": [rng.uniform(-5, 5) for _ in range(3000)], "ties": [rng.choice((1.0, 1.0, 2.0, 7.5)) for _ in range(3000)], "one": [4.0] * 3000,
        "holes": [None if i % 3 else float(i) for i in range(3000)], "none": [None] * 3000, "two": [0.0] * 1500 + [9.0] * 1500, "skew": [float(i) ** 6 for i in range(3000)],
    }
    df = spark.createDataFrame(list(zip(*cases.values(), strict=True)), ", ".join(f"{k} double" for k in cases))
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = order.exact_quantiles(df.repartition(5), {k: F.col(k) for k in cases}, at)
    for name, values in cases.items():
        own = [v for v in values if v is not None]
        want = np.quantile(own, at).tolist() if own else [None] * len(at)
        assert all((a is None and b is None) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(got[name], want, strict=True)), name


def test_running_sums_and_ranks(spark):
    rng = random.Random(2)
    keys = list({round(rng.uniform(-9, 9), 3) for _ in range(2000)})
    df = spark.createDataFrame([(k, i % 7) for i, k in enumerate(keys)] + [(None, 5)], "k double, n long").repartition(4)
    for down in (False, True):
        total, want = 0, {}
        rows = sorted(zip(keys, [i % 7 for i in range(len(keys))], strict=True), reverse=down)
        for k, n in ([(None, 5)] if not down else []) + rows + ([(None, 5)] if down else []):
            total += n
            want[k] = total
        got = {r.k: r.s for r in order.running(df, "k", {"s": "n"}, down, 16).collect()}
        assert got == want
    values = [(i % 3, rng.choice((None, 1.0, 2.0, rng.uniform(0, 5)))) for i in range(900)]
    ranked = order.average_ranks(spark.createDataFrame(values, "g long, v double"), ["g"], "v", "r").collect()
    for g in range(3):
        own = sorted(v for k, v in values if k == g and v is not None)
        for r in ranked:
            if r.g == g and r.v is not None:
                first = own.index(r.v)
                assert r.r == first + (own.count(r.v) + 1) / 2
    assert len(ranked) == 900 and all(r.r is None for r in ranked if r.v is None)


def test_spline_and_noise(spark):
    knots = [1.0, 4.0, 2.0, -1.0, 0.5]
    place = [i / 100 for i in range(700)]
    df = spark.createDataFrame([(p,) for p in place], "p double")
    got = [r.s for r in df.orderBy("p").select(synthetic.spline(knots, F.col("p")).alias("s")).collect()]
    assert all(math.isclose(got[100 * i], knots[i % 5], abs_tol=1e-12) for i in range(7)) and math.isclose(got[550], got[50], abs_tol=1e-12)
    bend = np.diff(got, 2) * 1e4  # the second derivative has no jumps at the knots
    assert np.abs(np.diff(bend)).max() < 0.05 * np.abs(bend).max() + 0.05
    drawn = spark.range(20_000).select((F.col("id") % 2).alias("g"), synthetic.temporal_noise("poisson", [0.5, 4.0], F.col("id") % 2, 3).alias("n"))
    for r in drawn.groupBy("g").agg(F.avg("n").alias("m"), F.var_samp("n").alias("v")).collect():
        want = (0.5, 4.0)[r.g]
        assert abs(r.m - want) < 0.1 * want and abs(r.v - want) < 0.15 * want
    late = synthetic.synthetic_date_range(spark, "2020-01-01", "2020-01-10", "1h", max_delay=30, seed=4).orderBy("TIME").collect()
    steps = [(b.TIME - a.TIME).total_seconds() - 3600 for a, b in zip(late[:-1], late[1:], strict=True)]
    assert all(0 <= s <= 30 for s in steps) and max(steps) > 20
