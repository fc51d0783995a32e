"""One long series: same rows with 1 and many parts, no exchange to one partition, kernels against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import ranges, series
from tidegrid.functions.names import col
from tidegrid.operators import cleaning, exploration, features, reshaping, validation

N = 3000
#: Blocks of few rows, so that frames cross many of them.
SMALL = {"BLOCK_ROWS": 64, "CHUNK_ROWS": 97}


@pytest.fixture(scope="module")
def long(spark):
    """One series: irregular and repeated times (told apart by ``k``), missing values, flat stretches, outliers."""
    rng, rows, t = random.Random(8), [], 1_700_000_000_000_000
    for k in range(N):
        t += rng.choice([0, 1, 10**6, 6 * 10**7, 10**9])
        x = None if rng.random() < 0.05 else 5.0 if 700 <= k < 900 else round(rng.gauss(50, 20), 2) * (100 if rng.random() < 0.01 else 1)
        rows.append((k, t, x))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, us long, x double").repartition(5)
    return df.select("k", F.timestamp_micros("us").alias("t"), "x", F.lit("a").alias("key"), F.lit(45.0).alias("PREDICT"), F.lit(20.0).alias("PREDICT_LOW"), F.lit(80.0).alias("PREDICT_HIGH"), F.col("x").alias("ACTUAL")).cache()


ORDER = ["t", "k"]
ROLL = lambda kind, n, **o: lambda d, by: features.BuildRollingFeatures(ORDER, kind, window_size=n, cols=["x"], partition_by=by, **o).transform(d)
CASES = {
    "lag": ROLL("lag", 3), "diff": ROLL("diff", 70), "mean": ROLL("mean", 5), "long mean": ROLL("mean", 300), "sum and deviation": ROLL("sum", [3, 100], deviation="subtract"), "skew": ROLL("skew", 7),
    "trimmean": ROLL("trimmean", 150, proportiontocut=0.2), "median by span": ROLL("median", "1h"), "rows and spans": ROLL("max", [4, 80, "2h", "10min"], lookback=2), "std by span": ROLL("std", "1d", lookback=0),
    "ewm": ROLL("ewm", 1, alpha=[0.3, 0.9]), "fourier": ROLL("fourier", 6), "nfft": ROLL("nfft", "30min", nfft_ncol=3),
    "range lag ahead": lambda d, by: features.range_lag_column(d, "x", (1, 90), ORDER, by, "r"), "range lag back": lambda d, by: features.range_lag_column(d, "x", (-90, -2), ORDER, by, "r"),
    "previous": lambda d, by: cleaning.correct_outside_range(d, "x", (5, 100), "previous", time_col=ORDER, partition_by=by), "average": lambda d, by: cleaning.correct_above_threshold(d, "x", 60, "average", time_col=ORDER, partition_by=by),
    "first complete": lambda d, by: cleaning.remove_until_first_value(d, ["x"], "t", by), "spacing": lambda d, by: cleaning.spacing(d, "t", by).select("n", "steps", "least"),
    "flat lines": lambda d, by: validation.FlatlineValidator(ORDER, 120, ["x"], margin=0.5, partition_by=by).fit_transform(d), "flat lines by chance": lambda d, by: validation.FlatlineValidator(ORDER, "auto", ["x"], pvalue=1e-3, partition_by=by).fit_transform(d),
    "mad": lambda d, by: validation.MADValidator(ORDER, 61, ["x"], 5, by).fit_transform(d), "mad by span": lambda d, by: validation.MADValidator(ORDER, "3h", ["x"], 5, by).fit_transform(d),
    "incidents": lambda d, by: exploration.incident_curves(d, ORDER, max_gap=2, partition_by=by), "judged incidents": lambda d, by: exploration.incident_curves(d, ORDER, max_gap=130, min_duration=3, max_gap_perc=0.6, min_dist_total=20, partition_by=by),
    "lag correlation": lambda d, by: exploration.lag_correlation(d.select("t", "k", "x", "key", (F.col("k") * 1.0).alias("y")), "y", ORDER, 4, cols=["x"], partition_by=by),
    "targets": lambda d, by: reshaping.make_differenced_target(d, "x", [1, 75], ORDER, partition_by=by), "windows": lambda d, by: reshaping.recurrent(d, ["x"], 3, ORDER, 2, True, by), "padded": lambda d, by: reshaping.padded(d, "10min", ["x"], "t", 3, by).drop("key"),
}


def rows_of(df):
    cells = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else [cells(w) for w in v] if isinstance(v, list) else v
    cols = sorted(df.columns)
    return sorted(([cells(r[c]) for c in cols] for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(CASES))
def test_without_a_key_as_with_one(spark, long, monkeypatch, name):
    """A constant key gives one task and plain windows; without it the rows are the same, from many blocks."""
    want = CASES[name](long, ["key"])
    for k, v in SMALL.items():
        monkeypatch.setattr(series, k, v)
    got = CASES[name](long, [])
    plan = got._jdf.queryExecution().executedPlan().toString()
    if name not in ("spacing", "padded", "lag correlation"):  # aggregates of all rows
        alone = [x.strip()[:200] for x in plan.splitlines() if "SinglePartition" in x]
        assert not alone, alone
    assert rows_of(got.select(*[col(c) for c in want.columns])) == rows_of(want)


def test_no_rows_and_one_row(spark, long):
    for n in (0, 1):
        few = long.orderBy("k").limit(n)
        for name in ("long mean", "rows and spans", "average", "flat lines", "incidents", "ewm", "range lag back"):
            assert CASES[name](few, []).count() == n


def test_many_null_times(spark, long, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 64)
    holes = long.withColumn("t", F.when(F.col("k") % 3 > 0, F.col("t")))
    assert CASES["long mean"](holes, []).count() == N and CASES["previous"](holes, []).count() == N and CASES["std by span"](holes, []).count() == N


@pytest.mark.parametrize("seed", range(4))
def test_kernels(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    x = np.round(rng.standard_normal(n) * 10 ** rng.integers(0, 6), int(rng.integers(0, 4)))
    present = rng.random(n) < rng.choice([0.3, 0.95])
    low = rng.integers(0, n, 500)
    high = low + 1 + rng.integers(0, n - low)
    for kind in ("sum", "mean", "min", "max", "var", "std", "median", "trimmean", "numpos"):
        value, there = ranges.rolling(kind, 2, 0.15)(x, present, low, high)
        for i in range(500):
            v = x[low[i] : high[i]][present[low[i] : high[i]]]
            rows = high[i] - low[i] if kind == "numpos" else len(v)
            cut = math.floor(len(v) * 0.15)
            assert there[i] == (rows >= 2)
            if there[i]:
                want = {"sum": v.sum, "mean": v.mean, "min": v.min, "max": v.max, "var": lambda v=v: v.var(ddof=1), "std": lambda v=v: v.std(ddof=1), "median": lambda v=v: np.median(v), "trimmean": lambda v=v, cut=cut: np.sort(v)[cut : len(v) - cut].mean(), "numpos": lambda v=v: (v > 0).sum()}[kind]()
                assert value[i] == pytest.approx(want, rel=1e-9, abs=1e-9), kind


def test_a_large_value_leaves_no_trace():
    """Windows that don't hold the outlier are as exact as if it had never been."""
    x = np.full(1000, 0.1)
    x[500] = 1e18
    low = np.arange(950)
    for kind, want in (("sum", 5.0), ("mean", 0.1), ("var", 0.0)):
        value, _ = ranges.rolling(kind, 1)(x, np.ones(1000, bool), low, low + 50)
        clear = (low > 500) | (low + 50 <= 500)
        assert np.abs(value[clear] - want).max() < 1e-12


def test_infinite_values_stay_in_their_windows():
    x = np.array([1.0, np.inf, 2.0, 3.0, -np.inf, 4.0, 5.0, 6.0, 7.0])
    low, high = np.array([0, 2, 5, 0]), np.array([3, 4, 9, 9])
    value, there = ranges.rolling("trimmean", 1, 0.34)(x, np.ones(9, bool), low, high)
    assert there.all() and value.tolist() == [2.0, 2.5, 5.5, 4.0]
    assert ranges.rolling("median", 1)(x, np.ones(9, bool), low, high)[0].tolist() == [2.0, 2.5, 5.5, 4.0]


def test_cost_follows_rows_not_the_window():
    """A window of 10,000 rows takes no more than a few times that of 50."""
    import time

    x, n = np.random.default_rng(0).standard_normal(200_000), 200_000
    i = np.arange(n)

    def took(kind, w):
        began = time.process_time()
        ranges.rolling(kind, 1)(x, np.ones(n, bool), np.maximum(i - w + 1, 0), i + 1)
        return time.process_time() - began

    for kind in ("sum", "std", "max", "median"):
        took(kind, 50)
        assert took(kind, 10_000) < 6 * took(kind, 50) + 0.05, kind
