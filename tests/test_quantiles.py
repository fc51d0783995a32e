"""Penalised quantile regression against all corners, and over more rows than come to the driver."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import quantile_lines
from tidegrid.operators import models


def objective(x, y, s, q, alpha, w):
    e = y - x @ w
    return (s * np.where(e >= 0, q * e, (q - 1) * e)).sum() / s.sum() + alpha * np.abs(w[1:]).sum()


def least(x, y, s, q, alpha):
    """The least objective over all points where as many residuals or weights are zero as there are unknowns."""
    p = x.shape[1]
    rows, goal = np.vstack([x, np.eye(p)[1:]]), np.concatenate([y, np.zeros(p - 1)])
    found = []
    for pick in itertools.combinations(range(len(rows)), p):
        a = rows[list(pick)]
        if abs(np.linalg.det(a)) > 1e-9:
            found.append(objective(x, y, s, q, alpha, np.linalg.solve(a, goal[list(pick)])))
    return min(found)


@pytest.mark.parametrize(("seed", "p", "q", "alpha"), [(0, 2, 0.5, 0.0), (1, 2, 0.1, 0.3), (2, 3, 0.9, 0.05), (3, 3, 0.25, 5.0), (4, 1, 0.7, 0.0), (5, 3, 0.5, 0.2)])
def test_corner_is_the_best_of_all(seed, p, q, alpha):
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.ones((25, 1)), np.round(rng.standard_normal((25, p - 1)) * 3, 1)], 1)
    y, s = np.round(x @ rng.standard_normal(p) * 10 + rng.standard_normal(25) * 4, seed % 3), rng.integers(1, 4, 25).astype(float)  # ties too
    cost = np.r_[0.0, np.full(p - 1, alpha * s.sum())]
    w = quantile_lines.corner(np.vstack([x, np.eye(p)]), np.r_[y, np.zeros(p)], np.r_[q * s, cost], np.r_[(1 - q) * s, cost], np.zeros(p), np.linalg.lstsq(x, y, rcond=None)[0])
    assert objective(x, y, s, q, alpha, w) == pytest.approx(least(x, y, s, q, alpha), rel=1e-8, abs=1e-9)


def test_many_rows_come_as_sums(spark):
    """With room for 60 rows the weights are those of all 2000 at once; the penalty moves them, and weights count."""
    rng = np.random.default_rng(7)
    x, z = rng.standard_normal(2000), rng.integers(0, 5, 2000)
    y = 3 * x - z + rng.standard_normal(2000) * (1 + np.abs(x))
    df = spark.createDataFrame([(float(a), float(b), float(c), float(i % 3)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "x double, z double, y double, s double")
    columns, full = [F.lit(1.0), F.col("x"), F.col("z")], np.column_stack([np.ones(2000), x, z])
    for q, alpha in ((0.1, 0.0), (0.8, 0.2)):
        s = np.arange(2000) % 3 * 1.0
        got = [quantile_lines.fitted(df, columns, F.col("y"), q, np.zeros(3), F.col("s"), alpha, (0,), most=m) for m in (60, 20_000)]
        a, b = (objective(full, y, s, q, alpha, w) for w in got)
        assert a == pytest.approx(b, rel=1e-9)
        assert all(objective(full, y, s, q, alpha, got[1] + d) >= b - 1e-12 for d in 0.01 * np.vstack([np.eye(3), -np.eye(3)]))
    assert quantile_lines.fitted(df.limit(0), columns, F.col("y"), 0.5, np.ones(3), F.lit(1.0)).tolist() == [1, 1, 1]


def test_forecaster_takes_the_penalty(spark):
    df = spark.createDataFrame([(i, float(i % 10), 2.0 * (i % 10) + i % 3) for i in range(60)], "i int, x double, y double").withColumn("t", F.timestamp_seconds(F.col("i") * 60))
    fit = lambda alpha, **o: models.LassoTimeseriesRegressor("t", "y", ["x"], quantiles=[0.9], alpha=alpha, **o).fit(df).state["0"]["fit"]
    assert fit(0.0)["0.9"] == pytest.approx([2.0, 2.0])
    assert fit(100.0)["0.9"][1] == pytest.approx(0.0, abs=1e-9)  # so dear that only the quantile is left
    assert fit(0.0, average_type="median")["mean"] == pytest.approx([1.0, 2.0])
    with pytest.raises(ValueError, match="median"):
        models.LassoTimeseriesRegressor("t", "y", ["x"], quantiles=[0.5], average_type="median").fit(df)
