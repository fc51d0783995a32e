"""The rolling search with a Bayesian ridge and with forests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import features


def test_ridge_has_the_greatest_evidence():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 3)) * [1, 2, 0.5] + [3, 0, 1]
    y = x @ [0.5, -0.2, 0.0] + 4 + rng.standard_normal(60)
    full = np.column_stack([np.ones(60), x, y])
    got = features.evidence_ridge(full.T @ full, [0, 1, 2, 3])
    xc, yc = x - x.mean(0), y - y.mean()

    def evidence(noise, weight):
        cover = np.eye(60) / noise + xc @ xc.T / weight
        return -0.5 * (np.linalg.slogdet(cover)[1] + yc @ np.linalg.solve(cover, yc))

    grid = [(evidence(a, b), a, b) for a in np.geomspace(0.2, 5, 60) for b in np.geomspace(0.5, 500, 80)]
    _, noise, weight = max(grid)
    w = np.linalg.solve(xc.T @ xc + weight / noise * np.eye(3), xc.T @ yc)
    assert got[1:] == pytest.approx(w, abs=0.01) and got[0] == pytest.approx(y.mean() - got[1:] @ x.mean(0))


@pytest.fixture(scope="module")
def squares(spark):
    """The target is the square of the value three rows ago: no line finds it."""
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 900)
    y = np.concatenate([np.zeros(3), x[:-3] ** 2])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x double, y double").withColumn("t", F.timestamp_seconds(F.col("i") * 60)).repartition(3).cache()


def test_only_a_forest_finds_a_square(squares):
    made = {k: features.RollingSearch("t", "y", ["x"], ((1, 2, 3, 5),), ("lag",), 2, estimator_type=k, trees=5).fit(squares) for k in ("lin", "bayeslin", "rf")}
    assert made["rf"].chosen == ["x#lag_3"] and made["rf"].r2_rolling > 0.8 > 0.1 > made["rf"].r2_base
    assert made["rf"].importances["x#lag_3"] > 0.9
    assert all(made[k].r2_rolling < 0.1 for k in ("lin", "bayeslin"))
    with pytest.raises(ValueError, match="estimator_type"):
        features.RollingSearch("t", "y", ["x"], estimator_type="tree").fit(squares)
