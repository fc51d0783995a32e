"""Networks fitted on all rows: sums over tasks are those of one array, histories, hooks, early ends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import network
from tidegrid.operators import models


@pytest.fixture(scope="module")
def curve(spark):
    df = spark.range(600).select(F.col("id").alias("i"), F.timestamp_seconds(F.col("id") * 60).alias("t"), ((F.col("id") * 37 % 101) / 50 - 1).alias("x"), ((F.col("id") * 53 % 97) / 48 - 1).alias("z"))
    return df.withColumn("y", 5 + 3 * F.sin(3 * F.col("x")) + F.col("x") * F.col("z") + 0.1 * F.sin(F.col("i"))).repartition(4).cache()


def test_gradients():
    """Against differences of the losses, with two hidden layers, weights, validation rows and left-out units."""
    rng = np.random.default_rng(1)
    data = np.column_stack([np.arange(50), rng.random(50) < 0.2, rng.random(50), rng.standard_normal((50, 4))])
    p = network.started([3, 5, 4, 3], 2)
    for dropout in (0.0, 0.4):
        loss = lambda q: network.summed(q, data, [0.2, 0.9], dropout, 3, 7)[1][0, 1]
        grads, _ = network.summed(p, data, [0.2, 0.9], dropout, 3, 7)
        for k, a in enumerate(p):
            for at in list(np.ndindex(a.shape))[:6]:
                ends = []
                for step in (1e-6, -1e-6):
                    q = [b.copy() for b in p]
                    q[k][at] += step
                    ends.append(loss(q))
                assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(grads[k][at], rel=1e-4, abs=1e-5)


def test_tasks_sum_to_one_array(spark, curve):
    rows = curve.select(F.lit(1.0).alias("w"), "y", "x", "z", (F.col("i") % 5 == 0).alias("validation"))
    one, many = (network.fitted(rows, [6, 4], [0.9], 8, 0.05, dropout=0.2, local_rows=n) for n in (10_000, 0))
    assert len(one[1]) == len(many[1]) == 8
    # Both number their rows alike, so left-out units agree too.
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(one[0], many[0], strict=True))
    assert one[1][-1]["val_loss"] == pytest.approx(many[1][-1]["val_loss"]) and one[1][-1]["loss"] < one[1][0]["loss"]


def test_forecaster(spark, curve):
    train, test = curve.where("i % 4 > 0"), curve.where("i % 4 = 0")
    seen = models.R2Evaluation(log=False)
    net = models.MLPTimeseriesRegressor("t", "y", ["x", "z"], quantiles=[0.1], hidden=[12, 6], epochs=150, rate=0.03)
    net.fit(train, validation=test, on_epoch=seen)
    assert len(seen.val_r2[0]) == 150 and seen.val_r2[0][-1] > 0.95 > seen.val_r2[0][0]
    got = net.predict(test).select("y", "predict_lead_0_mean", F.col("`predict_lead_0_q_0.1`").alias("low")).toPandas()
    assert 1 - ((got.y - got.predict_lead_0_mean) ** 2).mean() / got.y.var(ddof=0) == pytest.approx(seen.val_r2[0][-1], abs=0.01)  # SQL is the network
    assert (got.y < got.low).mean() < 0.3
    again = models.TimeseriesRegressor.load(net.dump())
    assert again.predict(test).agg(F.sum("predict_lead_0_mean")).first()[0] == pytest.approx(got.predict_lead_0_mean.sum())


def test_early_ends(spark, curve):
    made = lambda **o: models.MLPTimeseriesRegressor("t", "y", ["x"], epochs=400, rate=0.1, validation_share=0.3, **o)
    short = made(patience=3).fit(curve).state["0"]["fit"]["history"]
    assert len(short) < 400 and short[-1]["val_loss"] is not None
    stopped = made().fit(curve, on_epoch=lambda told: told["epoch"] == 5).state["0"]["fit"]["history"]
    assert [h["epoch"] for h in stopped] == [1, 2, 3, 4, 5]
