"""Hand-made cases of the time-series operators."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.durations import duration
from tidegrid.operators import cleaning, exploration, features, metrics, models, reshaping, validation
from tidegrid.plans import plot_data


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(i, datetime(2020, 1, 1) + timedelta(hours=i), *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "i long, t timestamp, " + ", ".join(f"`{k}` double" for k in columns))


def values(df, column, order="i"):
    return [r[0] for r in df.orderBy(order).select(F.col(f"`{column}`")).collect()]


def close(a, b):
    return len(a) == len(b) and all((x is None and y is None) or (x is not None and y is not None and math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))


X = [10, 12, 15, 9, 0, 0, 1]


@pytest.mark.parametrize(
    ("kind", "n", "want"),
    [
        ("sum", 2, [None, 22, 27, 24, 9, 0, 1]),
        ("mean", 3, [None, None, 37 / 3, 12, 8, 3, 1 / 3]),
        ("diff", 1, [None, 2, 3, -6, -9, 0, 1]),
        ("numpos", 2, [None, 2, 2, 2, 1, 0, 1]),
        ("lag", 2, [None, None, 10, 12, 15, 9, 0]),
    ],
)
def test_rolling(spark, kind, n, want):
    step = features.BuildRollingFeatures("t", kind, 0, n, ["x"])
    assert close(values(step.transform(series(spark, x=X)), f"x#{kind}_{n}"), want)


def test_rolling_missing_lookback_trim_and_spans(spark):
    roll = lambda x, **k: values(features.BuildRollingFeatures("t", cols=["x"], **k).transform(series(spark, x=x)), next(iter([f"x#{k['rolling_type']}_{k['window_size']}"])))
    assert close(roll([10, 12, 15, None, 0, 0, 1], rolling_type="sum", lookback=0, window_size=2), [None, 22, 27, None, None, 0, 1])
    assert close(roll(X, rolling_type="sum", lookback=1, window_size=2), [None, None, 22, 27, 24, 9, 0])
    assert close(roll(X, rolling_type="trimmean", lookback=0, window_size=5, proportiontocut=0.3), [None] * 4 + [31 / 3, 7, 10 / 3])
    assert close(roll(X, rolling_type="sum", lookback=0, window_size="61min"), [10, 22, 27, 24, 9, 0, 1])
    assert close(roll(X, rolling_type="sum", lookback=0, window_size="60min"), X)
    ratio = roll(X, rolling_type="lag", lookback=0, window_size=1, deviation="divide")
    assert ratio[0] is None and ratio[4] == 0 and ratio[5] is None and ratio[6] == math.inf


def test_spectra(spark):
    out = features.BuildRollingFeatures("t", "fourier", 0, 4, ["x"]).transform(series(spark, x=X))
    assert close(values(out, "x#fourier_4_2"), [None] * 3 + [abs(10 - 12 + 15 - 9), abs(12 - 15 + 9), abs(15 - 9), abs(9 - 1)])
    got = features.BuildRollingFeatures("t", "nfft", 0, "3h", ["x"], nfft_ncol=3).transform(series(spark, x=X))
    assert values(got, "x#nfft_3h_1") == [0.0] * 7
    with pytest.raises(ValueError):
        features.BuildRollingFeatures("t", "fourier", deviation="divide", cols=["x"]).transform(series(spark, x=X))


def test_range_lag(spark):
    x = [0, 0, 1, 0, 0, 0, 1]
    got = lambda r: values(features.range_lag_column(series(spark, x=x), "x", r, "t"), "x")
    assert got((1, 2)) == [1, 1, 0, 0, 1, 1, 0] and got((-1, 0)) == [0, 0, 1, 1, 0, 0, 1] and got((1, -1)) == [0, 1, 1, 1, 0, 1, 1]


def test_corrections(spark):
    x = [0, 2, -1, 2, 2, 1]
    df = series(spark, x=x)
    assert values(cleaning.correct_above_threshold(df, "x", 1, "na"), "x") == [0, None, -1, None, None, 1]
    assert values(cleaning.correct_above_threshold(df, "x", 1, "previous", time_col="t"), "x") == [0, 0, -1, -1, -1, 1]
    assert values(cleaning.correct_outside_range(df, "x", (0, 1), "clip"), "x") == [0, 1, 0, 1, 1, 1]
    gap = series(spark, x=[None, 1, 5, 3, 9])
    assert close(values(cleaning.correct_above_threshold(gap, "x", 4, "average", time_col="t"), "x"), [None, 1, 2, 3, 3])
    with pytest.raises(ValueError):
        cleaning.correct_outside_range(df, "x", (1, 0))


def test_incidents(spark):
    rows = [0.3, None, 0.3, None, 0.3, 0.5, None, 0.7]
    df = series(spark, ACTUAL=rows, PREDICT_LOW=[0.4] * 8, PREDICT_HIGH=[0.6] * 8)
    got = lambda **k: values(exploration.incident_curves(df, "t", **k), "OUTLIER_CURVE")
    assert got() == [1, 0, 2, 0, 3, 0, 0, 4]
    assert got(max_gap=1) == [1, 1, 1, 1, 1, 0, 0, 2]
    assert got(max_gap=1, max_gap_perc=0.2) == [0] * 7 + [2]


def test_validators(spark):
    x = [1, 2, 6, 3, 4, 4, 4, 3, 6, 7, 7, 2, 2]
    got = values(validation.FlatlineValidator("t", 3, ["x"]).fit_transform(series(spark, x=x)), "x")
    assert [i for i, v in enumerate(got) if v is None] == [4, 5, 6]
    auto = validation.FlatlineValidator("t", "auto", ["x"], pvalue=1e-100).fit_transform(series(spark, x=x))
    assert values(auto, "x") == x
    spike = [float(i % 3) for i in range(40)]
    spike[25] = 100.0
    got = values(validation.MADValidator("t", 5, ["x"]).fit_transform(series(spark, x=spike)), "x")
    assert [i for i, v in enumerate(got) if v is None] == [25]
    pipe = validation.create_validation_pipe("t", ["x", "y"], 5, flatline_window=30)
    bad = series(spark, x=spike, y=[2 * v if v < 50 else 2.0 for v in spike])
    out = pipe.fit_transform(bad)
    assert math.isclose(values(out, "x")[25], 1.0, abs_tol=0.2)
    # What was learnt on one table is used on another, also after a way through JSON.
    other = series(spark, x=[1.0, 200.0, 1.0, None, 0.0, 2.0], y=[2.0, 2.0, 2.0, 4.0, 0.0, 4.0])
    again = validation.ValidationPipe.from_dict(json.loads(json.dumps(pipe.to_dict())))
    got = values(again.transform(other), "x")
    assert got == values(pipe.transform(other), "x") and math.isclose(got[1], 1.0, abs_tol=0.2) and math.isclose(got[3], 2.0, abs_tol=0.2) and got[4] == 0.0
    for method, want in (("mean", 2.5), ("median", 1.0), ("most_frequent", 1.0), ("constant", 9.0)):
        assert values(validation.imputed(series(spark, x=[1, 1, None, 0, 8]), ["x"], method, 9.0), "x")[2] == want
    spread = validation.MADValidator("t", "4h", ["x"], 3).fit_transform(series(spark, x=spike))
    assert [i for i, v in enumerate(values(spread, "x")) if v is None] == [25]


def test_normalise(spark):
    at = lambda s: datetime.fromisoformat(f"2018-01-01 {s}")
    df = spark.createDataFrame([(at("15:45:09"), 1, "a", 1.0), (at("16:03:09"), 1, "a", 2.0), (at("16:10:09"), 1, "a", 3.0), (at("16:22:09"), 1, "a", 4.0)], "TIME timestamp, ID int, TYPE string, VALUE double")
    got = lambda **k: [r.VALUE for r in reshaping.normalize_timestamps(df, "15min", **k).orderBy("TIME").collect()]
    bounds = {"start_time": "2018-01-01 15:45:00", "end_time": "2018-01-01 16:30:00"}
    assert got(**bounds) == [None, 1, 3, 4] and got(aggregate_method="sum", **bounds) == [None, 1, 5, 4]
    assert got(fillna_method="bfill", **bounds) == [1, 1, 3, 4] and got() == [1, 3, 4]
    with pytest.raises(ValueError):
        reshaping.normalize_timestamps(df.withColumn("ID", F.lit(None).cast("int")), "15min").collect()


def test_reshaping(spark):
    at = datetime(2020, 1, 1)
    long = spark.createDataFrame([(at, "A", "X", 1.0), (at, "B", "Y", 2.0)], "TIME timestamp, ID string, TYPE string, VALUE double")
    wide = reshaping.long_to_wide(long)
    assert wide.columns == ["TIME", "A_X", "B_Y"]
    assert sorted((r.ID, r.TYPE, r.VALUE) for r in reshaping.wide_to_long(wide).collect()) == [("A", "X", 1.0), ("B", "Y", 2.0)]
    with pytest.raises(ValueError):
        reshaping.long_to_wide(long.union(long))
    target = reshaping.make_differenced_target(series(spark, y=[100, 200, 500, 1000]), "y", [1, 2], "t")
    assert values(target, "y_diff_1") == [100, 300, 500, None] and values(target, "y_diff_2") == [400, 800, None, None]


def test_metrics(spark):
    y = series(spark, y=[1, 2, 3, 4, 5], p=[1.1, 2.1, 3.1, 4.1, 5.1])
    for shift, want in ((1, 0.1), (2, 0.05), (4, 0.025)):
        assert math.isclose(metrics.mean_absolute_scaled_error(y, "y", "p", shift, "t").first()[0], want, rel_tol=1e-9)
    inc = series(spark, inc=[0, 0, 0, 1, 1, 0, 1, 0], pred=[0, 1, 0, 0, 0, 0, 0, 0])
    assert math.isclose(metrics.incident_recall(inc, "inc", "pred", (2, 3), "t").first()[0], 2 / 3)
    curve = series(spark, pred=[0.4, 0.4, 0.1, 0.2, 0.6, 0.5, 0.1], inc=[0, 1, 0, 0, 0, 0, 1])
    got = metrics.precision_incident_recall_curve(curve, "inc", "pred", (0, 2), "t").orderBy("threshold").collect()
    assert [r.threshold for r in got] == [0.1, 0.2, 0.4, 0.5, 0.6]
    assert close([r.precision for r in got], [5 / 7, 0.8, 1, 1, 1]) and close([r.recall for r in got], [1, 1, 1, 0.5, 0.5])


def test_models(spark):
    n = 100
    df = series(spark, x=[i / (n - 1) for i in range(n)], y=[420 + 69 * i / (n - 1) for i in range(n)])
    lasso = models.LassoTimeseriesRegressor("t", "y", ["x"], quantiles=[0.1, 0.9], alpha=0.001).fit(df)
    assert abs(lasso.score(df)) <= 3
    again = models.TimeseriesRegressor.load(lasso.dump())
    assert math.isclose(again.score(df), lasso.score(df))
    # Features from raw columns inside the model, a scaled target, and the same after a way through JSON.
    engineer = features.SimpleFeatureEngineer("t", [("x", "lag", 1), ("x", "mean", 2)], keep_original=True)
    inside = models.LassoTimeseriesRegressor("t", "y", ["x_lag_1", "x_mean_2"], predict_ahead=[1], alpha=0.0, engineer=engineer, scale_y=True).fit(df)
    assert abs(inside.score(df)) < 1e-6 and math.isclose(models.TimeseriesRegressor.load(inside.dump()).score(df), inside.score(df))
    net = models.MLPTimeseriesRegressor("t", "y", ["x"], predict_ahead=[1], epochs=500).fit(df)
    assert abs(net.score(df)) <= 3
    assert models.permutation_importances(lasso, df).first().importance > 5
    two = df.withColumn("z", F.sin("i"))
    both = models.MLPTimeseriesRegressor("t", "y", ["x", "z"], quantiles=[0.9], epochs=300).fit(two)
    weight = {(r.feature, r.output): r.importance for r in models.quantile_importances(both, two).collect()}
    assert weight["x", "mean"] > 5 > abs(weight["z", "mean"]) and weight["x", "0.9"] > weight["z", "0.9"]
    parts = models.shapley_contributions(both, both.predict(two), orders=2).select("base", "x_contribution", "z_contribution", "predict_lead_0_mean").collect()
    assert all(math.isclose(r[0] + r[1] + r[2], r[3], rel_tol=1e-9) for r in parts) and max(abs(r.x_contribution) for r in parts) > max(abs(r.z_contribution) for r in parts)
    line = models.shapley_contributions(lasso, df, orders=1).orderBy("i").first()
    assert math.isclose(line.x_contribution, lasso.contributions(df).orderBy("i").first().x_contribution, rel_tol=1e-9)
    with pytest.raises(ValueError):
        models.ConstantTimeseriesRegressor("t", "y", predict_ahead=[0], use_diff_of_y=True).fit(df)
    heavy = df.withColumn("w", F.when(F.col("i") < 50, 1.0).otherwise(0.0)).withColumn("y", F.when(F.col("i") < 50, F.col("y")).otherwise(0.0))
    assert math.isclose(models.LassoTimeseriesRegressor("t", "y", ["x"], alpha=0.0, weight="w").fit(heavy).state["0"]["fit"]["mean"][1], 69, rel_tol=1e-6)
    weighed = models.MLPTimeseriesRegressor("t", "y", ["x"], epochs=300, weight="w").fit(heavy)
    assert abs(weighed.predict(df).where("i = 10").first()["predict_lead_0_mean"] - 427) < 15
    table = models.benchmark_wrapper({"line": lasso, "flat": models.ConstantTimeseriesRegressor("t", "y")}, {"made": df}, {"made": ["x", "skip"]}, {"made": "y"}, "t", "1h", {"made": "2020-01-04"}, lambda c: c != "skip").collect()
    got = {r.method: r.score for r in table}
    assert set(got) == {"line", "flat", "persistence", "mean"} and got["line"] < got["flat"]
    scores = models.benchmark_model(df.where("i < 80"), df.where("i >= 80"), models.LassoTimeseriesRegressor("t", "y", ["x"], predict_ahead=[2], alpha=0.001)).first()
    assert scores.model < scores.persistence < scores["mean"]


def test_quantile_regression(spark):
    """No worse than any line of a grid; a feature that matters has a small p-value, noise has not."""
    rng = np.random.default_rng(3)
    x, z = rng.uniform(0, 10, 600), rng.normal(0, 1, 600)
    y = 3 + 2 * x + rng.exponential(1, 600) * (1 + 0.3 * x)
    df = series(spark, x=x, z=z, y=y)
    model = models.LinearQuantileRegression("y", ["x", "z"], [0.1, 0.9], max_iter=25).fit(df)
    loss = lambda e, q: np.mean(np.maximum(q * e, (q - 1) * e))
    for q in (0.1, 0.9):
        own = model.coef_[q]
        best = loss(y - own["const"] - own["x"] * x - own["z"] * z, q)
        grid = min(loss(y - own["const"] - a - (own["x"] + b) * x - (own["z"] + c) * z, q) for a in np.linspace(-0.5, 0.5, 11) for b in np.linspace(-0.2, 0.2, 11) for c in np.linspace(-0.2, 0.2, 11))
        assert best <= grid * 1.005 and model.pvalue_[q]["x"] < 1e-6 < model.pvalue_[q]["z"] and 0 <= model.pvalue_[q]["z"] <= 1
    assert model.score(df) > 0 and model.predict(df).columns[-2:] == ["predict_q_0.1", "predict_q_0.9"]
    with pytest.raises(ValueError):
        models.LinearQuantileRegression("y", ["x"], [1.5]).fit(df)


def test_ewm_against_pandas(spark):
    """Long enough for several blocks, with gaps, in two series."""
    rng = random.Random(1)
    x = [None if rng.random() < 0.2 or 900 < i < 1900 else rng.uniform(-5, 9) for i in range(2500)]
    df = series(spark, x=x).withColumn("k", F.col("i") % 2)
    for a in (0.4, 0.9, 0.05, 1.0):
        got = values(features.BuildRollingFeatures("t", "ewm", 0, cols=["x"], alpha=a, partition_by=["k"]).transform(df), f"x#ewm_{a}")
        for k in (0, 1):
            want = pd.Series(x[k::2], dtype=float).ewm(alpha=a).mean()
            assert close(got[k::2], [None if math.isnan(v) else v for v in want]), a


def test_wavelet_and_fourier_against_numpy(spark):
    rng = random.Random(2)
    x = [rng.uniform(-3, 3) for _ in range(20)] + [None] + [1.0] * 9
    df = series(spark, x=x)
    for kind, n, f in (("fourier", 5, features.spectrum), ("cwt", 6, lambda v: features.ricker(v, 2))):
        step = features.BuildRollingFeatures("t", kind, 1, n, ["x"], width=2)
        out = step.transform(df)
        for i, name in enumerate(step.made):
            want = [None] + [None if k < n - 1 or None in x[k - n + 1 : k + 1] else float(f(np.array(x[k - n + 1 : k + 1]))[i]) for k in range(len(x) - 1)]
            assert close(values(out, name), want), name
    # Non-uniform sums of an even window of equal steps, against the definition.
    n = 8
    out = features.BuildRollingFeatures("t", "nfft", 0, f"{n}h", ["x"], nfft_ncol=3).transform(df)
    v = np.array(x[12 - n + 1 : 13])
    place = np.arange(-n + 1, 1) / n + 0.5
    for i in range(3):
        assert math.isclose(values(out, f"x#nfft_{n}h_{i + 1}")[12], abs(sum(v * np.exp(2j * np.pi * (i + 1) * place))), rel_tol=1e-9)


def test_rank_correlations_against_pandas(spark):
    rng = random.Random(4)
    x = [rng.choice((None, rng.randint(0, 9), rng.uniform(0, 9))) for _ in range(400)]
    y = [rng.choice((3, 3, rng.uniform(0, 9) + (v or 0))) for v in x]
    df, pdf = series(spark, x=x, y=y), pd.DataFrame({"x": x, "y": y}, dtype=float)
    spearman = [pdf.x.shift(n)[lambda s: s.notna()].rank().corr(pdf.y[pdf.x.shift(n).notna()].rank()) for n in (0, 3)]
    assert close(values(exploration.lag_correlation(df, "y", "t", [0, 3], "spearman", ["x"]), "x", "LAG"), spearman)
    pairs = [(pdf.x.shift(n)[i], pdf.y[i]) for n in (0,) for i in range(400) if not math.isnan(pdf.x.shift(n)[i])]
    sign = lambda v: int(v > 0) - int(v < 0)
    both = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for a in pairs for b in pairs]
    tau = sum(p * q for p, q in both) / math.sqrt(sum(p * p for p, _ in both) * sum(q * q for _, q in both))
    assert close(values(exploration.lag_correlation(df, "y", "t", [0], "kendall", ["x"]), "x", "LAG"), [tau])
    largest = exploration.lag_correlation(df, "y", "t", [0], lambda a, b: float(a.max()), ["x"])
    assert values(largest, "x", "LAG") == [max(v for v in x if v is not None)]
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    assert exploration.concordance(a, b) * 2 == sum(p * q for p, q in both)


def test_rolling_search(spark):
    """The target is the mean of five values: the search finds its window, and the forecast gets better for it."""
    rng = random.Random(5)
    x = [rng.uniform(0, 1) for _ in range(400)]
    df = series(spark, x=x, y=[sum(x[max(0, i - 4) : i + 1]) / 5 for i in range(400)])
    search = features.RollingSearch("t", "y", ["x"], ((2, 5, 9),), ("mean", "lag")).fit(df)
    assert "x#mean_5" in search.chosen and search.r2_rolling > 0.99 > search.r2_base
    assert max(search.importances, key=search.importances.get) == "x#mean_5"
    assert set(search.transform(df).columns) == {*df.columns, *search.chosen}
    with pytest.raises(ValueError):
        features.RollingSearch("t", "y", ["x"], cv=1).fit(df)


def test_small_ones(spark):
    df = series(spark, x=[1, None], y=[1, 2])
    assert cleaning.contains_nans(df) and not cleaning.contains_nans(df.select("y"))
    with pytest.raises(AssertionError):
        cleaning.assert_contains_nans(df)
    assert features.identity_features(df).columns == ["i", "x", "y"] and features.identity_features(df, False).columns == df.columns
    scorer = metrics.make_incident_recall_scorer((1, 1), "t")
    assert scorer(series(spark, incident=[0, 1, 0, 1], prediction=[1, 0, 0, 0])) == 0.5
    line = models.LassoTimeseriesRegressor("t", "y", ["x"], alpha=0.0).fit(series(spark, x=[0, 1, 2, 3], y=[1, 3, 5, 7]))
    assert close(values(line.contributions(series(spark, x=[0, 2], y=[1, 5])), "x_contribution"), [-2, 2])
    sums = models.importance_sums(spark.createDataFrame([("a#mean_2", 1.0), ("a#lag_1", 2.0), ("b", 1.0)], "feature string, importance double"))
    assert {r.feature: (r.importance, r.share) for r in sums.collect()} == {"a": (3.0, 0.75), "b": (1.0, 0.25)}
    scores = plot_data.score_table(spark.createDataFrame([(1, 0.5, 0.7)], "lead int, model double, mean double"))
    assert sorted(tuple(r) for r in scores.collect()) == [(1, "mean", 0.7), (1, "model", 0.5)]
    twice = spark.createDataFrame([(datetime(2019, 10, 27, 2, 0), 1.0), (datetime(2019, 10, 27, 2, 0), 3.0), (datetime(2019, 10, 27, 3, 0), 5.0)], "TIME timestamp, VALUE double")
    assert sorted(r.VALUE for r in reshaping.average_winter_time(twice, ["TIME"]).collect()) == [2.0, 5.0]


def test_durations():
    assert duration("15min") == 900_000_000 and duration("1h30min") == 5_400_000_000 and duration("min") == 60_000_000
    with pytest.raises(ValueError):
        duration("soon")
