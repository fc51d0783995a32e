"""What a review found on odd inputs and larger tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import order, quantile_lines, ranges, series
from tidegrid.operators import exploration, features, models
from tidegrid.plans import queries as plans


def test_incidents_at_equal_times_go_by_the_tie_break(spark):
    """Rows of one time are ordered by the second column, in whatever order they come."""
    rows = [("a", 1, k, v) for k, v in enumerate([50.0, 90.0, 50.0, 90.0, 50.0, 50.0, 90.0, 50.0])]
    kind = "u string, t long, k long, ACTUAL double"
    with_bounds = lambda r: spark.createDataFrame(r, kind).coalesce(1).withColumns({"PREDICT": F.lit(40.0), "PREDICT_LOW": F.lit(10.0), "PREDICT_HIGH": F.lit(80.0)})
    for r in (rows, rows[::-1]):
        for by in (["u"], []):
            found = exploration.incident_curves_information(with_bounds(r), ["t", "k"], partition_by=by, max_gap=1)
            assert sorted((x.OUTLIER_CURVE, x.OUTLIER_DURATION) for x in found.collect()) == [(1, 3), (2, 1)]


def test_a_sum_on_the_limit_stays_in_any_order(spark):
    """0.12 + 6.57 + 3.31 is 10, in some orders of doubles less."""
    a, b, c = 0.11999999999999922, 6.57, 3.3099999999999996
    assert a + (b + c) < 10 <= a + b + c
    for own in ([a, b, c], [c, b, a], [b, c, a]):
        df = spark.createDataFrame(list(enumerate(own)), "t long, ACTUAL double").coalesce(1)
        df = df.withColumns({"PREDICT_LOW": F.lit(-1.0), "PREDICT_HIGH": F.lit(0.0), "u": F.lit(1)})
        for by in (["u"], []):
            assert exploration.incident_curves(df, "t", min_dist_total=10, partition_by=by).where("OUTLIER_CURVE = 1").count() == 3


def on_the_limit(tmp_path):
    """Pairs of events that are 10 outside their bounds together by their decimals, as doubles 10 or less in either order."""
    pairs = [(round(80 + c / 100, 2), round(c / 100, 2)) for c in range(1, 1000)]
    sums = [(a - 80) + (10 - b) for a, b in pairs]
    assert sum(x < 10 for x in sums) > 300 and sum(x >= 10 for x in sums) > 300
    values = [v for a, b in pairs for v in (50.0, 50.0, a, b)]
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?) AS value", [values])
    con.sql("CREATE TABLE events AS SELECT rowid AS event_id, TIMESTAMP '2024-01-01' + to_seconds(rowid) AS ts, rowid // 400 AS user_id, 'view' AS event_type, value, '' AS props FROM v")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    return con


@pytest.mark.parametrize("name", ["incident_numbers", "incident_summary", "series_incidents"])
def test_incidents_of_two_on_the_limit_as_sql(spark, tmp_path, name):
    """The sum of two doubles is the same in any order: below the limit it is none, though its decimals are on it."""
    con = on_the_limit(tmp_path)
    assert sorted(map(tuple, plans.queries()[name](spark, str(tmp_path)).collect())) == sorted(con.execute(plans.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("least", [10.0, 8.0, 7.3, 0.1, 1e-7, 3e8, np.nextafter(10.0, 11.0)])
def test_sums_are_exact_on_the_limit(spark, least):
    """Verdicts on sums near a limit are those of the exact sum, rounded once."""
    rng, groups = np.random.default_rng(3), []
    for k in range(300):
        x = rng.random(int(rng.integers(2, 9))) * 10.0 ** -rng.integers(0, 20)
        x = x / x.sum() * least * rng.random()
        groups.append([*x.tolist(), float(max(0.0, least - x.sum()))])
        groups[-1][-1] += float(rng.integers(-3, 4)) * np.spacing(groups[-1][-1])
    groups += [[float("inf"), 1.0], [float("nan"), 0.0], [0.0], [least], [np.nextafter(least, 0.0)], [least * 1e9, 1.0]]
    want = {g: not math.fsum(x) < least for g, x in enumerate(groups)}
    assert 30 < sum(want.values()) < 280
    df = spark.createDataFrame([(g, float(v)) for g, x in enumerate(groups) for v in x], "g long, x double")
    for limit, n in ((0, len(groups)), (-1.0, len(groups)), (float("inf"), 2)):
        assert df.groupBy("g").agg(exploration._reached(F.col("x"), limit).alias("ok")).where("ok").count() == n
    assert {r.g: r.ok for r in df.groupBy("g").agg(exploration._reached(F.col("x"), least).alias("ok")).collect()} == want


def test_medians_to_the_last_digit(spark):
    """Medians of two are half of each, as SQL has it: a bound is met or not by the last digit."""
    rng = np.random.default_rng(0)
    a, b = np.round(rng.random(2000) * 100, 2), np.round(rng.random(2000) * 100, 2)
    assert (a + (b - a) * 0.5 != a * 0.5 + b * 0.5).any()
    x, low = np.column_stack([a, b]).ravel(), 2 * np.arange(2000)
    want = np.minimum(a, b) * 0.5 + np.maximum(a, b) * 0.5
    assert (ranges.median(x, low, low + 2) == want).all()
    i = int(np.flatnonzero(np.minimum(a, b) + np.abs(b - a) * 0.5 != want)[0])
    assert order.exact_quantiles(spark.createDataFrame([(float(a[i]),), (float(b[i]),)], "x double"), {"x": F.col("x")}, [0.5])["x"] == [want[i]]


def test_ratios_and_rounding_as_sql(spark, tmp_path):
    """Zero by zero, and a ratio between two decimals that falls below the middle when it is scaled."""
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, 1 AS user_id, 'view' AS event_type, v::DOUBLE AS value, '' AS props FROM (VALUES (1, 0), (2, 0), (3, 5), (4, 0), (5, NULL), (6, 64), (7, 67.1), (8, 1e300), (9, 1e-9)) t(i, v)) TO '{tmp_path}/events.parquet'")
    got = {r.event_id: r.r for r in plans.queries()["rolling_ratio"](spark, str(tmp_path)).collect()}
    want = dict(duckdb.sql(plans.oracle_sql()["rolling_ratio"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall())
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}


def test_ratios_to_the_last_bit(spark, tmp_path):
    """The NaN of zero by zero is the one that SQL gives, bit by bit, and NaN by zero isn't infinite."""
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, 1 AS user_id, 'view' AS event_type, v::DOUBLE AS value, '' AS props FROM (VALUES (1, '0'), (2, '0'), (3, 'nan'), (4, '0'), (5, 'inf'), (6, 'inf'), (7, '5'), (8, '0'), (9, '7'), (10, '3')) t(i, v)) TO '{tmp_path}/events.parquet'")
    sql = plans.oracle_sql()["rolling_ratio"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")
    got, want = (x.sort_values("event_id").r.to_numpy()[1:].view("u8").tolist() for x in (plans.queries()["rolling_ratio"](spark, str(tmp_path)).toPandas(), duckdb.sql(sql).df()))
    assert got == want


@pytest.mark.parametrize("kind", ["var", "median", "sum"])
def test_spans_longer_than_a_block(spark, monkeypatch, kind):
    """A span over most of a series, and values that repeat: rows of whole spans no longer go to one task (``by_span``)."""
    rng = np.random.default_rng(5)
    t, x = np.sort(rng.integers(0, 4000, 3000)), np.round(rng.standard_normal(3000) * 3, 1)
    x[:40] = 1e6
    df = spark.createDataFrame([(int(a), None if i % 17 == 0 else float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))], "s long, x double").withColumn("t", F.timestamp_seconds("s"))
    monkeypatch.setattr(series, "BLOCK_ROWS", 64)
    monkeypatch.setattr(features, "by_span", None)
    step = features.BuildRollingFeatures("t", kind, lookback=0, window_size="2500s", cols=["x"])
    got = {r.s: r[step.made[0]] for r in step.transform(df).collect()}
    there = np.arange(3000) % 17 > 0
    for s, v in got.items():
        own = x[there & (t > s - 2500) & (t <= s)]
        want = {"var": lambda o=own: o.var(ddof=1) if len(o) > 1 else None, "median": lambda o=own: np.median(o) if len(o) else None, "sum": lambda o=own: o.sum() if len(o) else None}[kind]()
        assert v is None if want is None else v == pytest.approx(want, rel=1e-9, abs=1e-9), s


def test_equal_rows_of_quantile_fits_are_one(spark, monkeypatch):
    """Passes go over different rows, with their weights summed; the fit stays the same."""
    seen, own = [], quantile_lines.fitted
    monkeypatch.setattr(quantile_lines, "fitted", lambda rows, *a: seen.append((rows.count(), rows.agg(F.sum("_s")).first()[0])) or own(rows, *a))
    df = spark.createDataFrame([(float(i % 10), 2.0 * (i % 10) + i % 3) for i in range(600)], "x double, y double")
    fit = models.LinearQuantileRegression("y", ["x"], [0.9]).fit(df)
    assert seen == [(30, 600.0)] and fit.coef_[0.9] == pytest.approx({"x": 2.0, "const": 2.0})
