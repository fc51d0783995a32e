"""Registered queries of the time-series operators over ``events`` and other tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.windows import ordered
from ..operators import cleaning, exploration, features, metrics, models, reshaping, validation
from ..sources import synthetic, weather
from ..functions.tables import temporary
from ..streaming import binning, stateful
from . import plot_data

Query = Callable[[SparkSession, str], DataFrame]
BY, ORDER = ["user_id"], ["ts", "event_id"]
TYPES = ("click", "error", "purchase", "signup", "view")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with times as timestamps (the session's zone is UTC)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a long table: ten IDs, event types as TYPE."""
    e = events(spark, sf_dir)
    return e.select(F.col("ts").alias("TIME"), (F.col("user_id") % 10).alias("ID"), F.col("event_type").alias("TYPE"), F.col("value").alias("VALUE"), "event_id")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, so that sums in another order compare equal: as SQL does, the nearest whole number of units, not the nearest decimal."""
    c = (col(c) if isinstance(c, str) else c).cast("double")
    unit = 10.0**digits
    found = F.round(c * unit, 0) / unit
    return F.when(F.abs(found) < float("inf"), found).otherwise(c)


def registered(sql: str | None = None):
    """Registers a query under its function's name, with SQL."""

    def take(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return take


W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@registered("SELECT event_id, least(value, 100.0) AS value FROM events")
def clean_above_clip(spark, sf):
    """Values above 100 become 100."""
    return cleaning.correct_above_threshold(events(spark, sf), "value", 100.0, "clip").select("event_id", "value")


@registered("SELECT event_id, CASE WHEN value >= 5 THEN value END AS value FROM events")
def clean_below_na(spark, sf):
    """Values below 5 become missing."""
    return cleaning.correct_below_threshold(events(spark, sf), "value", 5, "na").select("event_id", "value")


@registered("SELECT event_id, value FROM events WHERE value BETWEEN 5 AND 100")
def clean_range_remove(spark, sf):
    """Rows outside 5 to 100 go."""
    return cleaning.correct_outside_range(events(spark, sf), "value", (5, 100), "remove").select("event_id", "value")


@registered("SELECT event_id, last_value(CASE WHEN value BETWEEN 5 AND 100 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events")
def clean_range_previous(spark, sf):
    """Values outside 5 to 100 become the user's last good one."""
    return cleaning.correct_outside_range(events(spark, sf), "value", (5, 100), "previous", time_col=ORDER, partition_by=BY).select("event_id", "value")


@registered("""
WITH k AS (SELECT event_id, user_id, ts, CASE WHEN value BETWEEN 5 AND 100 THEN value END AS v, epoch_us(ts)::DOUBLE AS t FROM events),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'t': t, 'x': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(CASE WHEN v IS NOT NULL THEN {'t': t, 'x': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM k)
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN a IS NULL THEN NULL WHEN b IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (t - a.t) / (b.t - a.t) END, 6) AS value FROM n""")
def clean_range_average(spark, sf):
    """Values outside 5 to 100 become linear between good neighbours by time."""
    return cleaning.correct_outside_range(events(spark, sf), "value", (5, 100), "average", time_col=ORDER, partition_by=BY).select("event_id", rounded("value").alias("value"))


@registered("SELECT event_id, greatest(least(value, b.hi), b.lo) AS value FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'purchase') b")
def clip_fitted(spark, sf):
    """Values clipped to the range of one type."""
    e = events(spark, sf)
    return cleaning.ClipTransformer(["value"]).fit(e.where("event_type = 'purchase'")).transform(e).select("event_id", "value")


@registered("SELECT event_id, CASE WHEN value >= b.lo AND value <= b.hi THEN value END AS value FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'purchase') b")
def range_validator(spark, sf):
    """Values outside the range of one type become missing."""
    e = events(spark, sf)
    return validation.OutsideRangeValidator(["value"]).fit(e.where("event_type = 'purchase'")).transform(e).select("event_id", "value")


@registered("""
WITH d AS (SELECT event_id, value, value - quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS d FROM events),
b AS (SELECT quantile_cont(d, 0.5) FILTER (d < 0) * 5 AS lo, quantile_cont(d, 0.5) FILTER (d > 0) * 5 AS hi FROM d)
SELECT event_id, CASE WHEN d < lo OR d > hi THEN NULL ELSE value END AS value FROM d, b""")
def mad_validator(spark, sf):
    """Deviations of more than five median deviations from a rolling median of ten become missing."""
    v = validation.MADValidator(ORDER, 10, ["value"], 5, BY)
    return v.fit_transform(events(spark, sf)).select("event_id", "value")


@registered(f"""
WITH f AS (SELECT event_id, user_id, ts, value, count(*) {W[:-1]} ROWS 2 PRECEDING) = 3 AND max(value) {W[:-1]} ROWS 2 PRECEDING) - min(value) {W[:-1]} ROWS 2 PRECEDING) <= 5 AS flat FROM events)
SELECT event_id, CASE WHEN NOT bool_or(flat) {W[:-1]} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) THEN value END AS value FROM f""")
def flatline_validator(spark, sf):
    """Runs of three values within 5 become missing."""
    v = validation.FlatlineValidator(ORDER, 3, ["value"], margin=5, partition_by=BY)
    return v.fit_transform(events(spark, sf)).select("event_id", "value")


@registered("""
WITH d AS (SELECT event_id, value, value - quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND 43200000000 FOLLOWING) AS d FROM events),
b AS (SELECT quantile_cont(d, 0.5) FILTER (d < 0) * 5 AS lo, quantile_cont(d, 0.5) FILTER (d > 0) * 5 AS hi FROM d)
SELECT event_id, CASE WHEN d < lo OR d > hi THEN NULL ELSE value END AS value FROM d, b""")
def mad_validator_by_day(spark, sf):
    """Deviations of more than five median deviations from the median of the day around become missing."""
    return validation.MADValidator("ts", "1d", ["value"], 5, BY).fit_transform(events(spark, sf)).select("event_id", "value")


_MAD = "value - quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS d"


@registered(f"""
WITH tr AS (SELECT value, {_MAD} FROM events WHERE ts < TIMESTAMP '2024-01-15'),
b AS (SELECT quantile_cont(d, 0.5) FILTER (d < 0) * 5 AS lo, quantile_cont(d, 0.5) FILTER (d > 0) * 5 AS hi FROM tr),
m AS (SELECT avg(value) FILTER (d >= lo AND d <= hi) AS m FROM tr, b),
te AS (SELECT event_id, value, {_MAD} FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT event_id, round(CASE WHEN d < lo OR d > hi THEN m ELSE value END, 6) AS value FROM te, b, m""")
def validation_pipe(spark, sf):
    """A pipe of validator and imputer, fitted on the rows before a time and used on those after it."""
    train, test = cleaning.datetime_train_test_split(events(spark, sf), datetime="2024-01-15", datecol="ts")
    pipe = validation.ValidationPipe([validation.MADValidator(ORDER, 10, ["value"], 5, BY)], validation.Imputer(["value"], "mean"))
    return pipe.fit(train).transform(test).select("event_id", rounded("value").alias("value"))


@registered("""
WITH e AS (SELECT event_id, (user_id % 7)::DOUBLE AS x, CASE WHEN value >= 5 THEN value END AS v FROM events), m AS (SELECT avg(v) AS m FROM e),
r AS (SELECT regr_slope(v, x) AS a, regr_intercept(v, x) AS b FROM e WHERE v IS NOT NULL)
SELECT event_id, round(coalesce(v, a * x + b), 4) AS value FROM e, m, r""")
def impute_by_regression(spark, sf):
    """Missing values become a linear function of another column."""
    e = cleaning.correct_below_threshold(events(spark, sf).withColumn("x", (F.col("user_id") % 7).cast("double")), "value", 5, "na")
    return validation.Imputer(["value", "x"], "iterative").fit_transform(e).select("event_id", rounded("value", 4).alias("value"))


@registered("""
WITH m AS (SELECT event_id, CASE WHEN value >= 5 THEN value END AS v FROM events)
SELECT event_id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM m)) AS value FROM m""")
def impute_median(spark, sf):
    """Missing values become the median."""
    e = cleaning.correct_below_threshold(events(spark, sf), "value", 5, "na")
    return validation.imputed(e, ["value"], "median").select("event_id", "value")


@registered("SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def train_test_split(spark, sf):
    """Rows before and from a time."""
    train, test = cleaning.datetime_train_test_split(events(spark, sf), datetime="2024-01-15", datecol="ts")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))


@registered("SELECT event_id, round((value - m) / s, 6) AS value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-15') WHERE ts >= TIMESTAMP '2024-01-15'")
def scaled_test(spark, sf):
    """Test rows scaled by the training rows."""
    train, test = cleaning.datetime_train_test_split(events(spark, sf), datetime="2024-01-15", datecol="ts")
    return cleaning.scale_train_test(train, test, ["value"])[1].select("event_id", rounded("value").alias("value"))


@registered("""SELECT event_id FROM (SELECT event_id, ts, min(CASE WHEN value >= 20 THEN ts END) OVER (PARTITION BY user_id) AS f FROM events) WHERE ts >= f""")
def from_first_complete(spark, sf):
    """Each user's rows from the first complete one on."""
    e = cleaning.correct_below_threshold(events(spark, sf), "value", 20, "na")
    return cleaning.remove_until_first_value(e, ["value"], "ts", BY).select("event_id")


@registered("""
WITH s AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events)
SELECT user_id, count(*) AS n, count(DISTINCT step) AS steps, min(step) AS least FROM s GROUP BY user_id""")
def time_spacing(spark, sf):
    """Steps between each user's times."""
    return cleaning.spacing(events(spark, sf), "ts", BY)


@registered("SELECT l_orderkey, l_linenumber, l_quantity * 1.0 AS a, greatest(l_quantity, l_tax * 100) * 1.0 AS b, greatest(l_quantity, l_tax * 100, l_discount * 100) * 1.0 AS c FROM lineitem")
def monotone_columns(spark, sf):
    """Running largest value over three columns."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), (F.col("l_tax") * 100).cast("double").alias("b"), (F.col("l_discount") * 100).cast("double").alias("c"))
    return cleaning.make_df_monotonic(li, ["a", "b", "c"])


@registered("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS x, l_discount * 1.0 AS y FROM lineitem")
def grouped_column_sums(spark, sf):
    """Sums of columns by name prefix."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x#1"), F.col("l_tax").cast("double").alias("x#2"), F.col("l_discount").cast("double").alias("y"))
    return cleaning.sum_grouped_columns(li, ["x#1", "x#2", "y"], keep=("l_orderkey", "l_linenumber"))


GRID = """
WITH r AS (SELECT CAST(ceil(epoch_us(ts) / 21600000000.0) AS BIGINT) * 21600000000 AS bin, user_id % 10 AS id, event_type AS type, value, ts, event_id FROM events),
g AS (SELECT bin, id, type FROM (SELECT unnest(generate_series(min(bin), max(bin), 21600000000)) AS bin FROM r), (SELECT DISTINCT id FROM r), (SELECT DISTINCT type FROM r)),
v AS (SELECT bin, id, type, {agg} AS value FROM r GROUP BY bin, id, type)
"""


@registered(GRID.format(agg="round(avg(value), 6)") + "SELECT make_timestamp(g.bin) AS time, g.id AS id, g.type AS type, v.value AS value FROM g LEFT JOIN v ON v.bin = g.bin AND v.id = g.id AND v.type = g.type")
def normalize_mean(spark, sf):
    """Series on a six-hour grid, means."""
    n = reshaping.normalize_timestamps(long_events(spark, sf), "6h", aggregate_method="mean")
    return n.select(F.col("TIME").cast("timestamp_ntz").alias("time"), F.col("ID").alias("id"), F.col("TYPE").alias("type"), rounded("VALUE").alias("value"))


@registered(GRID.format(agg="arg_max(value, {'a': ts, 'b': event_id})") + """
SELECT make_timestamp(g.bin) AS time, g.id AS id, g.type AS type, last_value(v.value IGNORE NULLS) OVER (PARTITION BY g.id, g.type ORDER BY g.bin ROWS UNBOUNDED PRECEDING) AS value
FROM g LEFT JOIN v ON v.bin = g.bin AND v.id = g.id AND v.type = g.type""")
def normalize_last_ffill(spark, sf):
    """Series on a six-hour grid, last values, filled forward."""
    n = reshaping.normalize_timestamps(long_events(spark, sf), "6h", fillna_method="ffill", order=["event_id"])
    return n.select(F.col("TIME").cast("timestamp_ntz").alias("time"), F.col("ID").alias("id"), F.col("TYPE").alias("type"), F.col("VALUE").alias("value"))


@registered("SELECT date_trunc('hour', ts)::TIMESTAMP AS time, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def wide_table(spark, sf):
    """Hourly sums by type as columns."""
    long = events(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("TIME"), F.lit("a").alias("ID"), F.col("event_type").alias("TYPE")).agg(rounded(F.sum("value"), 4).alias("VALUE"))
    w = reshaping.long_to_wide(long, "_", [f"a_{t}" for t in TYPES])
    return w.select(F.col("TIME").cast("timestamp_ntz").alias("time"), *[F.col(f"a_{t}").alias(t) for t in TYPES])


@registered("SELECT event_id, id, type, value FROM (SELECT event_id, 'a' AS id, 'x' AS type, value AS value FROM events UNION ALL SELECT event_id, 'all', 'y', user_id::DOUBLE FROM events)")
def long_table(spark, sf):
    """Columns as series."""
    e = events(spark, sf).select("event_id", F.col("value").alias("a_x"), F.col("user_id").cast("double").alias("y"))
    return reshaping.wide_to_long(e, "_", "all", "event_id").select(F.col("TIME").alias("event_id"), F.col("ID").alias("id"), F.col("TYPE").alias("type"), F.col("VALUE").alias("value"))


@registered("""
WITH r AS (SELECT user_id, epoch_us(ts) // 43200000000 * 43200000000 AS bin, value FROM events),
g AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), 43200000000)) AS bin FROM r GROUP BY user_id), v AS (SELECT user_id, bin, avg(value) AS value FROM r GROUP BY ALL)
SELECT g.user_id, make_timestamp(g.bin) AS time, round(v.value, 6) AS value FROM g LEFT JOIN v ON v.user_id = g.user_id AND v.bin = g.bin""")
def resampled_mean(spark, sf):
    """Means by half days of all users, empty ones missing."""
    r = reshaping.resampled(events(spark, sf), "12h", ["value"], "ts", "mean", BY)
    return r.select("user_id", F.col("ts").cast("timestamp_ntz").alias("time"), rounded("value").alias("value"))


@registered("""
WITH r AS (SELECT user_id, epoch_us(ts) // 86400000000 * 86400000000 AS bin, value, ts FROM events),
g AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), 86400000000)) AS bin FROM r GROUP BY user_id), v AS (SELECT user_id, bin, arg_max(value, ts) AS value FROM r GROUP BY ALL),
f AS (SELECT g.user_id, g.bin, last_value(v.value IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.bin ROWS 2 PRECEDING) AS value FROM g LEFT JOIN v ON v.user_id = g.user_id AND v.bin = g.bin)
SELECT user_id, make_timestamp(bin) AS time, value FROM f WHERE value IS NOT NULL""")
def padded_values(spark, sf):
    """As-of values of all users on a daily grid, carried over two bins at most."""
    r = reshaping.padded(events(spark, sf), "1d", ["value"], "ts", 2, BY)
    return r.select("user_id", F.col("ts").cast("timestamp_ntz").alias("time"), "value")


@registered("""
WITH r AS (SELECT user_id, epoch_us(ts) // 86400000000 * 86400000000 AS bin, value FROM events),
g AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), 86400000000)) AS bin FROM r GROUP BY user_id), v AS (SELECT user_id, bin, avg(value) AS value FROM r GROUP BY ALL)
SELECT g.user_id, make_timestamp(g.bin) AS time, round(v.value, 6) AS value FROM g LEFT JOIN v ON v.user_id = g.user_id AND v.bin = g.bin""")
def resampled_mean_all(spark, sf):
    """Daily means of all users, empty days missing."""
    r = reshaping.resampled(events(spark, sf), "1d", ["value"], "ts", "mean", BY)
    return r.select("user_id", F.col("ts").cast("timestamp_ntz").alias("time"), rounded("value").alias("value"))


@registered("""
WITH r AS (SELECT user_id, epoch_us(ts) // 21600000000 * 21600000000 AS bin, value, ts FROM events),
g AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), 21600000000)) AS bin FROM r GROUP BY user_id), v AS (SELECT user_id, bin, arg_max(value, ts) AS value FROM r GROUP BY ALL),
f AS (SELECT g.user_id, g.bin, last_value(v.value IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.bin ROWS 2 PRECEDING) AS value FROM g LEFT JOIN v ON v.user_id = g.user_id AND v.bin = g.bin)
SELECT user_id, make_timestamp(bin) AS time, value FROM f WHERE value IS NOT NULL""")
def padded_values_all(spark, sf):
    """As-of values of all users on a six-hour grid, carried over two bins at most."""
    r = reshaping.padded(events(spark, sf), "6h", ["value"], "ts", 2, BY)
    return r.select("user_id", F.col("ts").cast("timestamp_ntz").alias("time"), "value")


@registered("SELECT time_bucket(INTERVAL '1 day', ts) AS time, " + ", ".join(f"round(sum(value) FILTER (event_type = '{k}'), 4) AS {k}" for k in TYPES) + " FROM events GROUP BY 1")
def wide_table_all(spark, sf):
    """Daily sums by type as columns, all types."""
    long = events(spark, sf).groupBy(F.date_trunc("day", "ts").alias("TIME"), F.lit("a").alias("ID"), F.col("event_type").alias("TYPE")).agg(rounded(F.sum("value"), 4).alias("VALUE"))
    w = reshaping.long_to_wide(long, "_", [f"a_{k}" for k in TYPES])
    return w.select(F.col("TIME").cast("timestamp_ntz").alias("time"), *[F.col(f"a_{k}").alias(k) for k in TYPES])


@registered("SELECT event_id, greatest(least(value, b.hi), b.lo) AS value FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-15') b")
def clip_fitted_by_time(spark, sf):
    """Values clipped to the range of the rows before a time."""
    e = events(spark, sf)
    train, _ = cleaning.datetime_train_test_split(e, datetime="2024-01-15", datecol="ts")
    return cleaning.ClipTransformer(["value"]).fit(train).transform(e).select("event_id", "value")


@registered("SELECT event_id, CASE WHEN value >= b.lo AND value <= b.hi THEN value END AS value FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-15') b")
def range_validator_by_time(spark, sf):
    """Values outside the range of the rows before a time become missing."""
    e = events(spark, sf)
    train, _ = cleaning.datetime_train_test_split(e, datetime="2024-01-15", datecol="ts")
    return validation.OutsideRangeValidator(["value"]).fit(train).transform(e).select("event_id", "value")


@registered("SELECT event_id, CASE WHEN day(t) >= 25 AND isodow(t) = 7 AND hour(t) = 2 AND month(t) = 3 THEN 'to_summertime' WHEN day(t) >= 25 AND isodow(t) = 7 AND hour(t) = 2 AND month(t) = 10 THEN 'to_wintertime' ELSE 'normal' END AS dst FROM (SELECT event_id, ts + INTERVAL 90 DAY * (event_id % 5) AS t FROM events)")
def clock_changes(spark, sf):
    """Hours of clock changes, on times spread over the year."""
    e = events(spark, sf).withColumn("t", F.expr("ts + make_dt_interval(90 * cast(event_id % 5 AS int))"))
    return reshaping.label_dst(e, "t").select("event_id", "dst")


@registered("""
WITH e AS (SELECT user_id % 10 AS id, ts + INTERVAL 90 DAY * (event_id % 5) AS t, value FROM events), d AS (SELECT *, day(t) >= 25 AND isodow(t) = 7 AND hour(t) = 2 AND month(t) = 10 AS twice FROM e)
SELECT id, t, round(value, 6) AS value FROM d WHERE NOT twice UNION ALL SELECT id, t, round(avg(value), 6) FROM d WHERE twice GROUP BY id, t""")
def winter_time_means(spark, sf):
    """Rows that repeat in the hour that the clock repeats become one, on times spread over the year."""
    e = events(spark, sf).select((F.col("user_id") % 10).alias("id"), F.expr("ts + make_dt_interval(90 * cast(event_id % 5 AS int))").alias("t"), "value")
    return reshaping.average_winter_time(e, ["id", "t"], "value", "t").select("id", F.col("t").cast("timestamp_ntz").alias("t"), rounded("value").alias("value"))


@registered("SELECT name, holes FROM (VALUES ('all', (SELECT count(*) FROM events WHERE value IS NULL) > 0), ('cut', (SELECT count(*) FROM events WHERE value < 5 OR value IS NULL) > 0)) t(name, holes)")
def holes(spark, sf):
    """Whether anything is missing, before and after small values are taken out."""
    e = events(spark, sf).select("event_id", "value")
    found = [("all", cleaning.contains_nans(e)), ("cut", cleaning.contains_nans(cleaning.correct_below_threshold(e, "value", 5, "na")))]
    return spark.createDataFrame(found, "name string, holes boolean")


@registered(f"SELECT event_id, lead(value, 1) {W} AS lead_1, lead(value, 3) {W} AS lead_3, round(lead(value, 2) {W} - value, 6) AS diff_2 FROM events")
def shifted_targets(spark, sf):
    """Later values and differences."""
    e = reshaping.make_shifted_target(events(spark, sf), "value", [1, 3], ORDER, partition_by=BY)
    e = reshaping.make_differenced_target(e, "value", [2], ORDER, partition_by=BY)
    return e.select("event_id", F.col("value_lead_1").alias("lead_1"), F.col("value_lead_3").alias("lead_3"), rounded("value_diff_2").alias("diff_2"))


@registered("SELECT event_id, round(value + 1, 6) AS restored FROM events")
def undone_differences(spark, sf):
    """Predicted differences plus the current value."""
    e = events(spark, sf)
    p = e.select("event_id", F.lit(1.0).alias("restored"))
    return reshaping.inverse_differenced_target(p, e, ["event_id"], ["restored"], "value").select("event_id", rounded("restored").alias("restored"))


@registered(f"SELECT event_id, lag(value, 3) {W} AS a, lag(value, 2) {W} AS b, lag(value, 1) {W} AS c FROM events QUALIFY row_number() {W} > 3")
def recurrent_windows(spark, sf):
    """Windows of three earlier rows."""
    r = reshaping.recurrent(events(spark, sf), ["value"], 3, ORDER, 1, True, BY)
    return r.select("event_id", *[F.col("window")[i][0].alias(n) for i, n in enumerate("abc")])


def _rolling(kind: str, n: int | str, **options) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        step = features.BuildRollingFeatures("ts" if isinstance(n, str) else ORDER, kind, window_size=n, cols=["value"], partition_by=BY, **options)
        out = step.transform(events(spark, sf))
        return out.select("event_id", *[rounded(m).alias(f"r{i}" if len(step.made) > 1 else "r") for i, m in enumerate(step.made)])

    return run


def _full(x: str, n: int) -> str:
    frame = f"{W[:-1]} ROWS {n - 1} PRECEDING)"
    return f"SELECT event_id, round(lag(r, 1) {W}, 6) AS r FROM (SELECT event_id, user_id, ts, value, CASE WHEN count(value) {frame} = {n} THEN {x.format(w=frame)} END AS r FROM events)"


for _name, _x in {
    "sum": "sum(value) {w}", "mean": "avg(value) {w}", "min": "min(value) {w}", "max": "max(value) {w}", "var": "var_samp(value) {w}", "std": "stddev_samp(value) {w}",
    "median": "quantile_cont(value, 0.5) {w}", "numpos": "count(*) FILTER (value > 0) {w}",
}.items():
    _queries[f"rolling_{_name}"] = _rolling(_name, 5)
    _sql[f"rolling_{_name}"] = _full(_x, 5)
_queries["rolling_lag"] = _rolling("lag", 2)
_sql["rolling_lag"] = f"SELECT event_id, lag(value, 3) {W} AS r FROM events"
_queries["rolling_diff"] = _rolling("diff", 2)
_sql["rolling_diff"] = f"SELECT event_id, round(lag(r, 1) {W}, 6) AS r FROM (SELECT event_id, user_id, ts, value - lag(value, 2) {W} AS r FROM events)"
LISTS = f"WITH l AS (SELECT event_id, user_id, ts, list(value) {W[:-1]} ROWS 4 PRECEDING) AS v FROM events)"
_queries["rolling_skew"] = _rolling("skew", 5)
_sql["rolling_skew"] = LISTS + f" SELECT event_id, round(lag(r, 1) {W}, 6) AS r FROM (SELECT event_id, user_id, ts, CASE WHEN len(v) = 5 THEN list_skewness(v) END AS r FROM l)"
_queries["rolling_kurt"] = _rolling("kurt", 5)
_sql["rolling_kurt"] = LISTS + f" SELECT event_id, round(lag(r, 1) {W}, 6) AS r FROM (SELECT event_id, user_id, ts, CASE WHEN len(v) = 5 THEN list_kurtosis(v) END AS r FROM l)"
_queries["rolling_trimmean"] = _rolling("trimmean", 5, proportiontocut=0.2)
_sql["rolling_trimmean"] = LISTS + f" SELECT event_id, round(lag(r, 1) {W}, 6) AS r FROM (SELECT event_id, user_id, ts, CASE WHEN len(v) = 5 THEN list_avg(list_sort(v)[2:4]) END AS r FROM l)"
SPAN = "OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)"
for _name, _x in {"sum": "sum(value)", "mean": "avg(value)", "max": "max(value)", "std": "stddev_samp(value)"}.items():
    _queries[f"rolling_day_{_name}"] = _rolling(_name, "1d", lookback=0)
    _sql[f"rolling_day_{_name}"] = f"SELECT event_id, round({_x} {SPAN}, 6) AS r FROM events"
_queries["rolling_deviation"] = _rolling("mean", 3, deviation="subtract")
_sql["rolling_deviation"] = f"SELECT event_id, round(value - lag(r, 1) {W}, 6) AS r FROM ({_full('avg(value) {w}', 3).split('FROM (', 1)[1]}"
_queries["rolling_ratio"] = _rolling("lag", 1, lookback=0, deviation="divide", undefined=float("nan"))
_sql["rolling_ratio"] = f"SELECT event_id, round(value / lag(value, 1) {W}, 6) AS r FROM events"
_queries["rolling_ewm"] = _rolling("ewm", 1, lookback=0, alpha=0.4)
_sql["rolling_ewm"] = """
WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, value AS s, 1.0::DOUBLE AS w FROM o WHERE n = 1
  UNION ALL SELECT o.event_id, o.user_id, o.n, o.value + 0.6 * r.s, 1 + 0.6 * r.w FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, round(s / w, 6) AS r FROM r"""
_queries["rolling_fourier"] = _rolling("fourier", 4)
_frame = f"{W[:-1]} ROWS 3 PRECEDING)"
_sql["rolling_fourier"] = f"""
WITH l AS (SELECT event_id, user_id, ts, list(value) {_frame} AS v FROM events)
SELECT event_id, round(lag(a, 1) {W}, 6) AS r0, round(lag(b, 1) {W}, 6) AS r1 FROM (SELECT event_id, user_id, ts, CASE WHEN len(v) = 4 THEN sqrt((v[1] - v[3]) ** 2 + (v[2] - v[4]) ** 2) END AS a, CASE WHEN len(v) = 4 THEN abs(v[1] - v[2] + v[3] - v[4]) END AS b FROM l)"""
_queries["rolling_wavelet"] = _rolling("cwt", 6, width=2)
_waves = [" + ".join(f"v[{j + 1}] * {w!r}::DOUBLE" for j, w in enumerate(row)) for row in np.array([features.ricker(e, 2) for e in np.eye(6)]).T.tolist()]
_sql["rolling_wavelet"] = f"""
WITH l AS (SELECT event_id, user_id, ts, list(value) {W[:-1]} ROWS 5 PRECEDING) AS v FROM events)
SELECT event_id, {", ".join(f"round(lag(c{i}, 1) {W}, 6) AS r{i}" for i in range(6))} FROM (SELECT event_id, user_id, ts, {", ".join(f"CASE WHEN len(v) = 6 THEN {x} END AS c{i}" for i, x in enumerate(_waves))} FROM l)"""
_queries["rolling_uneven_fourier"] = _rolling("nfft", "3d", nfft_ncol=5)
_turn = "OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW)"
_side = lambda f, k: f"(sum(value * {f}({k} * t)) {_turn} - (count(*) {_turn} % 2) * first_value(value * {f}({k} * t)) {_turn}) ** 2"
_sql["rolling_uneven_fourier"] = f"""
WITH e AS (SELECT *, 2 * pi() * (epoch_us(ts) % 259200000000) / 259200000000 AS t FROM events), s AS (SELECT event_id, user_id, ts,
  {", ".join(f"CASE WHEN count(*) {_turn} // 2 > 2 AND {k} < count(*) {_turn} // 2 THEN sqrt({_side('cos', k)} + {_side('sin', k)}) ELSE 0 END AS f{k}" for k in range(1, 6))} FROM e)
SELECT event_id, {", ".join(f"round(lag(f{k}) {W}, 6) AS r{k - 1}" for k in range(1, 6))} FROM s"""


@registered(f"SELECT event_id, coalesce(max(value) {W[:-1]} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS ahead, CASE WHEN row_number() {W} <= 3 THEN max(value) {W[:-1]} ROWS 2 PRECEDING) ELSE coalesce(max(value) {W[:-1]} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) END AS back FROM events")
def range_lags(spark, sf):
    """Largest values of row ranges ahead and back."""
    e = features.range_lag_column(events(spark, sf), "value", (1, 3), ORDER, BY, "ahead")
    return features.range_lag_column(e, "value", (-3, -1), ORDER, BY, "back").select("event_id", "ahead", "back")


@registered("SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, (isodow(ts) - 1)::INT AS dayofweek, week(ts)::INT AS week, dayofyear(ts)::INT AS dayofyear, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS secondofday, quarter(ts)::INT AS quarter FROM events")
def datetime_parts(spark, sf):
    """Calendar parts."""
    parts = ["year", "month", "day", "dayofweek", "week", "dayofyear", "secondofday", "quarter"]
    d = features.decompose_datetime(events(spark, sf), "ts", parts)
    return d.select("event_id", *[F.col(f"ts_{p}").cast("int").alias(p) for p in parts])


@registered("SELECT event_id, (epoch_us(ts) % 1000000)::INT AS microsecond, day(last_day(ts))::INT AS days_in_month, day(ts) = 1 AS is_month_start, ts::DATE = last_day(ts) AS is_month_end, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second FROM events")
def more_datetime_parts(spark, sf):
    """More calendar parts."""
    parts = ["microsecond", "days_in_month", "is_month_start", "is_month_end", "hour", "minute", "second"]
    d = features.decompose_datetime(events(spark, sf), "ts", parts)
    return d.select("event_id", *[F.col(f"ts_{p}").cast("boolean" if p.startswith("is_") else "int").alias(p) for p in parts])


@registered("SELECT event_id, hour(timezone('Europe/Amsterdam', timezone('UTC', ts)))::INT AS hour FROM events")
def local_hours(spark, sf):
    """Hours of the day in another zone."""
    return features.decompose_datetime(events(spark, sf), "ts", ["hour"], timezone="Europe/Amsterdam").select("event_id", F.col("ts_hour").cast("int").alias("hour"))


@registered("SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, (isodow(ts) = 1)::INT AS monday, (isodow(ts) = 7)::INT AS sunday FROM events")
def cyclical_and_onehot(spark, sf):
    """Hours in a circle, days of the week as flags."""
    d = features.decompose_datetime(events(spark, sf), "ts", cyclicals=["hour"], onehots=["dayofweek"])
    return d.select("event_id", rounded("ts_hour_sin").alias("hour_sin"), rounded("ts_hour_cos").alias("hour_cos"), F.col("ts_dayofweek_0").alias("monday"), F.col("ts_dayofweek_6").alias("sunday"))


@registered(f"""SELECT ts AS time, user_id, CASE WHEN count(*) {W[:-1].replace(", event_id", "")} ROWS 2 PRECEDING) = 3 THEN round(avg(value) {W[:-1].replace(", event_id", "")} ROWS 2 PRECEDING), 6) END AS mean_3, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts) AS lag_2,
(isodow(ts) = 2)::INT AS tuesday, round(sin(2 * pi() * ((isodow(ts) - 1) * 24 + hour(ts)) / 168), 6) AS week_sin FROM events""")
def simple_features(spark, sf):
    """Rolling features without a shift, and time features."""
    s = features.SimpleFeatureEngineer("ts", [("value", "mean", 3), ("value", "lag", 2)], [("day_of_week", "onehot"), ("hour_of_week", "cyclical")], partition_by=BY)
    return s.transform(events(spark, sf)).select(F.col("ts").cast("timestamp_ntz").alias("time"), "user_id", rounded("value_mean_3").alias("mean_3"), F.col("value_lag_2").alias("lag_2"), F.col("day_of_week_2").alias("tuesday"), rounded("hour_of_week_sin").alias("week_sin"))


DAILY = "SELECT TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * i AS ts, ((i * 7919) % 211)::DOUBLE AS rh, ((i * 104729) % 97)::DOUBLE AS ev FROM (SELECT unnest(generate_series(0, 3999)) AS i)"


def _daily(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(4000).select(F.expr("timestamp '2000-01-01' + make_dt_interval(cast(id AS int))").alias("TIME"), ((i * 7919) % 211).cast("double").alias("RH"), ((i * 104729) % 97).cast("double").alias("EV24"))


@registered(f"""
WITH d AS ({DAILY}), r AS (SELECT ts, avg(rh - ev) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW) AS x FROM d),
c AS (SELECT month(ts) AS m, day(ts) AS k, CASE WHEN count(x) >= 5 THEN avg(x) END AS mean, CASE WHEN count(x) >= 5 THEN stddev_samp(x) END AS std FROM r GROUP BY 1, 2),
s AS (SELECT m, k, quantile_cont(mean, 0.5) OVER (ORDER BY m, k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mean, quantile_cont(std, 0.5) OVER (ORDER BY m, k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS std FROM c)
SELECT ts AS time, round((x - mean) / std, 6) AS spei FROM r LEFT JOIN s ON s.m = month(ts) AND s.k = day(ts)""")
def drought_index(spark, sf):
    """A standardised index of made-up daily weather."""
    d = _daily(spark)
    return features.SPEITransformer(min_years=10).configure(d).transform(d).select(F.col("TIME").cast("timestamp_ntz").alias("time"), rounded("SPEI_30D").alias("spei"))


@registered("""
WITH d AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts + INTERVAL 1 YEAR * (event_id % 6)) AS day, sum(value) AS rh, count(*)::DOUBLE AS ev FROM events GROUP BY ALL),
r AS (SELECT event_type, day, avg(rh - ev) OVER (PARTITION BY event_type ORDER BY epoch_us(day) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS x FROM d),
c AS (SELECT event_type, month(day) AS m, day(day) AS k, CASE WHEN count(x) >= 3 THEN avg(x) END AS mean, CASE WHEN count(x) >= 3 THEN stddev_samp(x) END AS std FROM r GROUP BY ALL),
s AS (SELECT event_type, m, k, quantile_cont(mean, 0.5) OVER w AS mean, quantile_cont(std, 0.5) OVER w AS std FROM c WINDOW w AS (PARTITION BY event_type ORDER BY m, k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT r.event_type, r.day AS time, round((r.x - s.mean) / s.std, 6) AS spei FROM r LEFT JOIN s ON s.event_type = r.event_type AND s.m = month(r.day) AND s.k = day(r.day)""")
def drought_index_by_type(spark, sf):
    """Standardised indices of daily sums by type, each type with its own climate, over events dealt over six years."""
    day = F.date_trunc("day", F.expr("ts + make_ym_interval(cast(event_id % 6 AS int), 0)"))
    d = events(spark, sf).groupBy("event_type", day.alias("TIME")).agg(F.sum("value").alias("RH"), F.count("*").cast("double").alias("EV24"))
    index = features.SPEITransformer(window="7D", min_years=6, partition_by=["event_type"])
    return index.configure(d).transform(d).select("event_type", F.col("TIME").cast("timestamp_ntz").alias("time"), rounded("SPEI_7D").alias("spei"))


@registered("""
WITH e AS (SELECT *, abs(value - lag(value, 2) OVER w) AS n1, abs(user_id - lag(user_id, 2) OVER w) AS n2 FROM events WINDOW w AS (ORDER BY ts, event_id))
SELECT round((avg(abs(value - 40)) + 3 * avg(abs(user_id - 60))) / (avg(n1) + 3 * avg(n2)), 6) AS mase FROM e""")
def scaled_errors(spark, sf):
    """The scaled error of two targets with weights, the whole table as one series."""
    e = events(spark, sf).withColumns({"a": F.lit(40.0), "b": F.lit(60.0), "u": F.col("user_id").cast("double")})
    return metrics.mean_absolute_scaled_errors(e, {"value": "a", "u": "b"}, 2, ORDER, [1, 3]).select(rounded("mase").alias("mase"))


@registered("""
WITH e AS (SELECT user_id, event_id, ts, value, coalesce(value >= 80 OR value <= 10, false)::INT AS f FROM events)
SELECT event_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) >= 2 AS outlier, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING), 6) AS median FROM e""")
def plotted_outliers(spark, sf):
    """By user: two of three values outside an interval, and centred medians of 41 values."""
    e = events(spark, sf).withColumns({"predict_lead_0_q_0.1": F.lit(10.0), "predict_lead_0_q_0.9": F.lit(80.0), "predict_lead_0_mean": F.lit(40.0), "at": F.struct("ts", "event_id"), "bad": F.lit(False)})
    a = plot_data.quantile_plot(e, "value", "at", 0, [0.1, 0.9], outlier_min_q=1, outlier_window=3, outlier_limit=2, partition_by=BY).select("at", "outlier")
    return a.join(plot_data.removal_points(e, "value", "bad", "at", 41, BY).select("at", "median"), "at").select("at.event_id", "outlier", rounded("median").alias("median"))


def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.select("event_id", "ts", "user_id", F.col("value").alias("ACTUAL"), F.lit(40.0).alias("PREDICT"), F.lit(10.0).alias("PREDICT_LOW"), F.lit(80.0).alias("PREDICT_HIGH"))


CURVES = f"""
WITH a AS (SELECT event_id, user_id, ts, value, value > 80 OR value < 10 AS o, greatest(value - 80, 10 - value, 0) AS d FROM events),
b AS (SELECT *, sum(c) {W[:-1]} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(o) {W} = o THEN 0 ELSE 1 END AS c FROM a)),
g AS (SELECT *, o OR (count(*) OVER (PARTITION BY user_id, run) <= 1 AND run <> min(run) OVER (PARTITION BY user_id) AND run <> max(run) OVER (PARTITION BY user_id)) AS i FROM b),
k AS (SELECT *, sum(c2) {W[:-1]} ROWS UNBOUNDED PRECEDING) AS run2, sum(s) {W[:-1]} ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT *, CASE WHEN lag(i) {W} = i THEN 0 ELSE 1 END AS c2, CASE WHEN i AND NOT coalesce(lag(i) {W}, false) THEN 1 ELSE 0 END AS s FROM g)),
x AS (SELECT event_id, user_id, ts, value, CASE WHEN i AND count(*) OVER (PARTITION BY user_id, run2) >= 2 AND sum(d) OVER (PARTITION BY user_id, run2) >= 10 THEN no ELSE 0 END::BIGINT AS curve FROM k)
"""


@registered(CURVES + "SELECT event_id, curve FROM x")
def incident_numbers(spark, sf):
    """Incidents of each user: gaps of one row are bridged, two rows and a distance of 10 at least."""
    c = exploration.incident_curves(_forecast(spark, sf), ORDER, max_gap=1, min_duration=2, min_dist_total=10, partition_by=BY)
    return c.select("event_id", F.col("OUTLIER_CURVE").alias("curve"))


@registered(CURVES + "SELECT user_id, curve, count(*) AS duration, round(sum(greatest(value - 80, 10 - value, 0)), 6) AS dist_sum, round(max(greatest(value - 80, 10 - value, 0) / 36), 6) AS score_max, min(ts) AS start_time FROM x WHERE curve > 0 GROUP BY user_id, curve")
def incident_summary(spark, sf):
    """One row for each incident."""
    c = exploration.incident_curves_information(_forecast(spark, sf), ORDER, partition_by=BY, max_gap=1, min_duration=2, min_dist_total=10)
    return c.select("user_id", F.col("OUTLIER_CURVE").alias("curve"), F.col("OUTLIER_DURATION").alias("duration"), rounded("OUTLIER_DIST_SUM").alias("dist_sum"), rounded("OUTLIER_SCORE_MAX").alias("score_max"), F.col("OUTLIER_START_TIME").cast("timestamp_ntz").alias("start_time"))


# The whole table as one series, without a key: nothing runs in one task.
ALL = "OVER (ORDER BY ts, event_id)"


def _long_series(kind: str, n: int | str, **options) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        step = features.BuildRollingFeatures(ORDER, kind, lookback=0, window_size=n, cols=["value"], **options)
        return step.transform(events(spark, sf)).select("event_id", rounded(step.made[0], 3 if kind == "var" else 6).alias("r"))

    return run


for _name, _kind, _n, _x in (
    ("mean_1000", "mean", 1000, "avg(value) {w}"), ("std_200", "std", 200, "stddev_samp(value) {w}"), ("median_500", "median", 500, "quantile_cont(value, 0.5) {w}"), ("min_7", "min", 7, "min(value) {w}"),
):
    _frame = f"{ALL[:-1]} ROWS {_n - 1} PRECEDING)"
    _queries[f"series_{_name}"] = _long_series(_kind, _n)
    _sql[f"series_{_name}"] = f"SELECT event_id, CASE WHEN count(value) {_frame} = {_n} THEN round({_x.format(w=_frame)}, 6) END AS r FROM events"
for _name, _kind, _n, _us, _x in (
    ("day_median", "median", "1d", 86400000000, "quantile_cont(value, 0.5)"), ("week_var", "var", "7d", 7 * 86400000000, "var_samp(value)"), ("month_sum", "sum", "30d", 30 * 86400000000, "sum(value)"), ("hour_max", "max", "1h", 3600000000, "max(value)"),
):
    _queries[f"series_{_name}"] = _long_series(_kind, _n)
    _sql[f"series_{_name}"] = f"SELECT event_id, round({_x} OVER (ORDER BY epoch_us(ts) RANGE BETWEEN {_us - 1} PRECEDING AND CURRENT ROW), {3 if _kind == 'var' else 6}) AS r FROM events"
_queries["series_trimmed"] = _long_series("trimmean", 60, proportiontocut=0.1)
_sql["series_trimmed"] = f"WITH l AS (SELECT event_id, list(value) {ALL[:-1]} ROWS 59 PRECEDING) AS v FROM events) SELECT event_id, CASE WHEN len(v) = 60 THEN round(list_avg(list_sort(v)[7:54]), 6) END AS r FROM l"


@registered(f"SELECT event_id, round(value - lag(value, 3) {ALL}, 6) AS diff, lead(value, 50) {ALL} AS ahead FROM events")
def series_shifts(spark, sf):
    """Differences to older rows and later values of the whole table."""
    e = features.BuildRollingFeatures(ORDER, "diff", lookback=0, window_size=3, cols=["value"]).transform(events(spark, sf))
    e = reshaping.make_shifted_target(e, "value", [50], ORDER)
    return e.select("event_id", rounded("value#diff_3").alias("diff"), F.col("value_lead_50").alias("ahead"))


@registered(f"""
WITH k AS (SELECT event_id, ts, CASE WHEN value BETWEEN 15 AND 60 THEN value END AS v, epoch_us(ts)::DOUBLE AS t FROM events),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {{'t': t, 'x': v}} END IGNORE NULLS) {ALL[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(CASE WHEN v IS NOT NULL THEN {{'t': t, 'x': v}} END IGNORE NULLS) {ALL[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM k)
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN a IS NULL THEN NULL WHEN b IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (t - a.t) / nullif(b.t - a.t, 0) END, 6) AS value, a.x AS held FROM n""")
def series_filled(spark, sf):
    """Values outside a range, linear between good neighbours by time, and the last good ones."""
    e = events(spark, sf).withColumn("held", F.col("value"))
    e = cleaning.correct_outside_range(e, "held", (15, 60), "previous", time_col=ORDER)
    return cleaning.correct_outside_range(e, "value", (15, 60), "average", time_col=ORDER).select("event_id", rounded("value").alias("value"), "held")


@registered(f"""
WITH f AS (SELECT event_id, ts, value, count(*) {ALL[:-1]} ROWS 3 PRECEDING) = 4 AND max(value) {ALL[:-1]} ROWS 3 PRECEDING) - min(value) {ALL[:-1]} ROWS 3 PRECEDING) <= 9 AS flat FROM events)
SELECT event_id, CASE WHEN NOT bool_or(flat) {ALL[:-1]} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) THEN value END AS value FROM f""")
def series_flat_lines(spark, sf):
    """Runs of four values within 9 of the whole table become missing."""
    return validation.FlatlineValidator(ORDER, 4, ["value"], margin=9).fit_transform(events(spark, sf)).select("event_id", "value")


@registered(f"""
WITH d AS (SELECT event_id, value, value - quantile_cont(value, 0.5) {ALL[:-1]} ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS d FROM events),
b AS (SELECT quantile_cont(d, 0.5) FILTER (d < 0) * 2 AS lo, quantile_cont(d, 0.5) FILTER (d > 0) * 2 AS hi FROM d)
SELECT event_id, CASE WHEN d < lo OR d > hi THEN NULL ELSE value END AS value FROM d, b""")
def series_mad(spark, sf):
    """Deviations of more than two median deviations from a rolling median of 101 become missing."""
    return validation.MADValidator(ORDER, 101, ["value"], 2).fit_transform(events(spark, sf)).select("event_id", "value")


@registered(CURVES.replace("PARTITION BY user_id, run2", "PARTITION BY run2").replace("PARTITION BY user_id, run", "PARTITION BY run").replace("OVER (PARTITION BY user_id)", "OVER ()").replace(W[:-1], ALL[:-1]) + "SELECT event_id, curve FROM x")
def series_incidents(spark, sf):
    """Incidents of the whole table as one series."""
    c = exploration.incident_curves(_forecast(spark, sf), ORDER, max_gap=1, min_duration=2, min_dist_total=10)
    return c.select("event_id", F.col("OUTLIER_CURVE").alias("curve"))


@registered(f"SELECT event_id, coalesce(max(value) {ALL[:-1]} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), 0) AS ahead FROM events")
def series_range_lag(spark, sf):
    """Largest values of the twenty rows ahead, without a key."""
    return features.range_lag_column(events(spark, sf), "value", (1, 20), ORDER, name="ahead").select("event_id", "ahead")


@registered(" UNION ALL ".join(f"SELECT {n} AS lag, round(corr(x, y), 6) AS correlation FROM (SELECT lag(value, {n}) {W} AS x, event_id::DOUBLE AS y FROM events)" for n in range(4)))
def lag_correlations(spark, sf):
    """Correlations of older values with the row's number."""
    c = exploration.lag_correlation(events(spark, sf).withColumn("y", F.col("event_id").cast("double")), "y", ORDER, 4, cols=["value"], partition_by=BY)
    return c.select(F.col("LAG").alias("lag"), rounded("value").alias("correlation"))


@registered("""
WITH p AS (SELECT value AS x, user_id::DOUBLE AS y FROM events), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT 0 AS lag, round(corr(rx, ry), 6) AS correlation FROM r""")
def rank_correlation(spark, sf):
    """Spearman's correlation of value and user."""
    e = events(spark, sf).withColumn("y", F.col("user_id").cast("double"))
    return exploration.lag_correlation(e, "y", ORDER, 1, "spearman", cols=["value"]).select(F.col("LAG").alias("lag"), rounded("value").alias("correlation"))


@registered("""
WITH p AS (SELECT value AS x, user_id AS y, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(a.n * b.n * abs(sign(a.x - b.x))) AS fx, sum(a.n * b.n * abs(sign(a.y - b.y))) AS fy FROM p a, p b)
SELECT 0 AS lag, round(s / sqrt(fx * fy), 6) AS correlation FROM s""")
def kendall_correlation(spark, sf):
    """Kendall's correlation of value and user."""
    e = events(spark, sf).withColumn("y", F.col("user_id").cast("double"))
    return exploration.lag_correlation(e, "y", ORDER, 1, "kendall", cols=["value"]).select(F.col("LAG").alias("lag"), rounded("value").alias("correlation"))


@registered("""
WITH c AS (SELECT round(corr(l_quantity, l_extendedprice), 6) AS a, round(corr(l_discount, l_extendedprice), 6) AS b, round(corr(l_tax, l_extendedprice), 6) AS c FROM lineitem)
SELECT name, correlation FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS name, unnest([a, b, c]) AS correlation FROM c) QUALIFY row_number() OVER (ORDER BY abs(correlation) DESC, name) <= 2""")
def top_correlations_of_all(spark, sf):
    """The two columns that go best with the price, whatever their group."""
    t = exploration.top_n_correlations(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice", 2, False, cols=["l_quantity", "l_discount", "l_tax"])
    return t.select(F.col("NAME").alias("name"), rounded("CORR").alias("correlation"))


@registered("""
WITH c AS (SELECT round(corr(l_quantity, l_extendedprice), 6) AS a, round(corr(l_discount, l_extendedprice), 6) AS b, round(corr(l_tax, l_extendedprice), 6) AS c FROM lineitem),
l AS (SELECT 'l' AS grp, unnest(['l#quantity', 'l#discount', 'l#tax']) AS name, unnest([a, b, c]) AS correlation FROM c)
SELECT grp, name, correlation FROM l QUALIFY row_number() OVER (ORDER BY abs(correlation) DESC, name) <= 2""")
def top_correlations(spark, sf):
    """The two columns that go best with the price."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("l#quantity"), F.col("l_discount").cast("double").alias("l#discount"), F.col("l_tax").cast("double").alias("l#tax"), F.col("l_extendedprice").cast("double").alias("price"))
    return exploration.top_n_correlations(li, "price", 2).select(F.col("GROUP").alias("grp"), F.col("NAME").alias("name"), rounded("CORR").alias("correlation"))


@registered("SELECT name, correlation FROM (SELECT unnest(['l#quantity', 'l#discount']) AS name, unnest([a, b]) AS correlation FROM (SELECT round(corr(l_quantity, l_extendedprice), 6) AS a, round(corr(l_discount, l_extendedprice), 6) AS b FROM lineitem)) WHERE abs(correlation) >= 0.002")
def strong_correlations(spark, sf):
    """Columns whose correlation with the price reaches 0.002."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("l#quantity"), F.col("l_discount").cast("double").alias("l#discount"), F.col("l_extendedprice").cast("double").alias("price"))
    return exploration.top_score_correlations(li, "price", 0.002).select(F.col("NAME").alias("name"), rounded("CORR").alias("correlation"))


@registered("SELECT user_id, round(avg(greatest(0.9 * (value - 40), -0.1 * (value - 40))), 6) AS tilted_loss FROM events GROUP BY user_id")
def quantile_loss(spark, sf):
    """Mean quantile loss by user."""
    return metrics.tilted_loss(_forecast(spark, sf), "ACTUAL", "PREDICT", 0.9, BY).select("user_id", rounded("tilted_loss").alias("tilted_loss"))


@registered("SELECT user_id, round(avg(abs(value - 40)) + avg(greatest(0.1 * (value - 10), -0.9 * (value - 10))) + avg(greatest(0.9 * (value - 80), -0.1 * (value - 80))), 6) AS mae, round(avg((value - 40) ** 2) + avg(greatest(0.1 * (value - 10), -0.9 * (value - 10))) + avg(greatest(0.9 * (value - 80), -0.1 * (value - 80))), 6) AS mse FROM events GROUP BY user_id")
def joint_losses(spark, sf):
    """Both joint losses by user."""
    f, t = _forecast(spark, sf), {"ACTUAL": ["PREDICT", "PREDICT_LOW", "PREDICT_HIGH"]}
    a = metrics.joint_mae_tilted_loss(f, t, [0.1, 0.9], BY).select("user_id", rounded("loss").alias("mae"))
    return a.join(metrics.joint_mse_tilted_loss(f, t, [0.1, 0.9], BY).select("user_id", rounded("loss").alias("mse")), "user_id")


@registered(f"SELECT user_id, round(avg(abs(value - 40)) / avg(n), 6) AS mase FROM (SELECT user_id, value, abs(value - lag(value, 2) {W}) AS n FROM events) GROUP BY user_id")
def scaled_error(spark, sf):
    """Error against the value two rows ago."""
    return metrics.mean_absolute_scaled_error(_forecast(spark, sf), "ACTUAL", "PREDICT", 2, ORDER, by=BY).select("user_id", rounded("mase").alias("mase"))


@registered("SELECT user_id, round(1 - sum((value - 40) ** 2) / (sum((value - 30) ** 2) + 1e-12), 6) AS r2, round(sqrt(avg((value - 40) ** 2)), 6) AS rmse FROM events GROUP BY user_id")
def r2_and_rmse(spark, sf):
    """R2 against a constant, and the root mean squared error."""
    f = _forecast(spark, sf)
    return metrics.train_r2(f, "ACTUAL", "PREDICT", 30.0, BY).join(metrics.rmse(f, "ACTUAL", "PREDICT", BY), "user_id").select("user_id", rounded("r2").alias("r2"), rounded("rmse").alias("rmse"))


def _quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("value").alias("y"), F.lit(10.0).alias("predict_lead_0_q_0.1"), (F.col("user_id") % 50).cast("double").alias("predict_lead_0_mean"), F.lit(40.0).alias("predict_lead_0_q_0.9"))


@registered("SELECT '0' AS lead, 0.1::DOUBLE AS quantile, round(avg((value < 10)::INT), 6) AS ratio FROM events UNION ALL SELECT '0', 0.9::DOUBLE, round(avg((value < 40)::INT), 6) FROM events")
def quantile_ratios(spark, sf):
    """Shares of values below quantiles."""
    return metrics.compute_quantile_ratios(_quantiles(spark, sf), "y").select("lead", "quantile", rounded("ratio").alias("ratio"))


@registered("SELECT '0' AS lead, 0.1::DOUBLE AS low, 0.5::DOUBLE AS high, round(avg((10 > user_id % 50)::INT), 6) AS share FROM events UNION ALL SELECT '0', 0.5::DOUBLE, 0.9::DOUBLE, round(avg((user_id % 50 > 40)::INT), 6) FROM events")
def quantile_crossings(spark, sf):
    """Shares of quantiles in the wrong order."""
    return metrics.compute_quantile_crossings(_quantiles(spark, sf)).select("lead", "low", "high", rounded("share").alias("share"))


HITS = "(PARTITION BY user_id ORDER BY ts, event_id"


@registered(f"""
WITH p AS (SELECT user_id, ts, event_id, (value > 80)::INT AS i, (value < 20)::INT AS p FROM events),
h AS (SELECT user_id, i, CASE WHEN row_number() OVER {HITS}) <= 2 THEN coalesce(max(p) OVER {HITS} ROWS 1 PRECEDING), 0) ELSE coalesce(max(p) OVER {HITS} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) END AS h FROM p)
SELECT user_id, round(sum(least(h, i)) / nullif(sum(i), 0)::DOUBLE, 6) AS recall FROM h GROUP BY user_id""")
def announced_incidents(spark, sf):
    """Share of incidents announced one or two rows before."""
    e = events(spark, sf).select("user_id", "ts", "event_id", (F.col("value") > 80).cast("int").alias("i"), (F.col("value") < 20).cast("int").alias("p"))
    return metrics.incident_recall(e, "i", "p", (1, 2), ORDER, BY).select("user_id", rounded("recall").alias("recall"))


@registered("""
WITH t AS (SELECT value AS s, (user_id % 3 = 0)::INT AS y FROM events), g AS (SELECT s, sum(y) AS p, count(*) AS n FROM t GROUP BY s)
SELECT s AS threshold, round(sum(p) OVER w / sum(n) OVER w, 6) AS precision, round(sum(p) OVER w / (SELECT sum(y) FROM t), 6) AS recall FROM g WINDOW w AS (ORDER BY s DESC)""")
def precision_recall(spark, sf):
    """Precision and recall by threshold."""
    e = events(spark, sf).select(F.col("value").alias("s"), (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    return plot_data.precision_recall_points(e, "y", "s").select("threshold", rounded("precision").alias("precision"), rounded("recall").alias("recall"))


@registered("""
WITH p AS (SELECT user_id, ts, event_id, (value > 80)::INT AS i, floor(value)::DOUBLE % 10 AS s FROM events),
w AS (SELECT i, s, coalesce(max(i) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS ahead,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2 THEN coalesce(max(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 1 PRECEDING), 0)
  ELSE coalesce(max(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) END AS carried FROM p),
u AS (SELECT t, sum(p) AS p, sum(n) AS n, sum(r) AS r FROM (SELECT s AS t, ahead AS p, 1 AS n, 0 AS r FROM w UNION ALL SELECT carried, 0, 0, i FROM w) GROUP BY t)
SELECT t AS threshold, round(coalesce(sum(p) OVER d / nullif(sum(n) OVER d, 0), 1), 6) AS precision, round(sum(r) OVER d / (SELECT sum(i) FROM w), 6) AS recall FROM u WINDOW d AS (ORDER BY t DESC)""")
def incident_curve(spark, sf):
    """Precision and recall of announced incidents by threshold."""
    e = events(spark, sf).select("user_id", "ts", "event_id", (F.col("value") > 80).cast("int").alias("i"), (F.floor("value").cast("double") % 10).alias("s"))
    c = metrics.precision_incident_recall_curve(e, "i", "s", (1, 2), ORDER, BY)
    return c.select("threshold", rounded("precision").alias("precision"), rounded("recall").alias("recall"))


@registered("""
WITH d AS (SELECT time_bucket(INTERVAL '1 day', ts) AS day, avg(value) AS y FROM events GROUP BY 1), l AS (SELECT *, lag(49.0::DOUBLE) OVER (ORDER BY day) AS low, lag(51.0::DOUBLE) OVER (ORDER BY day) AS high FROM d)
SELECT day, round(y, 6) AS y, low, high, coalesce(y >= high OR y <= low, false) AS outlier FROM l""")
def quantile_chart(spark, sf):
    """Daily means, an interval that was predicted a day before, and the days outside."""
    d = reshaping.resampled(events(spark, sf), "1d", ["value"], "ts").dropna(subset=["value"])
    d = d.withColumns({"predict_lead_1_q_0.1": F.lit(49.0), "predict_lead_1_q_0.9": F.lit(51.0), "predict_lead_1_mean": F.lit(50.0)})
    q = plot_data.quantile_plot(d, "value", "ts", 1, [0.1, 0.9], outlier_min_q=1)
    return q.select(F.col("ts").cast("timestamp_ntz").alias("day"), rounded("value").alias("y"), col("predict_lead_1_q_0.1").alias("low"), col("predict_lead_1_q_0.9").alias("high"), "outlier")


@registered("SELECT event_type AS row, time_bucket(INTERVAL '1 day', ts) AS period, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def incident_heatmap(spark, sf):
    """Sums by type and day."""
    h = plot_data.incident_heatmap(events(spark, sf), "event_type", "value", "ts")
    return h.select("row", F.col("period").cast("timestamp_ntz").alias("period"), rounded("value", 4).alias("value"))


@registered("""
WITH m AS (SELECT avg(value) AS m FROM events WHERE ts < TIMESTAMP '2024-01-15'), d AS (SELECT time_bucket(INTERVAL '1 day', ts) AS t, avg(value) AS y FROM events GROUP BY 1),
dm AS (SELECT avg(y) AS m FROM d WHERE t < TIMESTAMP '2024-01-15')
SELECT 'native' AS resolution, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split, round(100 * (1 - sum((value - 40) ** 2) / sum((value - m) ** 2)), 4) AS r2 FROM events, m GROUP BY 1, 2
UNION ALL SELECT '1d', CASE WHEN t < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END, round(100 * (1 - sum((y - 40) ** 2) / sum((y - m) ** 2)), 4) FROM d, dm GROUP BY 1, 2""")
def performance_by_resolution(spark, sf):
    """R2 in percent by resolution and split."""
    train, test = cleaning.datetime_train_test_split(_forecast(spark, sf), datetime="2024-01-15", datecol="ts")
    p = plot_data.performance_evaluation_fixed_predict_ahead(train, test, "ACTUAL", "PREDICT", "ts", ["native", "1d"])
    return p.select("resolution", "split", rounded("R2", 4).alias("r2"))


@registered("SELECT event_id, round((SELECT quantile_cont(value, 0.5) FROM events), 6) AS mean, round((SELECT quantile_cont(value, 0.1) FROM events), 6) AS low, round((SELECT quantile_cont(value, 0.9) FROM events), 6) AS high FROM events")
def constant_forecast(spark, sf):
    """Median and quantiles as forecasts."""
    e = events(spark, sf)
    m = models.ConstantTimeseriesRegressor("ts", "value", quantiles=[0.1, 0.9]).fit(e)
    return m.predict(e).select("event_id", rounded("predict_lead_0_mean").alias("mean"), rounded("predict_lead_0_q_0.1").alias("low"), rounded("predict_lead_0_q_0.9").alias("high"))


@registered("SELECT event_id, round(regr_intercept + regr_slope * (user_id % 7), 4) AS mean FROM events, (SELECT regr_slope(value, user_id % 7) AS regr_slope, regr_intercept(value, user_id % 7) AS regr_intercept FROM events)")
def linear_forecast(spark, sf):
    """A linear forecast of one feature without a penalty."""
    e = events(spark, sf).withColumn("x", (F.col("user_id") % 7).cast("double"))
    return models.LassoTimeseriesRegressor("ts", "value", ["x"], alpha=0.0).fit(e).predict(e).select("event_id", rounded("predict_lead_0_mean", 4).alias("mean"))


@registered("""
WITH e AS (SELECT event_id, value AS y, (user_id % 7)::DOUBLE AS x, (1 + event_id % 3)::DOUBLE AS w FROM events),
m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * y) / sum(w) AS mxy, sum(w * x * x) / sum(w) AS mxx FROM e)
SELECT event_id, round(my + (mxy - mx * my) / (mxx - mx * mx) * (x - mx), 4) AS mean FROM e, m""")
def weighted_forecast(spark, sf):
    """A linear forecast with sample weights."""
    e = events(spark, sf).withColumns({"x": (F.col("user_id") % 7).cast("double"), "w": 1 + F.col("event_id") % 3})
    return models.LassoTimeseriesRegressor("ts", "value", ["x"], alpha=0.0, weight="w").fit(e).predict(e).select("event_id", rounded("predict_lead_0_mean", 4).alias("mean"))


@registered("""
WITH e AS (SELECT event_id, value AS y, (value > 50)::INT::DOUBLE AS x FROM events), m AS (SELECT covar_pop(y, x) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM e)
SELECT event_id, round(my + sign(c) * greatest(abs(c) - 1, 0) / v * (x - mx), 4) AS mean FROM e, m""")
def lasso_forecast(spark, sf):
    """A linear forecast of one feature with a penalty."""
    e = events(spark, sf).withColumn("x", (F.col("value") > 50).cast("double"))
    return models.LassoTimeseriesRegressor("ts", "value", ["x"], alpha=1.0).fit(e).predict(e).select("event_id", rounded("predict_lead_0_mean", 4).alias("mean"))


@registered()
def feature_importances(spark, sf):
    """How much worse a forecast gets when a feature's values are dealt anew."""
    e = events(spark, sf).withColumns({"x": (F.col("value") > 50).cast("double"), "z": (F.col("user_id") % 7).cast("double")})
    return models.permutation_importances(models.LassoTimeseriesRegressor("ts", "value", ["x", "z"], alpha=0.0).fit(e), e)


@registered()
def benchmark_scores(spark, sf):
    """Two forecasters against the last value and the training mean, on daily values."""
    d = reshaping.resampled(events(spark, sf), "6h", ["value"], "ts").withColumn("x", F.hour("ts").cast("double"))
    kinds = {"linear": models.LassoTimeseriesRegressor("ts", "value", predict_ahead=[1, 2], alpha=0.0), "constant": models.ConstantTimeseriesRegressor("ts", "value", predict_ahead=[1, 2])}
    return models.benchmark_wrapper(kinds, {"events": d}, {"events": ["x"]}, {"events": "value"}, "ts", "6h", {"events": "2024-01-15"})


@registered()
def quantile_forecast(spark, sf):
    """A lasso and linear quantiles."""
    e = events(spark, sf).withColumn("x", (F.col("user_id") % 7).cast("double"))
    m = models.LassoTimeseriesRegressor("ts", "value", ["x"], quantiles=[0.1, 0.9]).fit(e)
    return m.predict(e).select("event_id", *models.prediction_names([0], [])[:1], col("predict_lead_0_q_0.1").alias("low"), col("predict_lead_0_q_0.9").alias("high"))


def _best_lines(q: float, alpha: float) -> str:
    """The line of least penalised loss of all that pass through two users, or are level and pass through one."""
    return f"""(SELECT arg_min(a, loss) AS a, arg_min(b, loss) AS b FROM (
  SELECT l.a, l.b, avg(CASE WHEN u.y >= l.a + l.b * u.x THEN {q} * (u.y - l.a - l.b * u.x) ELSE {1 - q} * (l.a + l.b * u.x - u.y) END) + {alpha} * abs(l.b) AS loss
  FROM (SELECT p.y - (r.y - p.y) / (r.x - p.x) * p.x AS a, (r.y - p.y) / (r.x - p.x) AS b FROM u p JOIN u r ON p.x < r.x UNION ALL SELECT y, 0.0 FROM u) l, u GROUP BY l.a, l.b))"""


@registered(f"""
WITH u AS (SELECT user_id, avg(value) AS y, count(*)::DOUBLE AS x FROM events GROUP BY user_id), lo AS {_best_lines(0.25, 0.01)}, hi AS {_best_lines(0.75, 0.01)}
SELECT user_id, round(lo.a + lo.b * x, 4) AS low, round(hi.a + hi.b * x, 4) AS high FROM u, lo, hi""")
def penalised_quantiles(spark, sf):
    """Quantile lines of the users' mean values by their numbers of events, with a penalty on the slope."""
    u = events(spark, sf).groupBy("user_id").agg(F.avg("value").alias("y"), F.count("*").cast("double").alias("x"))
    m = models.LassoTimeseriesRegressor("user_id", "y", ["x"], quantiles=[0.25, 0.75], alpha=0.01, monotonic_quantiles=False)
    return m.fit(u).predict(u).select("user_id", rounded("predict_lead_0_q_0.25", 4).alias("low"), rounded("predict_lead_0_q_0.75", 4).alias("high"))


@registered()
def quantile_regression(spark, sf):
    """Coefficients and p-values of linear quantiles."""
    e = events(spark, sf).withColumns({"x": (F.col("user_id") % 7).cast("double"), "z": (F.col("value") > 50).cast("double")})
    m = models.LinearQuantileRegression("value", ["x", "z"], [0.25, 0.75], tol=1e-3, max_iter=25).fit(e)
    return spark.createDataFrame([(q, n, v, m.pvalue_[q][n]) for q, own in m.coef_.items() for n, v in own.items()], "quantile double, name string, weight double, pvalue double")


@registered()
def network_forecast(spark, sf):
    """A small neural network's forecasts."""
    e = events(spark, sf).withColumn("x", (F.col("user_id") % 7).cast("double"))
    return models.MLPTimeseriesRegressor("ts", "value", ["x"], quantiles=[0.9], epochs=50).fit(e).predict(e).select("event_id", F.col("predict_lead_0_mean").alias("mean"), col("predict_lead_0_q_0.9").alias("high"))


@registered()
def chosen_rolling_features(spark, sf):
    """The rolling feature that goes best with the value, of several."""
    out, _ = features.automatic_rolling_features(events(spark, sf).withColumn("y", F.col("value")), "y", ["value"], ORDER, (2, 5), ("mean", "max"), partition_by=BY)
    return out.select("event_id", out.columns[-1]).toDF("event_id", "feature")


@registered()
def rolling_search(spark, sf):
    """Windows of rolling means and lags, chosen by time-series splits."""
    e = events(spark, sf).withColumn("y", F.lead("value").over(ordered(BY, ORDER)))
    out = features.RollingSearch(ORDER, "y", ["value"], ((1, 2, 3), (5, 8)), partition_by=BY).fit(e).transform(e)
    return out.select("event_id", *[col(c) for c in out.columns[-4:]]).toDF("event_id", "a", "b", "c", "d")


@registered()
def synthetic_series(spark, sf):
    """A synthetic sensor for a year."""
    d = synthetic.synthetic_date_range(spark, "2024-01-01", "2025-01-01", "1h", max_delay=1, random_stop_freq=0.01, random_stop_max_length=5)
    return synthetic.synthetic_timeseries(d, 2, 1, 3, noise=0.3, minmax_values=(0, 10), cutoff_values=(0.5, 9.5), random_missing=0.1)


@registered("SELECT c_custkey, round(2 * 6373.0 * asin(sqrt(sin((radians(52.1) - radians(lat)) / 2) ** 2 + cos(radians(lat)) * cos(radians(52.1)) * sin((radians(5.2) - radians(lon)) / 2) ** 2)), 6) AS km FROM (SELECT c_custkey, (c_custkey % 180 - 90)::DOUBLE AS lat, (c_custkey % 360 - 180)::DOUBLE AS lon FROM customer)")
def station_distance(spark, sf):
    """Distances on the globe from made-up places."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 180 - 90).cast("double").alias("lat"), (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"))
    return c.select("c_custkey", rounded(weather.haversine(F.col("lat"), F.col("lon"), 52.1, 5.2)).alias("km"))


@registered("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def binned_events(spark, sf):
    """Hourly bins by type, as a stream would make them."""
    b = binning.binned(events(spark, sf), "ts", "value", "1 hour", ["event_type"])
    return b.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded("mean").alias("mean"), "least", "most")


@registered(f"""
WITH e AS (SELECT * FROM events WHERE epoch_us(ts) <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events)),
f AS (SELECT event_id, lag(value, 2) {W} AS lag_2, CASE WHEN count(value) {W[:-1]} ROWS 4 PRECEDING) = 5 THEN round(avg(value) {W[:-1]} ROWS 4 PRECEDING), 6) END AS mean_5,
  count(value) {W[:-1]} ROWS 2 PRECEDING) = 3 AND max(value) {W[:-1]} ROWS 2 PRECEDING) - min(value) {W[:-1]} ROWS 2 PRECEDING) <= 5 AS flat FROM e)
SELECT * FROM f""")
def streamed_history(spark, sf):
    """Lags, rolling means and flat lines of a stream over all events, for what its watermark has passed."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before, place = spark.conf.get(key, None), temporary(spark, "streamed-history")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    wanted = stateful.Wanted(lags=(2,), rolling=(("mean", 5),), flat=(3, 5.0))
    stream = stateful.with_history(spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*"), "ts", "value", BY, wanted, ["event_id"], "1 hour")
    stateful.rocksdb(spark)
    try:
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/at").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(stream.schema).parquet(f"{place}/out")
    return out.select("event_id", "lag_2", rounded("mean_5").alias("mean_5"), "flat")


def queries() -> dict[str, Query]:
    """By registered name."""
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by registered name."""
    return dict(_sql)
