"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidegrid.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    same(plans.queries()[name](spark, DATA).toPandas(), duck.sql(plans.oracle_sql()[name]).df())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows(spark, name):
    out = plans.queries()[name](spark, DATA)
    assert out.count() > 0 and out.columns


def test_plot_data(spark):
    from pyspark.sql import functions as F

    from tidegrid.plans import plot_data

    e = plans.events(spark, DATA).select("ts", F.col("value").alias("y"), F.lit(5.0).alias("predict_lead_1_q_0.1"), F.lit(60.0).alias("predict_lead_1_q_0.9"), F.lit(30.0).alias("predict_lead_1_mean"))
    q = plot_data.quantile_plot(e, "y", "ts", 1, [0.1, 0.9], outlier_min_q=1)
    want = e.where("y >= 60 OR y <= 5").count()
    assert abs(q.where("outlier").count() - want) <= 1  # the first row has no prediction
    points = plot_data.lag_correlation_points(e.select("ts", "y", F.col("y").alias("x")), "y", "ts", 3)
    assert points.where("strongest").first().LAG == 0
    flags = plot_data.removal_points(e.withColumn("bad", F.col("y") > 60), "y", "bad", "ts", 5)
    assert flags.where("removed").count() == e.where("y > 60").count()


def test_whole_tables(spark, tmp_path):
    """Every user and type counts, whatever the id; the fitting rows are cut by time."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT * REPLACE (user_id + 100 * (event_id % 2) AS user_id) FROM '{DATA}/events.parquet'")
    con.sql("INSERT INTO events SELECT event_id + 1000000, ts, 777, event_type, value * 10, props FROM events")  # a hot user, and a range of its own
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("resampled_mean_all", "padded_values_all", "wide_table_all", "clip_fitted_by_time", "range_validator_by_time"):
        got = plans.queries()[name](spark, str(tmp_path)).toPandas()
        want = con.sql(plans.oracle_sql()[name]).df()
        if "user_id" in got:
            assert set(got.user_id) == set(con.sql("SELECT DISTINCT user_id FROM events").df().user_id)
        same(got, want)
    assert set(con.sql("SELECT DISTINCT event_type FROM events").df().event_type) == set(plans.TYPES)
