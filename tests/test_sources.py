"""Sources, stores, streams and hooks."""

import json
import logging
from datetime import datetime

from pyspark.sql import functions as F

from tidegrid.functions.hooks import FeatureEngineer, log_new_columns
from tidegrid.operators.validation import OutsideRangeValidator
from tidegrid.sources import stations, synthetic, tables, weather
from tidegrid.streaming import binning


def test_station_files(spark, tmp_path):
    (tmp_path / "stations.txt").write_text("# STN      LON(east)   LAT(north)  ALT(m)  NAME\n# 260:      5.180        52.100      1.90  De Bilt\n# 344:      4.447        51.962     -4.30  Rotterdam\n")
    (tmp_path / "hours.txt").write_text("# text\n# STN,YYYYMMDD,   HH,    T,   RH\n  260,20200101,    1,   35,   -1\n  260,20200101,   24,   40,     \n  344,20200101,    1,   50,    3\n")
    got = weather.read_knmi(spark, str(tmp_path / "hours.txt"), str(tmp_path / "stations.txt"), 52.09, 5.1, "2020-01-01", "2020-01-02", preprocess=True).orderBy("TIME").collect()
    assert [(r.TIME, r.T, r.RH) for r in got] == [(datetime(2020, 1, 1, 1), 3.5, 0.0), (datetime(2020, 1, 2), 4.0, None)]
    whole = weather.read_knmi(spark, str(tmp_path / "hours.txt"), str(tmp_path / "stations.txt"), 52.09, 5.1, "2020-01-01", "2020-01-02", find_nonan_station=True, drop_station=False)
    assert whole.first().STN == 344


HOURS = {
    "uurgeg_260_2011-2020.txt": "# text\n# STN,YYYYMMDD,   HH,    T,   RH\n  260,20200101,    1,   35,   -1\n  260,20201231,   24,   40,     \n",
    "uurgeg_344_2011-2020.txt": "# other\n# STN,YYYYMMDD,   HH,   RH,    T,   FF\n  344,20200101,    1,    8,   66,   10\n",
    "uurgeg_260_2021-2030.txt": "# STN,YYYYMMDD,H,T\n260,20210101,2,50\n",
    "notes.csv": "# STN,YYYYMMDD,HH,FF\n\n 344,20210101, 3, 7\n",
}
WANT = [(260, datetime(2020, 1, 1, 1), 35.0, -1.0, None), (260, datetime(2021, 1, 1), 40.0, None, None), (260, datetime(2021, 1, 1, 2), 50.0, None, None), (344, datetime(2020, 1, 1, 1), 66.0, 8.0, 10.0), (344, datetime(2021, 1, 1, 3), None, None, 7.0)]


def station_folder(tmp_path):
    for name, text in HOURS.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_every_file_has_its_own_header(spark, tmp_path):
    rows = weather.read_knmi_measurements(spark, station_folder(tmp_path)).orderBy("STN", "TIME")
    assert [(r.STN, r.TIME, r.T, r.RH, r.FF) for r in rows.collect()] == WANT
    some = weather.read_knmi_measurements(spark, str(tmp_path), start="2021-01-01", end="2021-01-01 02:00:00")
    assert some.count() == 2


def test_station_data_source(spark, tmp_path):
    stations.register(spark)
    path = station_folder(tmp_path)
    files = spark.read.format("station_files")
    rows = files.load(path)
    assert [(r.STN, r.TIME, r.T, r.RH, r.FF) for r in rows.orderBy("STN", "TIME").collect()] == WANT
    one = spark.read.format("station_files").options(stations="260", start="2021-01-01 01:00:00").load(path)
    assert [(r.STN, r.T) for r in one.collect()] == [(260, 50.0)]
    # Of four files, one by another station and one by its years are never opened.
    assert rows.rdd.getNumPartitions() == 4 and one.rdd.getNumPartitions() == 2
    # Filters of one query don't meddle with another.
    assert rows.where("STN = 260").count() == 3 and rows.count() == 5 and rows.where("STN = 344").unionByName(rows.where("STN = 260")).count() == 5
    some = spark.read.format("station_files").options(stations="344,999", end="2020-12-31").load(f"file://{path}/uur*.txt")
    assert [r.FF for r in some.select("FF").collect()] == [10.0]
    given = spark.read.format("station_files").schema("STN int, TIME timestamp, RH double").load(f"{path}/uurgeg_344_2011-2020.txt")
    assert [tuple(r) for r in given.collect()] == [(344, datetime(2020, 1, 1, 1), 8.0)]
    (tmp_path / "days").mkdir()
    (tmp_path / "days" / "etmgeg_260.txt").write_text("# STN,YYYYMMDD,TG\n260,20200101,12\n260,20200102,\n")
    days = spark.read.format("station_files").option("freq", "daily").load(f"{path}/days").orderBy("TIME")
    assert [(r.TIME, r.TG) for r in days.collect()] == [(datetime(2020, 1, 1), 12.0), (datetime(2020, 1, 2), None)]
    assert [(r.TIME, r.TG) for r in weather.read_knmi_measurements(spark, f"{path}/days", "daily").orderBy("TIME").collect()] == [(datetime(2020, 1, 1), 12.0), (datetime(2020, 1, 2), None)]


def test_dates_and_request_windows(spark):
    texts = ["2020-03-01 04:05:06", "2020-03-01", "20200301", "1 March", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "s string").select(weather.parse_date(F.col("s")).alias("t")).collect()]
    assert got == [datetime(2020, 3, 1, 4, 5, 6), datetime(2020, 3, 1), datetime(2020, 3, 1), None, None]
    # The hour that ends at midnight is asked for with the day before.
    assert weather.request_window("2020-03-01 00:00:00", "2020-03-02 05:00:00") == (datetime(2020, 2, 29), datetime(2020, 3, 2, 23))
    assert weather.request_window("2020-03-01 07:00:00", "2020-03-02", "daily") == (datetime(2020, 3, 1, 7), datetime(2020, 3, 2))


def test_json_sources(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"cod": "200", "list": [{"dt": 1577836800, "main": {"temp": 280.5}, "wind": {"speed": 3.0}, "rain": {"3h": 0.5}}]}))
    row = weather.read_openweathermap(spark, str(tmp_path / "f.json")).first()
    assert row.TIME == datetime(2020, 1, 1) and row.temp == 280.5 and row.rain_3h == 0.5 and row.snow_3h is None
    for k in range(2):
        (tmp_path / f"r{k}.json").write_text(json.dumps({"data": [[1577836800000, 1.0], [1577836800000 + 300000 * (k + 1), 2.0]]}))
    assert weather.read_rain(spark, [str(tmp_path / f"r{k}.json") for k in range(2)], "2020-01-01", "2020-01-02").count() == 3


def test_store_csv_and_hooks(spark, tmp_path, caplog):
    store = tables.TableStore(spark, str(tmp_path / "t"), "a long, b string")
    assert store.get().count() == 0
    store.add(spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string"))
    assert store.get("a = 2").first().b == "y"
    assert store.empty().get().count() == 0
    (tmp_path / "s.csv").write_text("TIME,v\n2020-01-01 00:00:00,1.5\n")
    assert tables.read_sensor_csv(spark, str(tmp_path / "s.csv"), time_col="TIME").first().TIME == datetime(2020, 1, 1)
    step = FeatureEngineer(log_new_columns(lambda df, k: df.withColumn("z", F.lit(k))), k=3)
    with caplog.at_level(logging.INFO, "tidegrid"):
        assert step.transform(spark.range(1)).first().z == 3
    assert "['z']" in caplog.text and step.get_feature_names_out() == ["id", "z"]


def test_synthetic(spark):
    d = synthetic.synthetic_date_range(spark, "2020-01-01", "2020-03-01", "1h", random_stop_freq=0.05, random_stop_max_length=4, seed=2)
    n = d.count()
    assert 500 < n < 1440
    s = synthetic.synthetic_timeseries(d, 1, 2, 3, noise=0.1, minmax_values=(0, 1), random_missing=0.25, seed=2)
    assert s.where("VALUE IS NULL").count() == round(n * 0.25)
    low, high = s.agg(F.min("VALUE"), F.max("VALUE")).first()
    assert low >= 0 and high <= 1


def test_stream_bins(spark, tmp_path):
    rows = [(datetime(2020, 1, 1, 0, m), "a", float(m)) for m in (1, 20, 61 % 60, 40)]
    spark.createDataFrame(rows, "t timestamp, k string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string, v double").parquet(str(tmp_path / "in"))
    good = OutsideRangeValidator(["v"], 0, 30).fit(spark.createDataFrame(rows, "t timestamp, k string, v double"))
    q = binning.binned(binning.checked(stream, good), "t", "v", "30 minutes", ["k"]).writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.start.minute: (r.n, r.most) for r in spark.table("bins").collect()}
    assert got == {0: (3, 20.0), 30: (0, None)}
