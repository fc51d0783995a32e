"""Streams with state give the rows of the batch operators, over small batches and a restart."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.operators import exploration, features, validation
from tidegrid.streaming import stateful

WANTED = stateful.Wanted(lags=(1, 4), rolling=(("mean", 3), ("max", 5), ("median", 4)), flat=(3, 1.0), limits=(10, 90), max_gap=2)
KIND = "k string, us long, o long, v double"


def batches():
    """Rows of two series, in batches that overlap in time; a few come too late, one has no value, one no time."""
    rng, rows = random.Random(3), []
    for i in range(300):
        flat = 100 <= i < 140
        rows.append(("ab"[i % 2], 1_700_000_000_000_000 + (i // 3) * 60_000_000, i, None if i % 41 == 5 else 50.0 if flat else float(rng.randint(0, 100))))
    out = []
    for b in range(5):
        part = rows[60 * b : 60 * (b + 1)]
        rng.shuffle(part)
        out.append(part)
    out[1], out[2] = out[1][:50] + out[2][:5], out[1][50:] + out[2][5:]  # late, but not too late
    out[4].append(("a", 1_700_000_000_000_000, 999, 5.0))  # too late
    out[4].append(("a", None, 998, 5.0))
    return out


def batch_features(df, until):
    df = df.where((F.col("us") <= until) & (F.col("o") < 998)).withColumn("t", F.timestamp_micros("us"))
    by, order = ["k"], ["t", "o"]
    out = df
    for kind, n in (("lag", 1), ("lag", 4), *WANTED.rolling):
        step = features.BuildRollingFeatures(order, kind, lookback=0, window_size=n, cols=["v"], partition_by=by)
        out = step.transform(out).withColumnRenamed(step.made[0], f"{kind}_{n}")
    flags = validation.FlatlineValidator(order, 3, ["v"], margin=1.0, backfill=False, partition_by=by)
    out = flags.fit(out).validate(out).withColumnRenamed("v_invalid", "flat")
    out = out.withColumns({"PREDICT_LOW": F.lit(10.0), "PREDICT_HIGH": F.lit(90.0)})
    out = exploration.incident_curves(out, order, max_gap=2, actual="v", low="PREDICT_LOW", high="PREDICT_HIGH", partition_by=by, name="incident")
    # Rows behind an open incident that no more than ``max_gap`` others follow are still waiting.
    last = F.max(F.when(F.col("incident") > 0, F.struct("t", "o"))).over(Window.partitionBy("k"))
    tail = F.count_if(F.struct("t", "o") > last).over(Window.partitionBy("k"))
    out = out.withColumns({"_last": last, "_tail": tail}).where(~((F.struct("t", "o") > F.col("_last")) & (F.col("_tail") <= 2)))
    return out.select("k", "t", "o", "v", *WANTED.names())


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    stateful.rocksdb(spark)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def told(df):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.collect()))


def test_stream_is_batch_over_restarts(spark, store, tmp_path):
    parts = batches()
    (tmp_path / "in").mkdir()
    files = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def more(own):
        for b in own:
            spark.createDataFrame(parts[b], KIND).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
            stream = stateful.with_history(files.withColumn("t", F.timestamp_micros("us")), "t", "v", ["k"], WANTED, ["o"], "45 minutes")
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(120)

    more([0, 1])
    first = spark.read.parquet(str(tmp_path / "out")).count()
    more([2, 3, 4])  # new queries from the same checkpoint
    got = spark.read.parquet(str(tmp_path / "out"))
    newest = max(r[1] for p in parts for r in p if r[1] is not None)
    rows = [r for p in parts for r in p if r[1] is not None]
    want = batch_features(spark.createDataFrame(rows, KIND), newest - 2_700_000_000)
    a, b = told(got), told(want)
    assert sorted(set(a) - set(b))[:4] == sorted(set(b) - set(a))[:4] == [] and a == b and 0 < first < len(a)
    assert want.where("incident > 0").count() > 10 and want.where("flat").count() > 5


def test_incidents_alone_and_no_rows(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    files = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    stream = stateful.with_history(files.withColumn("t", F.timestamp_micros("us")), "t", "v", ["k"], stateful.Wanted(limits=(10, 90)), late="1 minute")
    query = stream.writeStream.format("memory").queryName("alone").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60) and spark.table("alone").count() == 0 and spark.table("alone").columns == ["k", "t", "v", "incident"]


def test_rows_wait_many_to_an_entry():
    """The store is called by batch of a series, not by row; values that are missing and ties come out as they went in."""
    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def appendList(self, rows):
            calls.extend(rows)
            self.rows += rows

        def get(self):
            return iter(self.rows)

        def clear(self):
            self.rows = []

        put = appendList

        def exists(self):
            return bool(self.rows)

    class Value:
        row = None

        def update(self, row):
            calls.append(row)
            self.row = row

        def get(self):
            return self.row

        def exists(self):
            return self.row is not None

    class Handle:
        def getListState(self, name, schema):
            return State()

        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            self.at = at

    class Times:
        def getCurrentWatermarkInMs(self):
            return 600

    wanted = stateful.Wanted(lags=(2,), rolling=(("mean", 3),))
    processor = stateful.SeriesProcessor(wanted, ["k"], 1, ["k", "t", "o", "x", "f0", "f1"])
    handle = Handle()
    processor.init(handle)
    t = [(i * 7919) % 1000 * 1000 for i in range(1000)]
    rows = pd.DataFrame({"k": 1, "_at": 0, "o": [(i * 31) % 1000 for i in range(1000)], "x": [None if i % 10 == 0 else i / 4 for i in range(1000)], "t": [a // 2000 * 2000 for a in t]})
    processor.handleInputRows((1,), iter([rows[:500], rows[500:]]), None)
    assert len(calls) == 2 and handle.at == 0
    out = pd.concat(processor.handleExpiredTimer((1,), Times(), None))
    expected = sorted((a, o, None if x != x else x) for a, o, x in zip(rows.t, rows.o, rows.x, strict=True) if a <= 600_000)
    given = lambda c: [None if v is None or v != v else v for v in c]
    assert list(zip(out.t, out.o, given(out.x), strict=True)) == expected
    assert given(out.f0) == [None, None, *(x for _, _, x in expected[:-2])]
    assert len(calls) == 4 and handle.at == 602
