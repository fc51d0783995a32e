"""Weather sources: station measurements as text, forecasts and rain as JSON. Files come from any store Spark reads;
fetching them is left to the caller, so that nothing here needs a network."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import duration, moment

# Fixed values, by the supplier's definition of its files: variables given in tenths, and those whose -1 means "less than
# 0.05". The daily FHNH is an hour, not tenths, and is left as it is; T10 and FXX are older names of T10N and FX.
TENTHS = ("FH", "FF", "FX", "T", "T10", "T10N", "TD", "SQ", "DR", "RH", "P", "FHVEC", "FG", "FHX", "FHN", "FXX", "TG", "TN", "TX", "RHX", "PG", "PX", "PN", "EV24")
CLIPPED = ("SQ", "RH", "RHX")
EARTH_KM = 6373.0


def haversine(lat1: Column, lon1: Column, lat2: float, lon2: float) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.radians(lat1), F.lit(math.radians(lat2))
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.lit(math.radians(lon2)) - F.radians(lon1)) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def parse_date(text: Column) -> Column:
    """A time in one of three forms."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd")])


def read_knmi_stations(spark: SparkSession, path: str) -> DataFrame:
    """``number, longitude, latitude, altitude, name`` from a station list: columns two or more blanks apart."""
    line = F.regexp_replace(F.regexp_replace("value", r"^#\s*", ""), r"\s{2,}", ";")
    part = F.split(line, ";")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^#?\s*[0-9]{3}:?\s{2,}"))
    return rows.select(
        F.regexp_replace(part[0], "[^0-9]", "").cast("int").alias("number"), part[1].cast("double").alias("longitude"), part[2].cast("double").alias("latitude"),
        part[3].cast("double").alias("altitude"), F.trim(part[4]).alias("name"),
    )


def request_window(start: str, end: str, freq: str = "hourly") -> tuple[datetime, datetime]:
    """What to ask the supplier for, so that all hours from ``start`` to ``end`` come: it answers by whole days, and the
    hour that ends at midnight belongs to the day before."""
    a, b = datetime.fromisoformat(start), datetime.fromisoformat(end)
    if freq != "hourly":
        return a, b
    return (a - timedelta(hours=1)).replace(hour=0, minute=0), b.replace(hour=23, minute=0)


def read_knmi_measurements(spark: SparkSession, path: str, freq: str = "hourly", preprocess: bool = False, start: str | None = None, end: str | None = None) -> DataFrame:
    """``STN, TIME`` and the variables of measurement files, from ``start`` to ``end`` if they are given. The last line of
    each file's ``#`` header names its columns; a variable that a file lacks is missing in its rows. Hour n ends the n-th hour
    of its day, so hour 24 is midnight of the next. Only the different headers come to the driver."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    heads = text.where(F.col("value").startswith("#")).groupBy("file").agg(F.max_by("value", F.struct("block", "line")).alias("head"))
    formats = sorted(r["head"] for r in heads.select("head").distinct().collect())
    named = [[n.strip() for n in h.lstrip("# ").split(",")] for h in formats]
    part = F.split("value", ",")

    def read(*names: str) -> Column:
        """The first of these columns that a row's own format has."""
        found = F.lit(None).cast("string")
        for h, own in zip(formats, named, strict=True):
            k = next((own.index(n) for n in names if n in own), None)
            if k is not None:
                found = F.when(F.col("head") == h, F.nullif(F.trim(F.get(part, F.lit(k))), F.lit(""))).otherwise(found)
        return found

    hours = ("HH", "H", "HR") if freq == "hourly" else ()
    rows = text.where(~F.col("value").startswith("#") & (F.trim("value") != "")).join(heads, "file")
    day = F.try_to_timestamp(read("YYYYMMDD"), F.lit("yyyyMMdd"))
    time = day + F.make_dt_interval(hours=F.coalesce(read(*hours).cast("int"), F.lit(0))) if hours else day
    variables = dict.fromkeys(n for own in named for n in own if n not in ("STN", "YYYYMMDD", *hours))
    out = rows.select(read("STN").cast("int").alias("STN"), time.alias("TIME"), *[read(v).cast("double").alias(v) for v in variables])
    if start is not None:
        out = out.where(F.col("TIME") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("TIME") <= F.lit(end).cast("timestamp"))
    return preprocess_knmi(out) if preprocess else out


def preprocess_knmi(df: DataFrame) -> DataFrame:
    """Tenths become units; amounts below the smallest measurable become 0."""
    new = {}
    for c in df.columns:
        x = F.col(c) / 10 if c in TENTHS else F.col(c)
        if c in CLIPPED:
            x = F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
        if c in TENTHS or c in CLIPPED:
            new[c] = x
    return df.withColumns(new) if new else df


def read_knmi(spark: SparkSession, measurements: str, stations: str, lat: float, lon: float, start: str, end: str, freq: str = "hourly", variables: Sequence[str] | None = None, find_nonan_station: bool = False, preprocess: bool = False, drop_station: bool = True) -> DataFrame:
    """Measurements of the nearest station, or of the nearest without missing values, from ``start`` to ``end``."""
    rows = read_knmi_measurements(spark, measurements, freq, preprocess, start, end)
    if variables:
        rows = rows.select("STN", "TIME", *variables)
    near = read_knmi_stations(spark, stations).select(F.col("number").alias("STN"), haversine(F.col("latitude"), F.col("longitude"), lat, lon).alias("km"))
    usable = rows
    if find_nonan_station:
        whole = [c for c in rows.columns if c not in ("STN", "TIME")]
        gaps = rows.groupBy("STN").agg(F.max(F.greatest(*[F.col(c).isNull() for c in whole]) if len(whole) > 1 else F.col(whole[0]).isNull()).alias("gap"))
        usable = gaps.where("NOT gap")
    found = near.join(usable.select("STN").distinct(), "STN").orderBy("km", "STN").limit(1).collect()
    if not found:
        raise RuntimeError("no station has what was asked for")
    out = rows.where(F.col("STN") == found[0].STN)
    return out.drop("STN") if drop_station else out


FORECAST = "cod string, city struct<id:long,name:string,coord:struct<lat:double,lon:double>>, list array<struct<dt:long,main:struct<temp:double,temp_min:double,temp_max:double,pressure:double,sea_level:double,grnd_level:double,humidity:double>,clouds:struct<all:double>,wind:struct<speed:double,deg:double>,rain:struct<`3h`:double>,snow:struct<`3h`:double>>>"


def read_openweathermap(spark: SparkSession, path: str) -> DataFrame:
    """A forecast's rows, one for each time, from a JSON answer."""
    rows = spark.read.schema(FORECAST).option("multiLine", True).json(path).select(F.inline("list"))
    main = [F.col(f"main.{c}").alias(c) for c in ("temp", "temp_min", "temp_max", "pressure", "sea_level", "grnd_level", "humidity")]
    return rows.select(
        F.timestamp_seconds("dt").alias("TIME"), *main, F.col("clouds.all").alias("cloud_coverage"), F.col("wind.speed").alias("wind_speed"), F.col("wind.deg").alias("wind_deg"),
        F.col("rain.3h").alias("rain_3h"), F.col("snow.3h").alias("snow_3h"),
    )


def read_rain(spark: SparkSession, paths: str | Sequence[str], start: str, end: str, freq: str = "5min") -> DataFrame:
    """``TIME, PRECIPITATION`` from JSON answers ``{"data": [[epoch ms, value], ...]}``: batches are put together, rows
    that several hold count once, and times from ``start`` to ``end`` stay. Steps longer than 5 minutes get the mean of
    what they hold, under the time they begin."""
    step = duration(freq)
    if step < duration("5min"):
        raise ValueError("the shortest step is 5 minutes")
    raw = spark.read.schema("data array<array<double>>").option("multiLine", True).json(paths if isinstance(paths, str) else list(paths))
    rows = raw.select(F.explode("data").alias("p")).select(F.timestamp_millis(F.col("p")[0].cast("long")).alias("TIME"), F.col("p")[1].alias("PRECIPITATION")).distinct()
    rows = rows.where(F.col("TIME").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if step == duration("5min"):
        return rows
    begin = moment(F.expr(f"unix_micros(TIME) - pmod(unix_micros(TIME), {step})")).alias("TIME")
    return rows.groupBy(begin).agg(F.avg("PRECIPITATION").alias("PRECIPITATION"))

