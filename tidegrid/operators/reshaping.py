"""Regular grids, long and wide tables, shifted targets, clock changes, windows as arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import duration, micros, moment
from ..functions.names import col
from ..functions.series import by_rows
from ..functions.windows import after, before, ordered, turned

#: Names of aggregates: ``first`` and ``last`` go by time (then by what the caller names as tie-breaks).
AGGREGATES = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct, "median": lambda c: F.percentile(c, F.lit(0.5)), "prod": F.product}


def rounded(us: Column, step: int, method: str) -> Column:
    """Microseconds on a grid of ``step``: floor, ceil, or round (halves to the even multiple)."""
    low = F.floor(us / F.lit(step)).cast("long")
    low = low - F.when(low * step > us, 1).otherwise(0)  # exact for large numbers
    rest = us - low * step
    if method == "floor":
        return low * step
    if method == "ceil":
        return (low + F.when(rest > 0, 1).otherwise(0)) * step
    if method == "round":
        up = (rest * 2 > step) | ((rest * 2 == step) & (low % 2 != 0))
        return (low + F.when(up, 1).otherwise(0)) * step
    raise ValueError("round_method must be floor, ceil or round")


def aggregated(method: str | Callable[[Column], Column], value: Column, order: Column) -> Column:
    """An aggregate by name, or any function of a column to an aggregate (a grouped pandas UDF, for example)."""
    if callable(method):
        return method(value)
    if method in ("first", "last"):
        known = F.when(value.isNotNull(), order)
        return (F.min_by if method == "first" else F.max_by)(value, known)
    return AGGREGATES[method](value)


def normalize_timestamps(
    df: DataFrame,
    freq: str,
    start_time: str | None = None,
    end_time: str | None = None,
    round_method: str = "ceil",
    aggregate_method: str | Sequence[str] | Callable[[Column], Column] = "last",
    fillna_method: str | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """A long table (TIME, ID, TYPE, VALUE) on a regular grid: every ID with every TYPE at every time.

    Times are rounded to ``freq`` and aggregated by grid time; bounds default to the first and last rounded time of the
    table; what lies outside is dropped, what is missing is NULL or filled forward ("ffill") or back ("bfill") within
    its series. ``first`` and ``last`` go by TIME, then by ``order``. Null IDs or TYPEs raise.
    """
    if df.where("ID IS NULL OR TYPE IS NULL").limit(1).count():
        raise ValueError("ID and TYPE must not be null")
    step = duration(freq)
    rows = df.withColumn("_at", rounded(micros(F.col("TIME")), step, round_method))
    low, high = F.min("_at").alias("low"), F.max("_at").alias("high")
    found = rows.agg(low, high).first() if start_time is None or end_time is None else None
    if found is not None and found.low is None:
        raise ValueError("no rows to take bounds from")
    edge = lambda given, k: F.lit(found[k]) if given is None else micros(F.lit(given).cast("timestamp"))
    # The first grid time is the start, floored to the grid.
    first, last = rounded(edge(start_time, "low"), step, "floor"), edge(end_time, "high")
    place = F.struct("TIME", *[col(c) for c in order])
    methods = [aggregate_method] if isinstance(aggregate_method, str) or callable(aggregate_method) else list(aggregate_method)
    names = ["VALUE"] if len(methods) == 1 else [f"VALUE_{m}" for m in methods]
    values = rows.groupBy("_at", "ID", "TYPE").agg(*[aggregated(m, F.col("VALUE"), place).alias(n) for m, n in zip(methods, names, strict=True)])
    grid = df.select("ID").distinct().crossJoin(df.select("TYPE").distinct())  # a grid of all pairs is the result asked for
    grid = grid.withColumn("_at", F.explode(F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<bigint>"))))
    out = grid.join(values, ["_at", "ID", "TYPE"], "left")
    if fillna_method:
        if fillna_method not in ("ffill", "bfill"):
            raise ValueError("fillna_method must be ffill, bfill or None")
        fill, w = (before, ordered(["ID", "TYPE"], "_at")) if fillna_method == "ffill" else (after, turned(["ID", "TYPE"], "_at"))
        out = out.withColumns({n: fill(F.col(n), w) for n in names})
    return out.select(moment(F.col("_at")).alias("TIME"), "ID", "TYPE", *names)


def long_to_wide(df: DataFrame, sep: str = "_", keys: Sequence[str] | None = None) -> DataFrame:
    """TIME and a column ``ID{sep}TYPE`` for each series; a time that a series has twice raises. ``keys`` saves the pass
    that finds the names."""
    keyed = df.select("TIME", F.concat_ws(sep, F.col("ID").cast("string"), F.col("TYPE").cast("string")).alias("key"), "VALUE")
    if keyed.groupBy("TIME", "key").count().where("count > 1").limit(1).count():
        raise ValueError("a series has more than one value at a time")
    keys = sorted(r.key for r in keyed.select("key").distinct().collect()) if keys is None else list(keys)
    return keyed.groupBy("TIME").pivot("key", keys).agg(F.first("VALUE"))


def wide_to_long(df: DataFrame, sep: str | None = "_", idvalue: str = "", timecol: str = "TIME") -> DataFrame:
    """TIME, ID, TYPE, VALUE: names split at the first separator; an empty ID becomes ``idvalue``; without a separator
    the name is the TYPE."""
    cols = [c for c in df.columns if c != timecol]

    def split(name: str) -> tuple[str, str]:
        if sep is None or sep not in name:
            return idvalue, name
        a, b = name.split(sep, 1)
        return a or idvalue, b

    names = F.create_map(*[x for c in cols for x in (F.lit(c), F.struct(F.lit(split(c)[0]).alias("ID"), F.lit(split(c)[1]).alias("TYPE")))])
    long = df.select(col(timecol).alias("TIME"), *[col(c).cast("double").alias(c) for c in cols]).unpivot("TIME", [col(c) for c in cols], "name", "VALUE")
    return long.withColumn("n", names[F.col("name")]).select("TIME", "n.ID", "n.TYPE", "VALUE")


def resampled(df: DataFrame, freq: str, cols: Sequence[str], time_col: str = "TIME", method: str = "mean", partition_by: Sequence[str] = ()) -> DataFrame:
    """Left-labelled bins from each series' first to last; empty bins have missing values."""
    step, by = duration(freq), list(partition_by)
    rows = df.withColumn("_at", rounded(micros(col(time_col)), step, "floor"))
    values = rows.groupBy(*by, "_at").agg(*[aggregated(method, col(c), col(time_col)).alias(c) for c in cols])
    grid = values.groupBy(*by).agg(F.explode(F.sequence(F.min("_at"), F.max("_at"), F.lit(step))).alias("_at"))
    out = grid.join(values, [*by, "_at"], "left")
    return out.select(*by, moment(F.col("_at")).alias(time_col), *[col(c) for c in cols])


def padded(df: DataFrame, freq: str, cols: Sequence[str], time_col: str = "TIME", limit: int = 5, partition_by: Sequence[str] = ()) -> DataFrame:
    """As-of values on a grid, carried over ``limit`` bins at most; bins with nothing are dropped."""
    grid = resampled(df, freq, cols, time_col, "last", partition_by)

    def filled(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        w = ordered(by, time_col).rowsBetween(-limit, 0)
        return rows.withColumns({c: F.last(col(c), ignorenulls=True).over(w) for c in cols})

    out = filled(grid, partition_by) if partition_by else by_rows(grid, time_col, limit, 0, filled)
    return out.dropna("all", subset=list(cols))


def label_dst(df: DataFrame, time_col: str, name: str = "dst") -> DataFrame:
    """``to_summertime`` or ``to_wintertime`` in the hour of a European clock change, else ``normal``."""
    t = col(time_col).cast("timestamp")
    sunday = (F.dayofmonth(t) >= 25) & (F.weekday(t) == 6) & (F.hour(t) == 2)
    return df.withColumn(name, F.when(sunday & (F.month(t) == 3), "to_summertime").when(sunday & (F.month(t) == 10), "to_wintertime").otherwise("normal"))


def average_winter_time(df: DataFrame, keys: Sequence[str], value: str = "VALUE", time_col: str = "TIME") -> DataFrame:
    """Rows that repeat in the hour that the clock repeats become one with the mean value; all others stay."""
    found = label_dst(df, time_col, "_dst")
    twice = found.where("_dst = 'to_wintertime'").groupBy(*keys).agg(F.avg(col(value)).alias(value))
    return found.where("_dst != 'to_wintertime'").select(*keys, col(value).cast("double").alias(value)).unionByName(twice)


def make_shifted_target(df: DataFrame, target: str, lags: Sequence[int], time_col: str | Sequence[str], use_diff_of_y: bool = False, newcol_prefix: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds later values of the target, or their differences to the current one, by number of rows."""
    if any(x < 0 or int(x) != x for x in lags):
        raise ValueError("lags must be whole numbers from 0")
    prefix = newcol_prefix or target
    if not partition_by and max(lags, default=0):
        return by_rows(df, time_col, 0, max(lags), lambda d, key: make_shifted_target(d, target, lags, time_col, use_diff_of_y, prefix, key))
    w = ordered(partition_by, time_col)
    ahead = lambda n: F.lead(col(target), n).over(w) if n else col(target)
    if use_diff_of_y:
        return df.withColumns({f"{prefix}_diff_{n}": ahead(n) - col(target) for n in lags})
    return df.withColumns({f"{prefix}_lead_{n}": ahead(n) for n in lags})


def make_differenced_target(df: DataFrame, target: str, lags: Sequence[int], time_col: str | Sequence[str], newcol_prefix: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Differences of later values to the current one."""
    return make_shifted_target(df, target, lags, time_col, True, newcol_prefix, partition_by)


def inverse_differenced_target(predictions: DataFrame, actual: DataFrame, keys: Sequence[str], cols: Sequence[str], target: str) -> DataFrame:
    """Predicted differences plus the current value; a row that one side lacks is missing."""
    joined = predictions.join(actual.select(*keys, col(target).alias("_y")), list(keys), "full_outer")
    return joined.select(*keys, *[(col(c) + F.col("_y")).alias(c) for c in cols])


def recurrent(df: DataFrame, cols: Sequence[str], window: int, time_col: str | Sequence[str], lookback: int = 1, remove_leading_nan: bool = False, partition_by: Sequence[str] = (), name: str = "window") -> DataFrame:
    """Adds an array of ``window`` arrays: the features of earlier rows, oldest first, ending ``lookback`` rows ago."""
    if not partition_by:
        late = F.col("_no") > window + lookback - 2 if remove_leading_nan else F.lit(True)
        return by_rows(df, time_col, window - 1 + lookback, 0, lambda d, key: recurrent(d, cols, window, time_col, lookback, False, key, name).where(late))
    w = ordered(partition_by, time_col)
    steps = [F.array(*[F.lag(col(c).cast("double"), n).over(w) if n else col(c).cast("double") for c in cols]) for n in range(window - 1 + lookback, lookback - 1, -1)]
    out = df.withColumn(name, F.array(*steps))
    if remove_leading_nan:
        out = out.withColumn("_row", F.row_number().over(w)).where(F.col("_row") > window + lookback - 1).drop("_row")
    return out
