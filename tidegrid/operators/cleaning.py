"""Value corrections, clipping, scaling, splits and checks of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import micros
from ..functions.names import col, group_of, numeric_columns
from ..functions import series
from ..functions.windows import before, interpolated, ordered, turned

METHODS = ("na", "value", "clip", "remove", "previous", "average")


def _corrected(df: DataFrame, column: str, wrong: Column, method: str, value: float | None, bound: Column, time_col: str | Sequence[str] | None, by: Sequence[str]) -> DataFrame:
    wrong = F.coalesce(wrong, F.lit(False))
    x = col(column)
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "remove":
        return df.where(~wrong)
    if method in ("previous", "average"):
        if time_col is None:
            raise ValueError(f"{method} needs time_col")
        time, kept = time_col if isinstance(time_col, str) else time_col[0], F.when(~wrong, x)
        if not by:
            out = series.carried(df, time_col, {"_filled": kept}) if method == "previous" else series.interpolated(df, "_filled", kept, time, time_col)
            return out.withColumn(column, F.when(x.isNotNull(), F.col("_filled"))).drop("_filled")
        w = ordered(by, time_col)
        filled = before(kept, w) if method == "previous" else interpolated(kept, micros(col(time)), w, turned(by, time_col))
        # What was missing before stays missing.
        return df.withColumn(column, F.when(x.isNotNull(), filled))
    new = {"na": F.lit(None), "value": F.lit(value), "clip": bound}[method]
    return df.withColumn(column, F.when(wrong, new).otherwise(x))


def correct_above_threshold(df: DataFrame, column: str, threshold: float = 1, method: str = "na", value: float | None = None, time_col=None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Corrects values above ``threshold`` (strictly): missing, a value, the threshold, the row removed, the previous
    good value, or linear between good neighbours by time."""
    return _corrected(df, column, col(column) > threshold, method, value, F.lit(threshold), time_col, partition_by)


def correct_below_threshold(df: DataFrame, column: str, threshold: float = 0, method: str = "na", value: float | None = None, time_col=None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Corrects values below ``threshold`` (strictly)."""
    return _corrected(df, column, col(column) < threshold, method, value, F.lit(threshold), time_col, partition_by)


def correct_outside_range(df: DataFrame, column: str, threshold: tuple[float, float] = (0, 1), method: str = "na", value: float | None = None, time_col=None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Corrects values outside ``threshold`` (strictly)."""
    low, high = threshold
    if not low < high:
        raise ValueError("the first threshold must be below the second")
    bound = F.when(col(column) > high, F.lit(high)).otherwise(F.lit(low))
    return _corrected(df, column, (col(column) < low) | (col(column) > high), method, value, bound, time_col, partition_by)


def limited(x: Column, low: float | None, high: float | None) -> Column:
    """``x`` between bounds; missing stays missing."""
    out = x if high is None else F.least(x, F.lit(high))
    out = out if low is None else F.greatest(out, F.lit(low))
    return F.when(x.isNotNull(), out)


def extremes(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column, in one pass."""
    row = df.agg(*[f(col(c)).alias(f"{i}_{k}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("b", F.max))]).first()
    return {c: (row[f"{i}_a"], row[f"{i}_b"]) for i, c in enumerate(cols)}


@dataclass
class ClipTransformer:
    """Clips columns to given bounds, or to those of the data it was fitted on."""

    cols: Sequence[str] | None = None
    min_value: float | None = None
    max_value: float | None = None
    fitted: dict[str, tuple[float | None, float | None]] | None = None

    def fit(self, df: DataFrame) -> ClipTransformer:
        """Takes missing bounds from ``df``."""
        cols = list(self.cols or numeric_columns(df))
        seen = extremes(df, cols) if self.min_value is None or self.max_value is None else {}
        self.fitted = {c: (self.min_value if self.min_value is not None else seen[c][0], self.max_value if self.max_value is not None else seen[c][1]) for c in cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """The clipped table."""
        if self.fitted is None:
            raise ValueError("fit first")
        return df.withColumns({c: limited(col(c), *b) for c, b in self.fitted.items()})

    def to_dict(self) -> dict:
        """State as plain JSON types."""
        return asdict(self)


def datetime_train_test_split(*frames: DataFrame, datetime: str, datecol: str) -> list[DataFrame]:
    """Each table in two: before ``datetime``, and from it on."""
    at = F.lit(datetime).cast("timestamp")
    return [part for df in frames for part in (df.where(col(datecol).cast("timestamp") < at), df.where(col(datecol).cast("timestamp") >= at))]


def scale_train_test(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame, dict[str, tuple[float, float]]]:
    """Both tables scaled by the mean and population deviation of ``train`` (1 where that is 0)."""
    row = train.agg(*[f(col(c)).alias(f"{i}_{k}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    stats = {c: (row[f"{i}_m"], row[f"{i}_s"] or 1.0) for i, c in enumerate(cols)}
    scale = lambda df: df.withColumns({c: (col(c) - m) / s for c, (m, s) in stats.items()})
    return scale(train), scale(test), stats


def unscaled(df: DataFrame, stats: Mapping[str, tuple[float, float]], column_of: Mapping[str, str]) -> DataFrame:
    """Scaling undone: ``column_of`` names the scaled column each prediction belongs to."""
    return df.withColumns({c: col(c) * stats[k][1] + stats[k][0] for c, k in column_of.items()})


def remove_target_nan(df: DataFrame, target: Sequence[str], features: Sequence[str] = (), use_x: bool = False) -> DataFrame:
    """Rows whose targets (and features, if asked for) are all there."""
    return df.dropna(subset=[*target, *(features if use_x else ())])


def remove_until_first_value(df: DataFrame, features: Sequence[str], time_col: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rows from the first complete one on, by series; a series without a complete row has none."""
    full = F.lit(True)
    for c in features:
        full = full & col(c).isNotNull()
    known = F.min(F.when(full, micros(col(time_col))))
    if not partition_by:
        return df.where(micros(col(time_col)) >= F.lit(df.agg(known).first()[0]).cast("long"))
    first = known.over(Window.partitionBy(*partition_by))
    return df.withColumn("_first", first).where(micros(col(time_col)) >= F.col("_first")).drop("_first")


def contains_nans(df: DataFrame) -> bool:
    """True if any value is missing."""
    hit = F.lit(False)
    for name, kind in df.dtypes:
        hit = hit | col(name).isNull() | (F.isnan(col(name)) if kind in ("double", "float") else F.lit(False))
    return bool(df.where(hit).limit(1).count())


def assert_contains_nans(df: DataFrame, msg: str = "Data contains missing values") -> None:
    """Raises if any value is missing."""
    if contains_nans(df):
        raise AssertionError(msg)


def make_df_monotonic(df: DataFrame, cols: Sequence[str], aggregate_func: str = "max") -> DataFrame:
    """Running largest or smallest value over the columns, left to right."""
    f = {"max": F.greatest, "min": F.least}[aggregate_func]
    out = {}
    for i, c in enumerate(cols):
        out[c] = f(*[col(x) for x in cols[: i + 1]]) if i else col(c)
    return df.withColumns(out)


def sum_grouped_columns(df: DataFrame, cols: Sequence[str], sep: str = "#", skipna: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """One column by name group: the sum of its columns; a missing value counts 0 or makes the sum missing."""
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault(group_of(c, sep), []).append(c)
    total = lambda cs: sum((F.coalesce(col(c), F.lit(0)) if skipna else col(c) for c in cs[1:]), F.coalesce(col(cs[0]), F.lit(0)) if skipna else col(cs[0]))
    return df.select(*[col(k) for k in keep], *[total(cs).alias(g) for g, cs in groups.items()])


def spacing(df: DataFrame, time_col: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """By series: rows, distinct steps, smallest step in microseconds."""
    step = lambda d, by: d.withColumn("step", micros(col(time_col)) - F.lag(micros(col(time_col))).over(ordered(by, time_col)))
    rows = df.select(*[col(c) for c in (*partition_by, time_col)])
    rows = step(rows, partition_by) if partition_by else series.by_rows(rows, time_col, 1, 0, step)
    return rows.groupBy(*partition_by).agg(F.count("*").alias("n"), F.count_distinct("step").alias("steps"), F.min("step").alias("least"))


def has_strictly_increasing_index(df: DataFrame, time_col: str, linear: bool = True, partition_by: Sequence[str] = ()) -> bool:
    """True if times never repeat in any series and, if ``linear``, have one step (a single row has none)."""
    bad = (F.col("least") <= 0) if not linear else (F.col("least").isNull() | (F.col("least") <= 0) | (F.col("steps") != 1))
    return not spacing(df, time_col, partition_by).where(F.coalesce(bad, F.lit(False))).limit(1).count()
