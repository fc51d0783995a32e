"""Plot-ready tables: what charts of forecasts, incidents and validation show, without the drawing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.series import Frame, Rolling, by_rows, framed
from ..functions.windows import ordered
from ..operators.exploration import lag_correlation
from ..operators.metrics import _curve, performance
from ..operators.reshaping import resampled


def performance_evaluation_fixed_predict_ahead(train: DataFrame, test: DataFrame, y_true: str, y_pred: str, time_col: str, resolutions: Sequence[str] = ("native",), metric: str = "R2", train_avg_func: Callable[[Column], Column] = F.avg) -> DataFrame:
    """``resolution, split`` and the metric: predictions and values averaged to each resolution, against the training mean
    (or another aggregate of the training values)."""
    out = None
    for r in resolutions:
        parts = {k: df if r == "native" else resampled(df, r, [y_true, y_pred], time_col) for k, df in (("train", train), ("test", test))}
        mean = parts["train"].agg(train_avg_func(col(y_true))).first()[0]
        for k, df in parts.items():
            row = performance(df, y_true, y_pred, mean, metric).select(F.lit(r).alias("resolution"), F.lit(k).alias("split"), metric)
            out = row if out is None else out.unionByName(row)
    return out


def best_resolution(scores: DataFrame, metric: str = "R2", split: str = "test") -> str:
    """The resolution with the best score of :func:`performance_evaluation_fixed_predict_ahead`."""
    best = F.max_by if metric == "R2" else F.min_by
    return scores.where(F.col("split") == split).agg(best("resolution", metric)).first()[0]


def quantile_plot(df: DataFrame, y_true: str, time_col: str, lead: int, quantiles: Sequence[float], outlier_min_q: int | None = None, outlier_window: int = 1, outlier_limit: int | None = None, resample: str | None = None, ignore_value: float | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Values, predictions moved to the time they are for, the interval's bounds, and outliers: at least
    ``outlier_limit`` of ``outlier_window`` rows on or outside the bounds of the ``outlier_min_q``-th widest interval."""
    names = {q: f"predict_lead_{lead}_q_{q}" for q in sorted(quantiles)}
    mean = f"predict_lead_{lead}_mean"
    keys, moved = list(partition_by), [c for c in [*names.values(), mean] if c in df.columns]
    spread = lambda d, rows, run: run(d, keys) if keys else by_rows(d, time_col, rows, 0, run)
    out = df.select(*[col(c) for c in (*keys, time_col, y_true, *moved)])
    if lead:
        out = spread(out, lead, lambda d, by: d.withColumns({c: F.lag(col(c), lead).over(ordered(by, time_col)) for c in moved}))
    if ignore_value is not None:
        out = out.withColumn(y_true, F.when(col(y_true) != ignore_value, col(y_true)))
    if resample:
        out = resampled(out, resample, [y_true, *moved], time_col, partition_by=keys)
    if outlier_min_q is None:
        return out
    qs = sorted(names)
    low, high = names[qs[len(qs) // 2 - outlier_min_q]], names[qs[-(len(qs) // 2) - 1 + outlier_min_q]]
    flag = F.coalesce(((col(y_true) >= col(high)) | (col(y_true) <= col(low))).cast("int"), F.lit(0))
    found = lambda d, by: d.withColumn("outlier", F.sum("_flag").over(ordered(by, time_col).rowsBetween(-(outlier_window - 1), 0)) >= (outlier_limit or outlier_window))
    return spread(out.withColumn("_flag", flag), outlier_window - 1, found).drop("_flag")


def incident_heatmap(df: DataFrame, row: str, value: str, time_col: str, resolution: str = "1 day", normalize: bool = False) -> DataFrame:
    """``row, period, value``: sums by row and period, or shares of the row's largest."""
    out = df.groupBy(col(row).alias("row"), F.window(col(time_col).cast("timestamp"), resolution).alias("w")).agg(F.sum(col(value)).alias("value")).select("row", F.col("w.start").alias("period"), "value")
    return out.withColumn("value", F.col("value") / F.max("value").over(Window.partitionBy("row"))) if normalize else out


def precision_recall_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """``threshold, precision, recall, average_precision``."""
    found = _curve(df, label, score)
    precision, whole = F.col("hits") / F.col("marked"), F.nullif("whole", F.lit(0))
    mean = F.broadcast(found.agg(F.sum(precision * F.col("p") / whole).alias("average_precision")))  # one row
    return found.select("threshold", precision.alias("precision"), (F.col("hits") / whole).alias("recall")).crossJoin(mean)


def lag_correlation_points(df: DataFrame, target: str, time_col: str, lag: int = 12) -> DataFrame:
    """``feature, LAG, correlation``, and whether the lag is the feature's strongest."""
    wide = lag_correlation(df, target, time_col, lag)
    long = wide.unpivot("LAG", [c for c in wide.columns if c != "LAG"], "feature", "correlation")
    best = F.max_by("LAG", F.abs("correlation")).over(Window.partitionBy("feature"))
    return long.withColumn("strongest", F.col("LAG") == best)


def removal_points(df: DataFrame, column: str, flag: str, time_col: str, window: int = 60, partition_by: Sequence[str] = ()) -> DataFrame:
    """Value, centred rolling median, and whether a validator removes it, by series."""
    frame, keys = Frame(window // 2, (window - 1) // 2), list(partition_by)
    rows = df.select(*[col(c) for c in keys], col(time_col), col(column).alias("value"), col(flag).alias("removed"))
    medians = lambda d, by: framed(d, by, time_col, [Rolling("median", "value", "median", frame)])
    out = medians(rows, keys) if keys else by_rows(rows, time_col, frame.before, frame.after, medians)
    return out.select(*[col(c) for c in keys], col(time_col), "value", "median", "removed")


def score_table(scores: DataFrame) -> DataFrame:
    """Benchmark scores with one row for each lead and method."""
    return scores.unpivot("lead", [c for c in scores.columns if c != "lead"], "method", "score")
