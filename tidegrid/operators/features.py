"""Features of time series: rolling windows, lags, calendar parts, drought indices, and a search for good windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.durations import duration, micros
from ..functions.names import col, numeric_columns
from ..functions.order import bucket_of, cuts
from ..functions.series import LONG, SPANNED, Frame, Rolling, by_rows, by_span, carried, framed, numbered, spanned
from ..functions.tables import persisted, scope
from ..functions.windows import last_rows, last_span, ordered

SIMPLE = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "var": F.var_samp, "std": F.stddev_samp}
ARRAYS = ("fourier", "cwt", "nfft")
#: Kinds that long frames don't redo for each row.
MOVING = (*SIMPLE, "median", "trimmean", "numpos")
TYPES = ("lag", "diff", *SIMPLE, "median", "trimmean", "skew", "kurt", "numpos", "ewm", *ARRAYS)


def _moments(x: Column, w: WindowSpec, kind: str) -> Column:
    """Bias-adjusted skewness or excess kurtosis; a constant window has 0 or -3."""
    n = F.count(x).over(w).cast("double")
    flat = F.min(x).over(w) == F.max(x).over(w)
    if kind == "skew":
        return F.when(n >= 3, F.when(flat, F.lit(0.0)).otherwise(F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / (n - 2)))
    return F.when(n >= 4, F.when(flat, F.lit(-3.0)).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6)))


def _trimmed(x: Column, w: WindowSpec, proportion: float) -> Column:
    values = F.sort_array(F.collect_list(x).over(w))
    cut = F.floor(F.size(values) * F.lit(proportion)).cast("int")
    left = F.size(values) - 2 * cut
    return F.aggregate(F.slice(values, cut + 1, F.greatest(left, F.lit(0))), F.lit(0.0), lambda a, b: a + b) / F.nullif(left, F.lit(0))


def rolled(x: Column, kind: str, w: WindowSpec, least: Column | int, rows: Column, proportion: float = 0.1) -> Column:
    """One rolling aggregate over ``w``; missing below ``least`` values."""
    n = F.count(x).over(w)
    if kind in SIMPLE:
        return F.when(n >= least, SIMPLE[kind](x).over(w))
    if kind == "median":
        return F.when(n >= least, F.percentile(x, F.lit(0.5)).over(w))
    if kind == "numpos":
        return F.when(rows >= least, F.sum(F.coalesce((x > 0).cast("int"), F.lit(0))).over(w))
    if kind in ("skew", "kurt"):
        return F.when(n >= least, _moments(x, w, kind))
    if kind == "trimmean":
        return F.when(n >= least, _trimmed(x, w, proportion))
    raise ValueError(f"unknown rolling type {kind!r}")


def spectrum(values: np.ndarray) -> np.ndarray:
    """Magnitudes of the Fourier coefficients 1 to n // 2."""
    return np.abs(np.fft.fft(values))[1 : len(values) // 2 + 1]


def ricker(values: np.ndarray, width: float) -> np.ndarray:
    """Convolution with a ricker wavelet of this width, as long as the window."""
    n = len(values)
    t = np.arange(n) - (n - 1) / 2
    wave = 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - t**2 / width**2) * np.exp(-(t**2) / (2 * width**2))
    return np.convolve(values, wave, mode="same")


def _weighted(values: Sequence[Column], weights: np.ndarray) -> Column:
    """A sum of columns with fixed weights."""
    return sum((v * float(w) for v, w in zip(values[1:], weights[1:], strict=True)), values[0] * float(weights[0]))


def linear_forms(kind: str, values: Sequence[Column], width: float) -> list[Column]:
    """Magnitudes of Fourier coefficients, or wavelet sums, of as many columns (oldest first) as fixed linear forms;
    missing if a value is."""
    n = len(values)
    if kind == "cwt":
        return [_weighted(values, row) for row in np.array([ricker(e, width) for e in np.eye(n)]).T]
    turns = 2 * np.pi * np.outer(np.arange(1, n // 2 + 1), np.arange(n)) / n
    return [F.sqrt(F.pow(_weighted(values, np.cos(t)), F.lit(2.0)) + F.pow(_weighted(values, np.sin(t)), F.lit(2.0))) for t in turns]


@dataclass
class BuildRollingFeatures:
    """Rolling features of each column and window, shifted by ``lookback`` rows.

    ``window_size``: numbers of rows (a full window is needed), or spans such as ``"1h"`` (one value is enough, the window
    is ``(t - span, t]``). ``deviation`` sets the current value against the feature: ``subtract`` or ``divide``; ``undefined`` is what
    0/0 gives there (None: missing).
    """

    time_col: str | Sequence[str]
    rolling_type: str = "mean"
    lookback: int = 1
    window_size: Sequence[int | str] | int | str = 1
    cols: Sequence[str] | None = None
    deviation: str | None = None
    alpha: Sequence[float] | float = 0.5
    width: float = 1
    nfft_ncol: int = 10
    proportiontocut: float = 0.1
    keep_original: bool = True
    add_lookback_to_colname: bool = False
    partition_by: Sequence[str] = ()
    made: list[str] = field(default_factory=list)
    undefined: float | None = None

    def _check(self) -> None:
        if self.rolling_type not in TYPES:
            raise ValueError(f"rolling_type must be one of {TYPES}")
        if self.lookback < 0:
            raise ValueError("lookback must not be negative")
        if self.deviation not in (None, "subtract", "divide"):
            raise ValueError("deviation must be subtract, divide or None")
        if self.deviation and self.rolling_type in ("fourier", "cwt"):
            raise ValueError("no deviation from an array")
        if self.rolling_type == "nfft" and any(isinstance(w, int) for w in self._windows()):
            raise ValueError("nfft needs time windows")

    def _windows(self) -> list[int | str]:
        return [self.window_size] if isinstance(self.window_size, (int, str)) else list(self.window_size)

    def _time(self) -> str:
        return self.time_col if isinstance(self.time_col, str) else self.time_col[0]

    def _deviated(self, x: Column, y: Column) -> Column:
        if self.deviation == "subtract":
            return x - y
        if self.deviation == "divide":
            inf = x * F.lit(float("inf"))  # as doubles are divided: NaN, that of the machine, for 0/0
            if self.undefined is None or not math.isnan(self.undefined):
                inf = F.when(x == 0, F.lit(self.undefined).cast("double")).otherwise(inf)
            return F.when(y == 0, inf).otherwise(x / F.nullif(y, F.lit(0.0)))
        return y

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the features; with ``keep_original=False`` without the columns they are made from."""
        self._check()
        cols = list(self.cols) if self.cols is not None else numeric_columns(df, (self._time(), *self.partition_by))
        tail = f"_lookback_{self.lookback}" if self.add_lookback_to_colname else ""
        spans = [duration(n) for n in self._windows() if isinstance(n, str)]
        if self.rolling_type in ("lag", "diff", "fourier", "cwt") and spans:
            raise ValueError(f"{self.rolling_type} needs numbers of rows")
        if self.rolling_type == "ewm":
            alphas = [self.alpha] if isinstance(self.alpha, (int, float)) else list(self.alpha)
            out = self._ewm(df, cols, alphas)
        else:
            steps = (self._arrays, self._shifted) if self.rolling_type in ARRAYS else (self._raw, self._final)
            reach = max((n for n in self._windows() if isinstance(n, int)), default=1)
            if self.partition_by:
                out = steps[1](steps[0](df, self.partition_by, cols, tail), self.partition_by, cols, tail)
            elif spans:
                # What spans reach lies in blocks of time, what the shift reaches in blocks of rows.
                out = by_rows(df, self.time_col, reach, 0, lambda d, by: steps[0](d, by, cols, tail, int)) if len(spans) < len(self._windows()) else df
                if self.rolling_type in SPANNED:
                    least = 2 if self.rolling_type in ("var", "std") else 1
                    out = spanned(out, self._time(), [Rolling(f"{c}#{self.rolling_type}_{n}{tail}", c, self.rolling_type, Frame(duration(n) - 1, 0, True), least) for c in cols for n in self._windows() if isinstance(n, str)])
                else:
                    out = by_span(out, self._time(), max(spans) - 1, 0, lambda d, by: steps[0](d, by, cols, tail, str))
                out = by_rows(out, self.time_col, self.lookback, 0, lambda d, by: steps[1](d, by, cols, tail)) if self.lookback else steps[1](out, [], cols, tail)
            else:
                out = by_rows(df, self.time_col, reach + self.lookback, 0, lambda d, by: steps[1](steps[0](d, by, cols, tail), by, cols, tail))
            self.made = self._names(cols, tail)
        return out if self.keep_original else out.drop(*cols)

    def _names(self, cols: Sequence[str], tail: str) -> list[str]:
        """The new columns in order."""
        start, out = 0 if self.rolling_type == "cwt" else 1, []
        for c in cols:
            for n in self._windows():
                many = {"fourier": lambda n: n // 2, "cwt": lambda n: n, "nfft": lambda n: self.nfft_ncol}.get(self.rolling_type)
                out += [f"{c}#{self.rolling_type}_{n}_{i + start}{tail}" for i in range(many(n))] if many else [f"{c}#{self.rolling_type}_{n}{tail}"]
        return out

    def _raw(self, df: DataFrame, by: Sequence[str], cols: Sequence[str], tail: str, only: type | tuple = (int, str)) -> DataFrame:
        """Features before they are shifted, of windows by rows, spans or both."""
        o, raw, long = ordered(by, self.time_col), {}, []
        for c in cols:
            x = col(c).cast("double")
            for n in (n for n in self._windows() if isinstance(n, only)):
                name, least = f"{c}#{self.rolling_type}_{n}{tail}", n if isinstance(n, int) else 2 if self.rolling_type in ("var", "std") else 1
                if self.rolling_type == "lag":
                    raw[name] = F.lag(x, n).over(o) if n else x
                elif self.rolling_type == "diff":
                    raw[name] = x - F.lag(x, n).over(o)
                elif self.rolling_type in MOVING and (isinstance(n, str) or n > LONG):
                    frame = Frame(n - 1, 0) if isinstance(n, int) else Frame(duration(n) - 1, 0, True)
                    long.append(Rolling(name, c, self.rolling_type, frame, least, self.proportiontocut))
                else:
                    w = last_rows(by, self.time_col, n) if isinstance(n, int) else last_span(by, self._time(), duration(n))
                    raw[name] = rolled(x, self.rolling_type, w, least, F.count(F.lit(1)).over(w), self.proportiontocut)
        out = df.withColumns(raw) if raw else df
        return framed(out, by, self.time_col, long, self._time() if any(r.frame.span for r in long) else None) if long else out

    def _final(self, df: DataFrame, by: Sequence[str], cols: Sequence[str], tail: str) -> DataFrame:
        """Features shifted and set against the current value."""
        o = ordered(by, self.time_col)
        shift = lambda c: F.lag(c, self.lookback).over(o) if self.lookback else c
        return df.withColumns({n: self._deviated(col(c).cast("double"), shift(col(n))) for c in cols for n in self._names([c], tail)})

    def _shifted(self, df: DataFrame, by: Sequence[str], cols: Sequence[str], tail: str) -> DataFrame:
        """Arrays' places shifted; those of row windows are already."""
        o, spans = ordered(by, self.time_col), self.rolling_type == "nfft"
        return df.withColumns({n: F.lag(col(n), self.lookback).over(o) for n in self._names(cols, tail)}) if spans and self.lookback else df

    def _arrays(self, out: DataFrame, by: Sequence[str], cols: Sequence[str], tail: str, only: type | tuple = (int, str)) -> DataFrame:
        o = ordered(by, self.time_col)
        for c in cols:
            for n in self._windows():
                first = 0 if self.rolling_type == "cwt" else 1
                if isinstance(n, int):
                    x = col(c).cast("double")
                    past = [f"_x{k}" for k in range(self.lookback + n - 1, self.lookback - 1, -1)]
                    out = out.withColumns({f"_x{k}": F.lag(x, k).over(o) if k else x for k in range(self.lookback, self.lookback + n)})
                    forms = linear_forms(self.rolling_type, [F.col(p) for p in past], self.width)
                    names = [f"{c}#{self.rolling_type}_{n}_{i + first}{tail}" for i in range(len(forms))]  # already shifted
                    out = out.withColumns(dict(zip(names, forms, strict=True))).drop(*past)
                else:
                    out = self._uneven(out, by, c, n, [f"{c}#{self.rolling_type}_{n}_{i + first}{tail}" for i in range(self.nfft_ncol)])
        return out

    def _uneven(self, df: DataFrame, by: Sequence[str], c: str, n: str, names: Sequence[str]) -> DataFrame:
        """Magnitudes of the non-uniform Fourier sums ``1, 2, ...`` of a span, by rolling sums: a magnitude doesn't depend on where
        the turn of the times begins, so each row's share can be worked out once. An odd number of rows loses the first; sums from
        half the number of rows on are 0, as are all of five rows or fewer; missing where a value of the span is."""
        span, x = duration(n), col(c).cast("double")
        turn = F.pmod(micros(col(self._time())), F.lit(span)) / F.lit(float(span)) * (2 * math.pi)
        parts = {f"_{f}{k}": x * g(turn * k) for k in range(1, len(names) + 1) for f, g in (("c", F.cos), ("s", F.sin))}
        frame = Frame(span - 1, 0, True)
        wanted = [Rolling(f"_{kind}{p}", p, kind, frame) for p in parts for kind in ("sum", "first")]
        wanted += [Rolling("_count", "_c1", "count", frame), Rolling("_rows", "_c1", "rows", frame)]
        out = framed(df.withColumns(parts), by, self.time_col, wanted, self._time())
        odd, half = F.col("_count") % 2, F.floor(F.col("_count") / 2)
        side = lambda p: F.pow(F.col(f"_sum{p}") - odd * F.col(f"_first{p}"), F.lit(2.0))
        new = {m: F.when(F.col("_count") == F.col("_rows"), F.when((half * 2 > 5) & (k < half), F.sqrt(side(f"_c{k}") + side(f"_s{k}"))).otherwise(0.0)) for k, m in enumerate(names, 1)}
        return out.withColumns(new).drop(*parts, *[w.name for w in wanted])



    def _ewm(self, df: DataFrame, cols: Sequence[str], alphas: Sequence[float]) -> DataFrame:
        """Means with weights that fall by ``1 - alpha`` a row: sums inside blocks of rows, and what the block before carries
        over. Blocks are so long that anything older weighs less than 1e-200 of a value, which a double can't show, and so
        short that the reciprocal weights inside stay in range. Missing values hold the last mean."""
        names = {f"{c}#ewm_{a}": (c, a) for c in cols for a in alphas}
        by = [col(k) for k in self.partition_by]
        o = ordered(by_names := list(self.partition_by), self.time_col)
        out = df.withColumn("_no", F.row_number().over(o) - 1) if by else numbered(df, self.time_col)[0]
        for n, (c, a) in names.items():
            q, x = 1.0 - a, col(c).cast("double")
            if q <= 0:
                out = out.withColumn(n, x)
                continue
            size = math.ceil(200 / -math.log10(q))
            out = out.withColumn("_block", F.floor(F.col("_no") / size))
            place = F.col("_no") - F.col("_block") * size
            weight = F.pow(F.lit(1 / q), place.cast("double"))
            inside = Window.partitionBy(*by, "_block").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumns({m: F.coalesce(F.sum(F.when(x.isNotNull(), e * weight)).over(inside), F.lit(0.0)) / weight for m, e in (("_s", x), ("_w", F.lit(1.0)))})
            # What the block before hands on; keys are compared null-safely.
            ends = out.where(place == size - 1).select(*[k.alias(f"_k{i}") for i, k in enumerate(by)], (F.col("_block") + 1).alias("_b"), F.col("_s").alias("_s0"), F.col("_w").alias("_w0"))
            match = F.col("_block") == F.col("_b")
            for i, k in enumerate(by):
                match = match & k.eqNullSafe(F.col(f"_k{i}"))
            out = out.join(ends, match, "left").drop(*[f"_k{i}" for i in range(len(by))], "_b")
            carry = [F.coalesce(F.col(m), F.lit(0.0)) * q / weight for m in ("_s0", "_w0")]
            out = out.withColumns({"_s": F.col("_s") + carry[0], "_w": F.col("_w") + carry[1]})
            out = out.withColumn(n, F.when(x.isNotNull(), F.col("_s") / F.col("_w"))).drop("_block", "_s", "_w", "_s0", "_w0")
        out, self.made = out.drop("_no"), list(names)

        def final(d: DataFrame, key: Sequence[str]) -> DataFrame:
            shift = lambda c: F.lag(c, self.lookback).over(ordered(key, self.time_col)) if self.lookback else c
            return d.withColumns({n: self._deviated(col(c).cast("double"), shift(col(n))) for n, (c, _) in names.items()})

        if by:
            return final(out.withColumns({n: F.last(col(n), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0)) for n in names}), by_names)
        filled = carried(out, self.time_col, {f"_l{i}": col(n) for i, n in enumerate(names)})
        filled = filled.withColumns({n: F.col(f"_l{i}") for i, n in enumerate(names)}).drop(*[f"_l{i}" for i in range(len(names))])
        return by_rows(filled, self.time_col, self.lookback, 0, final) if self.lookback else final(filled, [])


def range_lag_column(df: DataFrame, column: str, range_shift: int | tuple[int, int], time_col: str | Sequence[str], partition_by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """The largest value of the rows from ``a`` to ``b`` ahead (negative: back); nothing counts as 0. Where ``a`` is
    negative, the first ``-a`` rows look back over ``b - a + 1`` rows instead."""
    a, b = sorted((range_shift, range_shift) if isinstance(range_shift, int) else range_shift)

    def ranged(d: DataFrame, by: Sequence[str]) -> DataFrame:
        o = ordered(by, time_col)
        value = F.coalesce(F.max(col(column)).over(o.rowsBetween(a, b)), F.lit(0))
        if a < 0:
            head = F.coalesce(F.max(col(column)).over(o.rowsBetween(-(b - a), 0)), F.lit(0))
            value = F.when(F.row_number().over(o) <= -a if partition_by else F.col("_no") < -a, head).otherwise(value)
        return d.withColumn(name or column, value)

    return ranged(df, partition_by) if partition_by else by_rows(df, time_col, max(0, -a, b - a), max(0, b), ranged)


#: Largest values of calendar parts, for cyclical and one-hot coding.
CYCLICAL_MAXES = {"day": 31, "dayofweek": 7, "weekday": 7, "dayofyear": 366, "hour": 24, "microsecond": 1_000_000, "minute": 60, "month": 12, "quarter": 4, "second": 60, "week": 53, "secondofday": 86_400}
PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "quarter": F.quarter, "dayofyear": F.dayofyear,
    "second": F.second, "dayofweek": F.weekday, "weekday": F.weekday, "week": F.weekofyear,
    "secondofday": lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t), "microsecond": lambda t: (F.unix_micros(t) % 1_000_000).cast("int"),
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)), "is_month_end": lambda t: F.to_date(t) == F.last_day(t), "is_month_start": lambda t: F.dayofmonth(t) == 1,
    "is_quarter_start": lambda t: (F.dayofmonth(t) == 1) & F.month(t).isin(1, 4, 7, 10), "is_quarter_end": lambda t: (F.to_date(t) == F.last_day(t)) & F.month(t).isin(3, 6, 9, 12),
    "is_year_start": lambda t: F.dayofyear(t) == 1, "is_year_end": lambda t: (F.month(t) == 12) & (F.dayofmonth(t) == 31),
    "is_leap_year": lambda t: F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31))) == 366,
}


def local_time(time: Column, timezone: str | None) -> Column:
    """Times (in UTC) as wall-clock times of a zone."""
    t = time.cast("timestamp")
    return t if timezone is None else F.from_utc_timestamp(t, timezone)


def recode_cyclical_features(df: DataFrame, cols: Sequence[str], maxes: Mapping[str, float], mins: Mapping[str, float] | None = None, remove_categorical: bool = True) -> DataFrame:
    """Sine and cosine of each column's place in its cycle."""
    mins, out = mins or {}, {}
    for c in cols:
        low, high = mins.get(c, 0), maxes[c]
        if not low < high:
            raise ValueError(f"{c}: the smallest value must be below the largest")
        angle = (col(c) - low) / (high - low) * (2 * math.pi)
        out |= {f"{c}_sin": F.sin(angle), f"{c}_cos": F.cos(angle)}
    out = df.withColumns(out)
    return out.drop(*cols) if remove_categorical else out


def recode_onehot_features(df: DataFrame, cols: Sequence[str], maxes: Mapping[str, int], mins: Mapping[str, int] | None = None, remove_categorical: bool = True, fixed: bool = False) -> DataFrame:
    """A 0/1 column for each value from the smallest up to (not with) the largest, and for other values that occur
    (one pass finds them, unless ``fixed``); names are in text order."""
    mins, new = mins or {}, {}
    seen = {} if fixed else df.agg(*[F.sort_array(F.collect_set(col(c).cast("int"))).alias(c) for c in cols]).first().asDict()
    for c in cols:
        values = set(range(mins.get(c, 0), maxes[c])) | set(seen.get(c) or ())
        new |= {f"{c}_{v}": F.coalesce((col(c) == v).cast("int"), F.lit(0)) for v in sorted(values, key=str)}
    out = df.withColumns(new)
    return out.drop(*cols) if remove_categorical else out


def decompose_datetime(df: DataFrame, column: str = "TIME", components: Sequence[str] = (), cyclicals: Sequence[str] = (), onehots: Sequence[str] = (), remove_categorical: bool = True, keep_original: bool = True, cyclical_maxes: Mapping[str, int] | None = None, cyclical_mins: Mapping[str, int] | None = None, timezone: str | None = None, fixed_onehots: bool = False) -> DataFrame:
    """Calendar parts of a time column as ``{column}_{part}``, some of them cyclical or one-hot."""
    if set(cyclicals) & set(onehots):
        raise ValueError("a part can't be both cyclical and one-hot")
    wanted = list(dict.fromkeys([*components, *cyclicals, *onehots]))
    for p in wanted:
        if p not in PARTS:
            raise NotImplementedError(f"unknown part {p!r}")
    t = local_time(col(column), timezone)
    maxes = {f"{column}_{k}": v for k, v in (CYCLICAL_MAXES | dict(cyclical_maxes or {})).items()}
    mins = {f"{column}_{k}": v for k, v in (cyclical_mins or {}).items()}
    out = df.withColumns({f"{column}_{p}": PARTS[p](t) for p in wanted})
    if cyclicals:
        out = recode_cyclical_features(out, [f"{column}_{p}" for p in cyclicals], maxes, mins, remove_categorical)
    if onehots:
        out = recode_onehot_features(out, [f"{column}_{p}" for p in onehots], maxes, mins, remove_categorical, fixed_onehots)
    return out if keep_original else out.drop(column)


#: Time features with fixed domains: name, smallest and largest value, and expression.
TIME_FEATURES: dict[str, tuple[int, int, Callable[[Column], Column]]] = {
    "second_of_minute": (0, 59, F.second), "second_of_hour": (0, 3599, lambda t: F.minute(t) * 60 + F.second(t)), "second_of_day": (0, 86_399, PARTS["secondofday"]),
    "minute_of_hour": (0, 59, F.minute), "minute_of_day": (0, 1439, lambda t: F.hour(t) * 60 + F.minute(t)), "hour_of_day": (0, 23, F.hour), "hour_of_week": (0, 167, lambda t: F.weekday(t) * 24 + F.hour(t)),
    "day_of_week": (1, 7, lambda t: F.weekday(t) + 1), "day_of_month": (1, 31, F.dayofmonth), "day_of_year": (1, 366, F.dayofyear), "week_of_year": (1, 53, F.weekofyear), "month_of_year": (1, 12, F.month),
}


@dataclass
class SimpleFeatureEngineer:
    """Rolling features ``(column, method, window)`` without a shift, and time features ``(name, "cyclical" or "onehot")``."""

    time_col: str
    rolling_features: Sequence[tuple[str, str, int | str]] = ()
    time_features: Sequence[tuple[str, str]] = ()
    timezone: str | None = None
    drop_first: bool = True
    keep_original: bool = False
    partition_by: Sequence[str] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        """The features beside the keys and the time, or beside all columns."""
        new: dict[str, Column] = {}
        for c, method, n in self.rolling_features:
            x = col(c).cast("double")
            if method == "lag":
                new[f"{c}_lag_{n}"] = F.lag(x, n).over(ordered(self.partition_by, self.time_col)) if n else x
                continue
            w = last_rows(self.partition_by, self.time_col, n) if isinstance(n, int) else last_span(self.partition_by, self.time_col, duration(n))
            new[f"{c}_{method}_{n}"] = rolled(x, method, w, n if isinstance(n, int) else 2 if method in ("var", "std") else 1, F.count(F.lit(1)).over(w))
        t = local_time(col(self.time_col), self.timezone)
        for name, how in self.time_features:
            low, high, part = TIME_FEATURES[name]
            if how == "cyclical":
                angle = (part(t) - low) / F.lit(high - low + 1) * (2 * math.pi)
                new |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
            elif how == "onehot":
                new |= {f"{name}_{v}": (part(t) == v).cast("int") for v in range(low + self.drop_first, high + 1)}
            else:
                raise ValueError("a time feature is cyclical or onehot")
        out = df.withColumns(new)
        return out if self.keep_original else out.select(*self.partition_by, self.time_col, *[col(c) for c in new])


def identity_features(df: DataFrame, numeric_only: bool = True) -> DataFrame:
    """The numeric columns, or all."""
    return df.select(*[col(c) for c in numeric_columns(df)]) if numeric_only else df


@dataclass
class SPEITransformer:
    """Standardised indices: a rolling mean against its mean and deviation on the same day of other years.

    ``metric``: SPI (precipitation) or SPEI (precipitation less evaporation). ``partition_by``: stations, each with a climate of
    its own; rows with a null in these have no index.
    """

    metric: str = "SPEI"
    window: str = "30D"
    smoothing: bool = True
    min_years: int = 30
    partition_by: Sequence[str] = ()
    model_: DataFrame | None = None

    def _value(self) -> Column:
        return F.col("RH") if self.metric == "SPI" else F.col("RH") - F.col("EV24")

    def _rolled(self, df: DataFrame, time_col: str) -> DataFrame:
        need = {"RH"} | ({"EV24"} if self.metric == "SPEI" else set())
        if self.metric not in ("SPI", "SPEI") or not need <= set(df.columns):
            raise ValueError(f"{self.metric} needs the columns {sorted(need)}")
        by, reach, t = list(self.partition_by), duration(self.window) - 1, col(time_col).cast("timestamp")
        rows = df.select(*[col(c) for c in (*by, time_col)], self._value().cast("double").alias("_v"))
        rolled = lambda d, key: framed(d, key, time_col, [Rolling("_x", "_v", "mean", Frame(reach, 0, True))])
        out = rolled(rows, by) if by else by_span(rows, time_col, reach, 0, rolled)
        return out.drop("_v").withColumns({"_month": F.month(t), "_day": F.dayofmonth(t)})

    def configure(self, df: DataFrame, time_col: str = "TIME") -> SPEITransformer:
        """Fits the climate of each day of the year; days with too few years have none."""
        by = list(self.partition_by)
        days = self._rolled(df, time_col).groupBy(*by, "_month", "_day").agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"))
        enough = F.col("n") >= self.min_years / 2
        days = days.select(*by, "_month", "_day", F.when(enough, F.col("mean")).alias("mean"), F.when(enough, F.col("std")).alias("std"))
        if self.smoothing:
            w = ordered(by, ("_month", "_day")).rowsBetween(-2, 2)  # 366 rows at most, by station
            days = days.withColumns({c: F.percentile(F.col(c), F.lit(0.5)).over(w) for c in ("mean", "std")})
        self.model_ = days
        return self

    def transform(self, df: DataFrame, time_col: str = "TIME") -> DataFrame:
        """Keys, ``time_col`` and the index."""
        if self.model_ is None:
            raise ValueError("configure first")
        name = f"{self.metric}_{self.window}"
        by = list(self.partition_by)
        out = self._rolled(df, time_col).join(self.model_ if by else F.broadcast(self.model_), [*by, "_month", "_day"], "left")
        return out.select(*by, time_col, ((F.col("_x") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))).alias(name))


def automatic_rolling_features(df: DataFrame, target: str, cols: Sequence[str], time_col: str | Sequence[str], windows: Sequence[int] = (1, 2, 5, 10), types: Sequence[str] = ("mean", "lag", "min", "max", "std"), per_column: int = 1, partition_by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All candidates are made in one plan and scored in one pass by their absolute correlation with the target; the best
    of each column stay. Returns the table with the chosen features, and the scores."""
    from .exploration import correlations

    out = df
    made: dict[str, str] = {}
    for kind in types:
        ok = [n for n in windows if not (kind == "std" and n < 2)]
        step = BuildRollingFeatures(time_col, kind, 0, ok, cols, partition_by=partition_by)
        out = step.transform(out)
        made |= {m: m.split("#", 1)[0] for m in step.made}
    scores = correlations(out, target, list(made))
    best = scores.withColumn("base", F.substring_index("GROUP", "#", 1)).where("CORR IS NOT NULL")
    ranked = best.collect()  # one row for each candidate
    chosen: list[str] = []
    for c in cols:
        own = sorted((r for r in ranked if made[r.NAME] == c), key=lambda r: (-abs(r.CORR), r.NAME))
        chosen += [r.NAME for r in own[:per_column]]
    return out.drop(*[m for m in made if m not in chosen]), scores


def evidence_ridge(gram: np.ndarray, use: Sequence[int], rounds: int = 300) -> np.ndarray:
    """Weights of a Bayesian ridge from sums of products (1 first, the target last): the precisions of noise and weights are those
    of the greatest evidence, under flat priors; the intercept (place 0 of ``use``) is free."""
    f, n = list(use)[1:], gram[0, 0]
    mean, middle = gram[0, f] / n, gram[0, -1] / n
    a, b = gram[np.ix_(f, f)] - n * np.outer(mean, mean), gram[f, -1] - n * mean * middle
    spread = max(gram[-1, -1] - n * middle**2, 0.0)
    size, turn = np.linalg.eigh(a)
    size, seen = np.maximum(size, 0.0), turn.T @ b
    noise, weight, w = n / spread if spread else 1.0, 1.0, np.zeros(len(f))
    for _ in range(rounds):
        was, w = w, turn @ (seen / (size + weight / noise))
        used = (noise * size / (weight + noise * size)).sum()
        rest = max(spread - 2 * w @ b + w @ a @ w, 0.0)
        weight, noise = (used + 2e-6) / (w @ w + 2e-6), (n - used + 2e-6) / (rest + 2e-6)
        if np.abs(w - was).max(initial=0.0) < 1e-10:
            break
    return np.concatenate([[middle - w @ mean], w])


@dataclass
class RollingSearch:
    """Searches the windows of rolling features of a forecast by time-series splits.

    For each column, type and range of ``windows`` one window is chosen. Candidates are made in one plan; one pass sums the
    products of all features and the target in ``cv + 1`` parts of the time axis. A linear fit on some of the features and
    some of the parts needs these sums only, so that every choice is tried on the driver, on matrices of the features'
    number: each slot in turn takes the window with the best mean R2 (fitted on the parts before, judged on the next one),
    until nothing changes. Rows with a missing feature or target are left out.

    ``estimator_type``: ``lin``; ``bayeslin``, a ridge of the greatest evidence, by the same sums; or ``rf``, Spark's random
    forest, whose trees split by histograms that the tasks sum level by level. A forest is fitted on all candidates at once, on
    the parts before each judged one; each slot takes the window of the largest mean importance, and forests of the columns and of
    the chosen features give the two R2.
    """

    time_col: str | Sequence[str]
    target: str
    cols: Sequence[str]
    windows: Sequence[Sequence[int]] = ((1, 2, 5, 10),)
    types: Sequence[str] = ("mean", "lag")
    cv: int = 3
    partition_by: Sequence[str] = ()
    estimator_type: str = "lin"
    trees: int = 20
    seed: int = 0
    chosen: list[str] = field(default_factory=list)
    r2_base: float | None = None
    r2_rolling: float | None = None
    importances: dict[str, float] = field(default_factory=dict)

    def _candidates(self, df: DataFrame) -> tuple[DataFrame, list[list[str]]]:
        slots = []
        for kind in self.types:
            for own in self.windows:
                step = BuildRollingFeatures(self.time_col, kind, 0, [n for n in own if n > 1 or kind not in ("std", "var")], self.cols, partition_by=self.partition_by)
                df = step.transform(df)
                slots += [[m for m in step.made if m.startswith(f"{c}#")] for c in self.cols]
        return df, [s for s in slots if s]

    def fit(self, df: DataFrame) -> RollingSearch:
        """Chooses the features, and keeps both R2 (of the columns alone, and with the features) and the importances: the
        absolute weights for one standard deviation."""
        if self.cv < 2 or "ewm" in self.types:
            raise ValueError("cv must be 2 or more, and ewm has no windows")
        if self.estimator_type not in ("lin", "bayeslin", "rf"):
            raise ValueError("estimator_type must be lin, bayeslin or rf")
        rows, slots = self._candidates(df)
        names = [*self.cols, *dict.fromkeys(m for s in slots for m in s)]
        rows = rows.dropna(subset=[*names, self.target])
        time = col(self.time_col if isinstance(self.time_col, str) else self.time_col[0]).cast("double")
        x = [F.lit(1.0), *[col(n).cast("double") for n in names], col(self.target).cast("double")]
        parts = rows.withColumn("_part", bucket_of(time, cuts(rows, time, self.cv + 1)))
        if self.estimator_type == "rf":
            return self._by_forests(parts, names, slots)
        products = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x[i:], i)]
        grams = np.zeros((self.cv + 1, len(x), len(x)))
        for r in parts.groupBy("_part").agg(*products).collect():
            for i in range(len(x)):
                for j in range(i, len(x)):
                    grams[r._part, i, j] = grams[r._part, j, i] = r[f"s{i}_{j}"]

        def weights(gram: np.ndarray, use: list[int]) -> np.ndarray:
            if self.estimator_type == "bayeslin":
                return evidence_ridge(gram, use) if gram[0, 0] else np.zeros(len(use))
            return np.linalg.lstsq(gram[np.ix_(use, use)], gram[use, -1], rcond=None)[0]

        def score(features: Sequence[str]) -> float:
            use, got = [0, *[1 + names.index(f) for f in features]], []
            for k in range(1, self.cv + 1):
                w, own = weights(grams[:k].sum(0), use), grams[k]
                whole = own[-1, -1] - own[0, -1] ** 2 / own[0, 0] if own[0, 0] else 0.0
                if whole > 0:
                    got.append(1 - (own[-1, -1] - 2 * w @ own[use, -1] + w @ own[np.ix_(use, use)] @ w) / whole)
            return float(np.mean(got)) if got else -math.inf

        now = [s[len(s) // 2] for s in slots]
        for _ in range(10):
            was = list(now)
            for i, s in enumerate(slots):
                now[i] = max(s, key=lambda m: score([*self.cols, *dict.fromkeys([*now[:i], m, *now[i + 1 :]])]))
            if now == was:
                break
        self.chosen = list(dict.fromkeys(now))
        self.r2_base, self.r2_rolling = score(self.cols), score([*self.cols, *self.chosen])
        use = [0, *[1 + names.index(f) for f in [*self.cols, *self.chosen]]]
        gram = grams.sum(0)
        spread = np.sqrt(np.maximum(np.diag(gram)[use] / gram[0, 0] - (gram[0, use] / gram[0, 0]) ** 2, 0))
        self.importances = dict(zip([*self.cols, *self.chosen], np.abs(weights(gram, use) * spread)[1:].tolist(), strict=True))
        return self

    def _by_forests(self, parts: DataFrame, names: list[str], slots: list[list[str]]) -> RollingSearch:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import RandomForestRegressor

        place = {n: f"f{i}" for i, n in enumerate(names)}

        def fitted(rows: DataFrame, own: Sequence[str]) -> object:
            forest = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=self.trees, minInstancesPerNode=5, featureSubsetStrategy="all", seed=self.seed)
            return forest.fit(VectorAssembler(inputCols=[place[n] for n in own], outputCol="_x").transform(rows))

        with scope():
            rows = persisted(parts.select("_part", col(self.target).cast("double").alias("_y"), *[col(n).cast("double").alias(f) for n, f in place.items()]), "forest-rows")

            def score(own: Sequence[str]) -> float:
                got = []
                for k in range(1, self.cv + 1):
                    judged = VectorAssembler(inputCols=[place[n] for n in own], outputCol="_x").transform(rows.where(F.col("_part") == k))
                    told = fitted(rows.where(F.col("_part") < k), own).transform(judged).agg(F.sum(F.pow(F.col("_y") - F.col("prediction"), F.lit(2.0))).alias("e"), (F.var_pop("_y") * F.count("_y")).alias("s")).first()
                    if told.s:
                        got.append(1 - told.e / told.s)
                return float(np.mean(got)) if got else -math.inf

            own = list(names)
            weight = np.mean([fitted(rows.where(F.col("_part") < k), own).featureImportances.toArray() for k in range(1, self.cv + 1)], axis=0)
            rank = dict(zip(own, weight.tolist(), strict=True))
            self.chosen = list(dict.fromkeys(max(s, key=rank.__getitem__) for s in slots))
            use = [*self.cols, *self.chosen]
            self.r2_base, self.r2_rolling = score(self.cols), score(use)
            self.importances = dict(zip(use, fitted(rows, use).featureImportances.toArray().tolist(), strict=True))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the chosen features."""
        out, slots = self._candidates(df)
        return out.drop(*{m for s in slots for m in s} - set(self.chosen))
