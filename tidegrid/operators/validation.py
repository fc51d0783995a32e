"""Validators: estimators whose fitted state is plain JSON and whose result sets bad values to missing."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import duration
from ..functions.names import col, numeric_columns
from ..functions.order import exact_quantiles
from ..functions.tables import persisted, scope
from ..functions.series import Frame, Rolling, by_rows, framed, spanned
from ..functions.windows import last_rows, ordered
from .cleaning import extremes

FLAG = "{}_invalid"


class Validator:
    """``validate`` adds a flag by column; ``transform`` sets flagged values to missing."""

    cols: Sequence[str] | None
    partition_by: Sequence[str]

    def fit(self, df: DataFrame) -> Validator:
        """Learns bounds; nothing by default."""
        return self

    def columns_of(self, df: DataFrame) -> list[str]:
        """The columns given, or all numeric ones."""
        return list(self.cols) if self.cols is not None else numeric_columns(df, tuple(self.partition_by))

    def flags(self, df: DataFrame) -> dict[str, Column]:
        """A condition by column."""
        raise NotImplementedError

    def validate(self, df: DataFrame) -> DataFrame:
        """``df`` with a flag column for each validated one."""
        return df.withColumns({FLAG.format(c): F.coalesce(f, F.lit(False)) for c, f in self.flags(df).items()})

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with flagged values missing."""
        found = self.validate(df)
        cols = self.columns_of(df)
        return found.withColumns({c: F.when(~col(FLAG.format(c)), col(c)) for c in cols}).drop(*[FLAG.format(c) for c in cols])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Both."""
        return self.fit(df).transform(df)

    def to_dict(self) -> dict:
        """State as plain JSON types."""
        return asdict(self)


@dataclass
class OutsideRangeValidator(Validator):
    """Flags values strictly outside bounds: a number, one by column, ``"auto"`` (those of the fitted data), or None."""

    cols: Sequence[str] | None = None
    min_value: float | str | Mapping[str, float] | None = "auto"
    max_value: float | str | Mapping[str, float] | None = "auto"
    partition_by: Sequence[str] = ()
    bounds: dict[str, tuple[float | None, float | None]] | None = None

    def fit(self, df: DataFrame) -> OutsideRangeValidator:
        """Works out the bounds."""
        cols = self.columns_of(df)
        seen = extremes(df, cols) if "auto" in (self.min_value, self.max_value) else {}
        pick = lambda given, c, k: seen[c][k] if given == "auto" else given.get(c) if isinstance(given, Mapping) else given
        self.bounds = {c: (pick(self.min_value, c, 0), pick(self.max_value, c, 1)) for c in cols}
        return self

    def flags(self, df: DataFrame) -> dict[str, Column]:
        """Below the lower or above the upper bound."""
        if self.bounds is None:
            raise ValueError("fit first")
        out = {}
        for c in self.columns_of(df):
            low, high = self.bounds[c]
            out[c] = (F.lit(False) if low is None else col(c) < low) | (F.lit(False) if high is None else col(c) > high)
        return out


@dataclass
class MADValidator(Validator):
    """Flags deviations from a centred rolling median beyond ``madthresh`` times the median deviation of their sign.

    ``rollingwindow``: a number of rows, or a span such as ``"1d"`` (the rows in ``(t - span / 2, t + span / 2]``).
    """

    time_col: str | Sequence[str]
    rollingwindow: int | str = 60
    cols: Sequence[str] | None = None
    madthresh: float = 15
    partition_by: Sequence[str] = ()
    bounds: dict[str, tuple[float | None, float | None]] | None = None

    def _deviated(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        """``df`` with the deviations as ``_d0`` and so on, by medians that move with the window."""
        n = self.rollingwindow
        half = 0 if isinstance(n, int) else duration(n) // 2
        frame = Frame(n // 2, (n - 1) // 2) if isinstance(n, int) else Frame(half - 1, half, True)
        medians = lambda d, by: framed(d, by, self.time_col, [Rolling(f"_d{i}", c, "median", frame) for i, c in enumerate(cols)])
        time = self.time_col if isinstance(self.time_col, str) else self.time_col[0]
        if self.partition_by:
            out = medians(df, self.partition_by)
        elif frame.span:
            out = spanned(df, time, [Rolling(f"_d{i}", c, "median", frame) for i, c in enumerate(cols)])
        else:
            out = by_rows(df, self.time_col, frame.before, frame.after, medians)
        return out.withColumns({f"_d{i}": col(c) - F.col(f"_d{i}") for i, c in enumerate(cols)})

    def fit(self, df: DataFrame) -> MADValidator:
        """Both medians by column; a sign that never occurs never flags."""
        cols = self.columns_of(df)
        d = [F.col(f"_d{i}") for i in range(len(cols))]
        with scope():  # a few passes
            found = persisted(self._deviated(df, cols).select(*d), "deviations")
            got = exact_quantiles(found, {f"a{i}": F.when(x < 0, x) for i, x in enumerate(d)} | {f"b{i}": F.when(x > 0, x) for i, x in enumerate(d)}, [0.5])
        times = lambda x: None if x is None else x * self.madthresh
        self.bounds = {c: (times(got[f"a{i}"][0]), times(got[f"b{i}"][0])) for i, c in enumerate(cols)}
        return self

    def flags(self, df: DataFrame) -> dict[str, Column]:
        """Not used: medians are columns of their own first."""
        raise NotImplementedError

    def validate(self, df: DataFrame) -> DataFrame:
        """``df`` with a flag for each column: strictly outside the bounds."""
        if self.bounds is None:
            raise ValueError("fit first")
        cols, new = self.columns_of(df), {}
        for i, c in enumerate(cols):
            d, (low, high) = F.col(f"_d{i}"), self.bounds[c]
            new[FLAG.format(c)] = F.coalesce((F.lit(False) if low is None else d < low) | (F.lit(False) if high is None else d > high), F.lit(False))
        return self._deviated(df, cols).withColumns(new).drop(*[f"_d{i}" for i in range(len(cols))])


@dataclass
class FlatlineValidator(Validator):
    """Flags runs of ``window`` rows whose values differ by at most ``margin``; with ``backfill`` the whole run.

    ``window="auto"`` is the run length whose chance under the share of repeated values falls below ``pvalue``. A window
    of 1 flags every value that is there.
    """

    time_col: str | Sequence[str]
    window: int | str = 1
    cols: Sequence[str] | None = None
    pvalue: float | None = None
    margin: float = 0
    backfill: bool = True
    partition_by: Sequence[str] = ()
    windows: dict[str, int | None] | None = None

    def fit(self, df: DataFrame) -> FlatlineValidator:
        """Works out the window of each column; None where runs can't be told (no or only repeated values)."""
        cols = self.columns_of(df)
        if self.window != "auto":
            self.windows = dict.fromkeys(cols, int(self.window))
            return self
        if not self.pvalue:
            raise ValueError("an automatic window needs pvalue")
        equal = lambda d, by: d.withColumns({f"s{i}": (col(c) == F.lag(col(c)).over(ordered(by, self.time_col))).cast("int") for i, c in enumerate(cols)})
        same = equal(df, self.partition_by) if self.partition_by else by_rows(df, self.time_col, 1, 0, equal)
        row = same.agg(F.count("*").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(cols))]).first()
        share = [(row[f"s{i}"] or 0) / row["n"] if row["n"] else 0 for i in range(len(cols))]
        self.windows = {c: math.ceil(math.log(self.pvalue) / math.log(p)) if 0 < p < 1 else None for c, p in zip(cols, share, strict=True)}
        return self

    def flags(self, df: DataFrame) -> dict[str, Column]:
        """Not used: flags of flags need two steps."""
        raise NotImplementedError

    def validate(self, df: DataFrame) -> DataFrame:
        """``df`` with a flag column for each validated one."""
        if self.windows is None:
            raise ValueError("fit first")
        cols = self.columns_of(df)
        if self.partition_by:
            return self._flagged(df, cols, self.partition_by)
        reach = max((n or 1 for n in self.windows.values()), default=1) - 1
        return by_rows(df, self.time_col, reach, reach if self.backfill else 0, lambda d, by: self._flagged(d, cols, by))

    def _flagged(self, df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
        first, second = {}, {}
        for c in cols:
            n = self.windows[c]
            if not n:
                first[FLAG.format(c)] = F.lit(False)
                continue
            w = last_rows(by, self.time_col, n)
            first[FLAG.format(c)] = F.coalesce((F.count(col(c)).over(w) == n) & (F.max(col(c)).over(w) - F.min(col(c)).over(w) <= self.margin), F.lit(False))
            if self.backfill:
                back = ordered(by, self.time_col).rowsBetween(0, n - 1)
                second[FLAG.format(c)] = F.max(col(FLAG.format(c))).over(back)
        out = df.withColumns(first)
        return out.withColumns(second) if second else out


@dataclass
class Imputer:
    """Fills missing values with what it has learnt from the table it was fitted on.

    ``mean``, ``median``, ``most_frequent`` (the least of ties), ``constant`` (``value``), or ``iterative``: linear
    regressions of each column on the others, ``rounds`` times over, from the means on. Each regression needs one pass of
    sums (the normal equations) over a table that is written once a round; the driver solves a system of ``len(cols)``
    unknowns. ``transform`` goes through the same regressions in the same order.
    """

    cols: Sequence[str]
    method: str = "mean"
    value: float | None = None
    rounds: int = 3
    given: dict[str, float | None] | None = None
    weights: list[dict[str, list[float]]] = field(default_factory=list)

    def fit(self, df: DataFrame) -> Imputer:
        """Learns the values or the regressions."""
        cols = list(self.cols)
        if self.method == "constant":
            self.given = dict.fromkeys(cols, self.value)
        elif self.method in ("mean", "iterative"):
            row = df.agg(*[F.avg(col(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
            self.given = {c: row[f"v{i}"] for i, c in enumerate(cols)}
        elif self.method == "median":
            self.given = {c: v[0] for c, v in exact_quantiles(df, {c: col(c) for c in cols}, [0.5]).items()}
        elif self.method == "most_frequent":
            tops = [df.where(col(c).isNotNull()).groupBy(col(c).alias("v")).count().orderBy(F.desc("count"), "v").first() for c in cols]
            self.given = {c: top.v if top else None for c, top in zip(cols, tops, strict=True)}
        else:
            raise ValueError("method must be mean, median, most_frequent, constant or iterative")
        self.weights = []
        if self.method == "iterative":
            self._learn(df)
        return self

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(v).cast("double")) for c, v in self.given.items()})

    def _x(self, c: str) -> list[Column]:
        return [F.lit(1.0), *[col(o) for o in self.cols if o != c]]

    def _step(self, df: DataFrame, c: str, weights: Sequence[float], missing: str) -> DataFrame:
        guess = sum((float(b) * a for b, a in zip(weights, self._x(c), strict=True)), F.lit(0.0))
        return df.withColumn(c, F.when(col(missing), guess).otherwise(col(c)))

    def _learn(self, df: DataFrame) -> None:
        cols = list(self.cols)
        was = {c: f"_missing_{i}" for i, c in enumerate(cols)}
        plain = df.select(*[col(c).cast("double").alias(c) for c in cols])
        with scope() as here:
            now = persisted(self._filled(plain.withColumns({m: col(c).isNull() for c, m in was.items()})), "impute-round")
            for _ in range(self.rounds):
                self.weights.append({})
                for c in cols:
                    x = self._x(c)
                    sums = [F.sum(a * b) for i, a in enumerate(x) for b in x[i:]] + [F.sum(a * col(c)) for a in x]
                    row = now.where(~col(was[c])).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
                    gram, at = np.zeros((len(x), len(x))), 0
                    for i in range(len(x)):
                        for j in range(i, len(x)):
                            gram[i, j] = gram[j, i] = row[at] or 0.0
                            at += 1
                    self.weights[-1][c] = np.linalg.lstsq(gram, np.array([row[at + i] or 0.0 for i in range(len(x))]), rcond=None)[0].tolist()
                    now = self._step(now, c, self.weights[-1][c], was[c])
                now = persisted(now, "impute-round")
                here.drop(but=1)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` without missing values in the columns (but where nothing was there to learn from)."""
        if self.given is None:
            raise ValueError("fit first")
        was = {c: f"_missing_{i}" for i, c in enumerate(self.cols)}
        if self.method != "iterative":
            return self._filled(df) if self.method != "constant" else df.fillna(self.given)
        out = self._filled(df.withColumns({m: col(c).isNull() for c, m in was.items()}))
        for step in self.weights:
            for c, weights in step.items():
                out = self._step(out, c, weights, was[c])
        return out.drop(*was.values())

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Both."""
        return self.fit(df).transform(df)

    def to_dict(self) -> dict:
        """State as plain JSON types."""
        return asdict(self)


def imputed(df: DataFrame, cols: Sequence[str], method: str = "mean", value: float | None = None) -> DataFrame:
    """Missing values of each column filled by its mean, median, most frequent value (the least of ties) or a constant."""
    return Imputer(cols, method, value).fit_transform(df)


def iteratively_imputed(df: DataFrame, cols: Sequence[str], rounds: int = 3) -> DataFrame:
    """Missing values filled by linear regressions on the other columns, in rounds that start from the means."""
    return Imputer(cols, "iterative", rounds=rounds).fit_transform(df)


@dataclass
class ValidationPipe:
    """Validators one behind the other, then an imputer (None: none). What is fitted on one table can be used on another."""

    steps: Sequence[Validator]
    imputer: Imputer | None = None

    def fit(self, df: DataFrame) -> ValidationPipe:
        """Fits each step on what the steps before it leave."""
        for step in self.steps:
            df = step.fit(df).transform(df)
        if self.imputer is not None:
            self.imputer.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """The steps with what they have learnt."""
        for step in self.steps:
            df = step.transform(df)
        return df if self.imputer is None else self.imputer.transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Both."""
        return self.fit(df).transform(df)

    def to_dict(self) -> dict:
        """State as plain JSON types."""
        return {"steps": [{"kind": type(s).__name__} | s.to_dict() for s in self.steps], "imputer": None if self.imputer is None else self.imputer.to_dict()}

    @staticmethod
    def from_dict(given: dict) -> ValidationPipe:
        """From :meth:`to_dict`, also after a way through JSON."""
        kinds = {k.__name__: k for k in (OutsideRangeValidator, MADValidator, FlatlineValidator)}
        steps = [kinds[s["kind"]](**{k: v for k, v in s.items() if k != "kind"}) for s in given["steps"]]
        return ValidationPipe(steps, None if given["imputer"] is None else Imputer(**given["imputer"]))


def create_validation_pipe(time_col: str | Sequence[str], cols: Sequence[str], rollingwindow: int | str = 60, madthresh: float = 15, flatline_window: int | str = "auto", pvalue: float = 1e-100, impute_method: str | None = "iterative", impute_value: float | None = None, partition_by: Sequence[str] = ()) -> ValidationPipe:
    """Median deviation, flat lines, then imputation (None: none)."""
    steps = [MADValidator(time_col, rollingwindow, cols, madthresh, partition_by), FlatlineValidator(time_col, flatline_window, cols, pvalue, partition_by=partition_by)]
    return ValidationPipe(steps, None if impute_method is None else Imputer(cols, impute_method, impute_value))
