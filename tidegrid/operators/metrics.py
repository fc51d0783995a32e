"""Forecasting metrics as aggregates; ``by`` gives one row for each group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.order import running
from ..functions.series import by_rows
from ..functions.windows import ordered
from .features import range_lag_column


def tilted(error: Column, quantile: float) -> Column:
    """Quantile loss of one error (actual less predicted)."""
    return F.greatest(error * quantile, error * (quantile - 1))


def tilted_loss(df: DataFrame, y_true: str, y_pred: str, quantile: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Mean quantile loss."""
    return df.groupBy(*by).agg(F.avg(tilted(col(y_true) - col(y_pred), quantile)).alias("tilted_loss"))


def joint_loss(squared: bool, targets: Mapping[str, Sequence[str]], quantiles: Sequence[float]) -> Column:
    """Sum over targets of the mean error and of the quantile losses: by target, its mean column, then its quantiles'."""
    parts = []
    for y, cols in targets.items():
        error = col(y) - col(cols[0])
        parts.append(F.avg(error * error if squared else F.abs(error)))
        parts += [F.avg(tilted(col(y) - col(c), q)) for q, c in zip(quantiles, cols[1:], strict=True)]
    return sum(parts[1:], parts[0])


def joint_mae_tilted_loss(df: DataFrame, targets: Mapping[str, Sequence[str]], quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Absolute errors of the means and quantile losses, summed."""
    return df.groupBy(*by).agg(joint_loss(False, targets, quantiles).alias("loss"))


def joint_mse_tilted_loss(df: DataFrame, targets: Mapping[str, Sequence[str]], quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Squared errors of the means and quantile losses, summed."""
    return df.groupBy(*by).agg(joint_loss(True, targets, quantiles).alias("loss"))


def rmse(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error."""
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(col(y_true) - col(y_pred), F.lit(2.0)))).alias("rmse"))


def mean_absolute_scaled_error(df: DataFrame, y_true: str, y_pred: str, shift: int, time_col: str | Sequence[str], weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error over that of the value ``shift`` rows ago; missing where that is 0."""
    return mean_absolute_scaled_errors(df, {y_true: y_pred}, shift, time_col, "uniform_average", weight, by)


def mean_absolute_scaled_errors(df: DataFrame, outputs: Mapping[str, str], shift: int, time_col: str | Sequence[str], multioutput: str | Sequence[float] = "uniform_average", weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """As :func:`mean_absolute_scaled_error` for several targets with their predictions: ``raw_values`` gives ``mase_{target}``
    for each; ``uniform_average``, or weights in order of the outputs, give ``mase``, the mean error over the mean naive error."""
    if shift != int(shift) or shift <= 0:
        raise ValueError("shift must be a whole number above 0")
    w = F.lit(1.0) if weight is None else col(weight)

    def errors(d: DataFrame, key: Sequence[str]) -> DataFrame:
        o = ordered(key, time_col)
        return d.withColumns({"_w": w} | {f"_n{i}": F.abs(col(t) - F.lag(col(t), shift).over(o)) for i, t in enumerate(outputs)} | {f"_e{i}": F.abs(col(t) - col(p)) for i, (t, p) in enumerate(outputs.items())})

    rows = errors(df, by) if by else by_rows(df, time_col, shift, 0, errors)
    mean = lambda e: F.sum(F.col(e) * F.col("_w")) / F.sum(F.when(F.col(e).isNotNull(), F.col("_w")))
    if multioutput == "raw_values":
        return rows.groupBy(*by).agg(*[(mean(f"_e{i}") / F.nullif(mean(f"_n{i}"), F.lit(0.0))).alias(f"mase_{t}") for i, t in enumerate(outputs)])
    share = [1.0] * len(outputs) if multioutput == "uniform_average" else [float(v) for v in multioutput]
    if len(share) != len(outputs) or isinstance(multioutput, str) and multioutput != "uniform_average":
        raise ValueError("multioutput must be raw_values, uniform_average, or a weight for each output")
    total = lambda side: sum((mean(f"_{side}{i}") * v for i, v in enumerate(share)), F.lit(0.0))
    return rows.groupBy(*by).agg((total("e") / F.nullif(total("n"), F.lit(0.0))).alias("mase"))


def train_r2(df: DataFrame, true: str, predicted: str, benchmark: float | str, by: Sequence[str] = (), epsilon: float = 1e-12) -> DataFrame:
    """1 less squared errors over those of a benchmark (a number or a column); missing values drop out of each sum."""
    base = col(benchmark) if isinstance(benchmark, str) else F.lit(float(benchmark))
    square = lambda e: F.sum(e * e)
    return df.groupBy(*by).agg((1 - square(col(true) - col(predicted)) / (square(col(true) - base) + epsilon)).alias("r2"))


train_mean_r2 = train_r2


def quantile_columns(cols: Sequence[str]) -> dict[str, dict[float, str]]:
    """By lead, quantile columns ``predict_lead_{lead}_q_{q}``; the mean counts as 0.5 if no such quantile is there."""
    out: dict[str, dict[float, str]] = {}
    for c in cols:
        if not c.startswith("predict_lead_"):
            continue
        lead, _, rest = c.removeprefix("predict_lead_").partition("_")
        if rest.startswith("q_"):
            out.setdefault(lead, {})[float(rest[2:])] = c
    for c in cols:
        if c.startswith("predict_lead_") and c.endswith("_mean"):
            out.setdefault(c.removeprefix("predict_lead_").removesuffix("_mean"), {}).setdefault(0.5, c)
    return out


def compute_quantile_ratios(df: DataFrame, y: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``lead, quantile, ratio``: the share of rows whose value lies below the quantile."""
    found = [(lead, q, c) for lead, qs in quantile_columns(cols or df.columns).items() for q, c in sorted(qs.items()) if c.split("_")[-2] == "q"]
    row = df.agg(*[F.avg(F.coalesce((col(y) < col(c)).cast("double"), F.lit(0.0))).alias(f"r{i}") for i, (_, _, c) in enumerate(found)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(lead).alias("lead"), F.lit(q).alias("quantile"), F.col(f"r{i}").alias("ratio")) for i, (lead, q, _) in enumerate(found)])))


def compute_quantile_crossings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``lead, low, high, share``: the share of rows where a quantile lies above the next higher one."""
    pairs = [(lead, a, b, qs[a], qs[b]) for lead, qs in quantile_columns(cols or df.columns).items() for a, b in zip(sorted(qs)[:-1], sorted(qs)[1:], strict=True)]
    row = df.agg(*[F.avg(F.coalesce((col(x) > col(y)).cast("double"), F.lit(0.0))).alias(f"r{i}") for i, (_, _, _, x, y) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(lead).alias("lead"), F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"r{i}").alias("share")) for i, (lead, a, b, _, _) in enumerate(pairs)])))


def incident_recall(df: DataFrame, incident: str, prediction: str, range_pred: tuple[int, int], time_col: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of incidents with a prediction that announced them ``range_pred`` rows before."""
    a, b = range_pred
    found = range_lag_column(df, prediction, (-b, -a), time_col, by, "_hit")
    return found.groupBy(*by).agg((F.sum(F.least("_hit", col(incident))) / F.nullif(F.sum(col(incident)), F.lit(0))).alias("recall"))


def make_incident_recall_scorer(range_pred: tuple[int, int], time_col: str, incident: str = "incident", prediction: str = "prediction"):
    """A function of a table to its incident recall."""
    return lambda df: incident_recall(df, incident, prediction, range_pred, time_col).first()[0]


def _curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``threshold, p, hits, marked, whole``: counts of rows at and from each score up. Scores are summed first, so the
    running sums are over distinct scores, in buckets of their order."""
    per = df.groupBy(col(score).cast("double").alias("threshold")).agg(F.sum(col(label)).alias("p"), F.count("*").alias("n"))
    whole = F.broadcast(df.agg(F.sum(col(label)).alias("whole")))  # one row
    return running(per, "threshold", {"hits": "p", "marked": "n"}, descending=True).drop("n").crossJoin(whole)


def precision_incident_recall_curve(df: DataFrame, incident: str, prediction: str, range_pred: tuple[int, int], time_col: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``threshold, precision, recall``: precision against incidents looked for ahead, recall with predictions carried to
    the incident; both step functions on all thresholds. ``by``: the series in which rows are ahead of each other."""
    a, b = range_pred
    ahead = range_lag_column(df, incident, (a, b), time_col, by, name="_ahead")
    carried = range_lag_column(df, prediction, (-b, -a), time_col, by, name="_carried")
    zero = F.lit(0)
    rows = ahead.select(col(prediction).cast("double").alias("threshold"), F.col("_ahead").alias("p"), F.lit(1).alias("n"), zero.alias("r"))
    rows = rows.union(carried.select(F.col("_carried").cast("double"), zero, zero, col(incident)))
    per = rows.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in "pnr"])
    whole = F.broadcast(df.agg(F.sum(col(incident)).alias("whole")))  # one row
    out = running(per, "threshold", {"hits": "p", "marked": "n", "found": "r"}, descending=True).crossJoin(whole)
    return out.select("threshold", F.coalesce(F.col("hits") / F.nullif("marked", zero), F.lit(1.0)).alias("precision"), F.coalesce(F.col("found") / F.nullif("whole", zero), F.lit(0.0)).alias("recall"))


def performance(df: DataFrame, y_true: str, y_pred: str, train_mean: float, metric: str = "R2", by: Sequence[str] = ()) -> DataFrame:
    """R2 in percent against the training mean, or the mean absolute error; rows with a missing value drop out."""
    rows = df.where(col(y_true).isNotNull() & col(y_pred).isNotNull())
    e = col(y_true) - col(y_pred)
    if metric == "R2":
        return rows.groupBy(*by).agg((100 * (1 - F.sum(e * e) / F.nullif(F.sum((col(y_true) - train_mean) * (col(y_true) - train_mean)), F.lit(0.0)))).alias("R2"))
    return rows.groupBy(*by).agg(F.avg(F.abs(e)).alias("MAE"))
