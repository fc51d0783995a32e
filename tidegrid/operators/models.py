"""Forecasters: a constant, linear (lasso and quantile), and a small neural network; importances and baselines.

Fitted state is plain JSON. Fits that need all rows use one aggregate pass a step (sums of products, gradients), so the
driver holds numbers by feature only.
"""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import network, quantile_lines
from ..functions.names import col
from ..functions.order import exact_quantiles
from ..functions.tables import persisted, scope
from .cleaning import has_strictly_increasing_index, make_df_monotonic, remove_target_nan
from .features import BuildRollingFeatures, RollingSearch, SimpleFeatureEngineer
from .metrics import joint_loss, tilted
from .reshaping import make_shifted_target


#: Rounds of reweighted least squares before the exact solution is looked for.
START_ROUNDS = 6


def prediction_names(predict_ahead: Sequence[int], quantiles: Sequence[float]) -> list[str]:
    """Quantiles outside, leads inside, then the means."""
    return [f"predict_lead_{p}_q_{q}" for q in quantiles for p in predict_ahead] + [f"predict_lead_{p}_mean" for p in predict_ahead]


@dataclass
class TimeseriesRegressor:
    """Template: shifted targets are made, an output is fitted for each lead, predictions are put back together.

    ``features`` are columns of the table (see the feature operators). With ``use_diff_of_y`` the differences to the
    current value are fitted and the current value is added to predictions. ``weight`` names a column of sample weights
    (the constant forecaster has none); :meth:`create_weights` can be overridden. ``engineer`` makes the features from raw
    columns, in fits and predictions alike (a dataclass with ``transform``, such as a rolling or a simple feature engineer);
    with ``scale_y`` targets are fitted in units of their deviation from their mean.
    """

    time_col: str
    target: str
    features: Sequence[str] = ()
    predict_ahead: Sequence[int] = (0,)
    quantiles: Sequence[float] = ()
    use_diff_of_y: bool = False
    partition_by: Sequence[str] = ()
    monotonic_quantiles: bool = True
    weight: str | None = None
    engineer: object | None = None
    scale_y: bool = False
    state: dict = field(default_factory=dict)

    def engineered(self, df: DataFrame) -> DataFrame:
        """``df`` with the features that the engineer makes."""
        return df if self.engineer is None else self.engineer.transform(df)

    def _check(self, df: DataFrame) -> None:
        if any(p < 0 for p in self.predict_ahead) or len(set(self.predict_ahead)) != len(self.predict_ahead):
            raise ValueError("predict_ahead must be different numbers from 0")
        if self.use_diff_of_y and 0 in self.predict_ahead:
            raise ValueError("no differences at lead 0")
        if max(self.predict_ahead) and not has_strictly_increasing_index(df, self.time_col, True, self.partition_by):
            raise ValueError("times must have one step")

    def _targets(self) -> dict[int, str]:
        return {p: f"{self.target}_{'diff' if self.use_diff_of_y else 'lead'}_{p}" for p in self.predict_ahead}

    def create_weights(self) -> Column:
        """The weight of a row in fits: 1 unless a column gives it."""
        return F.lit(1.0) if self.weight is None else col(self.weight).cast("double")

    def prepared(self, df: DataFrame) -> DataFrame:
        """``df`` with features and the targets to fit, without incomplete rows."""
        out = make_shifted_target(self.engineered(df), self.target, list(self.predict_ahead), self.time_col, self.use_diff_of_y, partition_by=self.partition_by)
        return remove_target_nan(out, list(self._targets().values()), self.features, True)

    def fit(self, df: DataFrame) -> TimeseriesRegressor:
        """Fits every output."""
        self._check(df)
        rows = self.prepared(df)
        targets = self._targets()
        scales = {y: [0.0, 1.0] for y in targets.values()}
        if self.scale_y:
            row = rows.agg(*[f(col(y)).alias(f"{k}{i}") for i, y in enumerate(targets.values()) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
            scales = {y: [row[f"m{i}"], row[f"s{i}"] or 1.0] for i, y in enumerate(targets.values())}
            rows = rows.withColumns({y: (col(y) - m) / s for y, (m, s) in scales.items()})
        self.state = {str(p): {"fit": self._fit_one(rows, y), "scale": scales[y]} for p, y in targets.items()}
        return self

    def _fit_one(self, rows: DataFrame, y: str) -> dict:
        raise NotImplementedError

    def _outputs(self, state: dict, read: Callable[[str], Column] = col) -> dict[str, Column]:
        """The mean's and the quantiles' expressions, by ``mean`` or the quantile; ``read`` gives a feature's value."""
        raise NotImplementedError

    def outputs(self, lead: int, read: Callable[[str], Column] = col) -> dict[str, Column]:
        """As :meth:`_outputs`, in units of the target."""
        if not self.state:
            raise ValueError("fit first")
        mean, size = self.state[str(lead)]["scale"]
        made = self._outputs(self.state[str(lead)]["fit"], read)
        return {k: c * size + mean for k, c in made.items()} if self.scale_y else made

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction columns, quantiles in order."""
        made = {}
        for p in self.predict_ahead:
            for k, c in self.outputs(p).items():
                name = f"predict_lead_{p}_mean" if k == "mean" else f"predict_lead_{p}_q_{k}"
                made[name] = c + col(self.target) if self.use_diff_of_y else c
        out = self.engineered(df).withColumns({n: made[n] for n in prediction_names(self.predict_ahead, self.quantiles)})
        if self.monotonic_quantiles and len(self.quantiles) > 1:
            for p in self.predict_ahead:
                out = make_df_monotonic(out, [f"predict_lead_{p}_q_{q}" for q in sorted(self.quantiles)], "max")
        return out

    def score(self, df: DataFrame) -> float:
        """The negative joint loss (absolute errors of means, quantile losses) over complete rows."""
        plain = make_shifted_target(self.predict(df), self.target, list(self.predict_ahead), self.time_col, False, "_y", self.partition_by)
        targets = {f"_y_lead_{p}": [f"predict_lead_{p}_mean", *[f"predict_lead_{p}_q_{q}" for q in self.quantiles]] for p in self.predict_ahead}
        return -plain.dropna(subset=list(targets)).agg(joint_loss(False, targets, self.quantiles)).first()[0]

    def dump(self) -> str:
        """State as JSON text."""
        engineer = None if self.engineer is None else {"kind": type(self.engineer).__name__} | asdict(self.engineer)
        return json.dumps({"kind": type(self).__name__} | asdict(self) | {"engineer": engineer})

    @staticmethod
    def load(text: str) -> TimeseriesRegressor:
        """From :meth:`dump`; only the kinds of this module, and the feature engineers of the engine."""
        given = json.loads(text)
        if given["engineer"] is not None:
            made = {k.__name__: k for k in (BuildRollingFeatures, SimpleFeatureEngineer, RollingSearch)}
            given["engineer"] = made[given["engineer"].pop("kind")](**given["engineer"])
        kinds = {k.__name__: k for k in (ConstantTimeseriesRegressor, LassoTimeseriesRegressor, MLPTimeseriesRegressor)}
        return kinds[given.pop("kind")](**given)


@dataclass
class ConstantTimeseriesRegressor(TimeseriesRegressor):
    """The median (or mean) and the quantiles of the target, whatever the features."""

    average_type: str = "median"

    def _fit_one(self, rows: DataFrame, y: str) -> dict:
        found = exact_quantiles(rows, {"y": col(y)}, [0.5, *self.quantiles])["y"]
        mid = rows.agg(F.avg(col(y))).first()[0] if self.average_type == "mean" else found[0]
        return {"mean": mid} | {str(q): v for q, v in zip(self.quantiles, found[1:], strict=True)}

    def _outputs(self, state: dict, read: Callable[[str], Column] = col) -> dict[str, Column]:
        return {k if k == "mean" else float(k): F.lit(float(v)) for k, v in state.items()}


def _sums(rows: DataFrame, x: Sequence[Column], y: Column, weight: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted means of products of the features (with 1 first) and of each with the target, in one pass."""
    mean = lambda e: F.sum(e * weight) / F.sum(F.when(e.isNotNull(), weight))
    parts = [mean(a * b) for i, a in enumerate(x) for b in x[i:]] + [mean(a * y) for a in x] + [F.count("*")]
    row = list(rows.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]).first())
    k, gram, at = len(x), np.zeros((len(x), len(x))), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = row[at]
            at += 1
    return gram, np.array(row[at : at + k], float), row[-1]


def lasso(gram: np.ndarray, cross: np.ndarray, alpha: float, steps: int = 2000, least: float = 1e-10) -> np.ndarray:
    """Coordinate descent for half the mean squared error plus ``alpha`` times the weights' absolute sum; weight 0 is free."""
    w = np.zeros(len(cross))
    for _ in range(steps):
        was = w.copy()
        for i in range(len(w)):
            r = cross[i] - gram[i] @ w + gram[i, i] * w[i]
            w[i] = 0.0 if gram[i, i] == 0 else r / gram[i, i] if i == 0 else np.sign(r) * max(abs(r) - alpha, 0) / gram[i, i]
        if np.abs(w - was).max() < least:
            break
    return w


def _products(rows: DataFrame, x: Sequence[Column], y: Column, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of products of the features, and of each with the target, in one pass."""
    parts = [F.sum(a * b * weight) for i, a in enumerate(x) for b in x[i:]] + [F.sum(a * y * weight) for a in x]
    row = list(rows.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]).first())
    gram, at = np.zeros((len(x), len(x))), 0
    for i in range(len(x)):
        for j in range(i, len(x)):
            gram[i, j] = gram[j, i] = row[at]
            at += 1
    return gram, np.array(row[at:], float)


def quantile_weights(rows: DataFrame, x: Sequence[Column], y: Column, q: float, start: np.ndarray, weight: Column, rounds: int, tol: float = 1e-8, alpha: float = 0.0, free: Sequence[int] = ()) -> np.ndarray:
    """Linear quantile regression with a penalty of ``alpha`` times the absolute weights but those of ``free`` columns: a few
    rounds of reweighted least squares, one pass of sums each, then the exact solution beside it. Equal rows are one row with the sum
    of their weights; these are written once, and all passes read them."""
    names = [f"_x{i}" for i in range(len(x))]
    table = rows.select(*[c.cast("double").alias(n) for c, n in zip(x, names, strict=True)], y.cast("double").alias("_y"), weight.cast("double").alias("_s")).dropna()
    with scope():
        table = persisted(table.groupBy(*names, "_y").agg(F.sum("_s").alias("_s")), "quantile-rows")
        own = [F.col(n) for n in names], F.col("_y")
        near = _reweighted(table, *own, q, start, F.col("_s"), rounds, tol)
        return quantile_lines.fitted(table, *own, q, near, F.col("_s"), alpha, free)


def _reweighted(rows: DataFrame, x: Sequence[Column], y: Column, q: float, start: np.ndarray, weight: Column, rounds: int, tol: float) -> np.ndarray:
    w = start
    for _ in range(rounds):
        e = y - sum((a * float(b) for a, b in zip(x, w, strict=True)), F.lit(0.0))
        gram, cross = _products(rows, x, y, weight * F.when(e >= 0, F.lit(q)).otherwise(F.lit(1 - q)) / F.greatest(F.abs(e), F.lit(1e-6)))
        new = np.linalg.lstsq(gram, cross, rcond=None)[0]
        done, w = np.abs(new - w).max() < tol, new
        if done:
            break
    return w


@dataclass
class LinearQuantileRegression:
    """Linear quantile regressions with p-values: robust covariances with an Epanechnikov kernel and Hall and Sheather's
    bandwidth, all by sums over the rows; the normal distribution stands for Student's. Rows with a missing value are left out.
    """

    target: str
    features: Sequence[str]
    quantiles: Sequence[float] = (0.05, 0.95)
    tol: float = 1e-6
    max_iter: int = 100
    fit_intercept: bool = True
    coef_: dict[float, dict[str, float]] = field(default_factory=dict)
    pvalue_: dict[float, dict[str, float]] = field(default_factory=dict)

    def _x(self) -> dict[str, Column]:
        return {c: col(c).cast("double") for c in self.features} | ({"const": F.lit(1.0)} if self.fit_intercept else {})

    def fit(self, df: DataFrame) -> LinearQuantileRegression:
        """Fits each quantile."""
        if any(not 0 < q < 1 for q in self.quantiles):
            raise ValueError("quantiles lie between 0 and 1")
        rows, y, normal = df.dropna(subset=[self.target, *self.features]), col(self.target).cast("double"), NormalDist()
        names, x = list(self._x()), list(self._x().values())
        gram, cross = _products(rows, x, y, F.lit(1.0))
        row = rows.agg(F.count("*").alias("n"), F.stddev_pop(y).alias("s")).first()
        low, high = exact_quantiles(rows, {"y": y}, [0.25, 0.75])["y"]
        inverse = np.linalg.pinv(gram)
        for q in self.quantiles:
            w = quantile_weights(rows, x, y, q, np.linalg.lstsq(gram, cross, rcond=None)[0], F.lit(1.0), min(self.max_iter, START_ROUNDS), self.tol)
            z = normal.inv_cdf(q)
            h = row.n ** (-1 / 3) * normal.inv_cdf(0.975) ** (2 / 3) * (1.5 * normal.pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)
            a, b = max(q - h, 1e-6), min(q + h, 1 - 1e-6)
            h = min(row.s, (high - low) / 1.34) * (normal.inv_cdf(b) - normal.inv_cdf(a))
            e = y - sum((c * float(v) for c, v in zip(x, w, strict=True)), F.lit(0.0))
            dense = rows.agg(F.sum(F.when(F.abs(e) <= h, 0.75 * (1 - (e / h) * (e / h)))).alias("d")).first().d if h > 0 else None
            self.coef_[q] = dict(zip(names, w.tolist(), strict=True))
            if not dense:  # no residuals near 0, or none at all
                self.pvalue_[q] = dict.fromkeys(names, math.nan)
                continue
            size = row.n * h / dense
            middle, _ = _products(rows, x, y, F.when(e > 0, F.lit((q * size) ** 2)).otherwise(F.lit(((1 - q) * size) ** 2)))
            spread = np.sqrt(np.diag(inverse @ middle @ inverse))
            self.pvalue_[q] = {n: math.erfc(abs(v) / s / math.sqrt(2)) if s > 0 else math.nan for n, v, s in zip(names, w.tolist(), spread.tolist(), strict=True)}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a column ``predict_q_{q}`` for each quantile."""
        if not self.coef_:
            raise ValueError("fit first")
        x = self._x()
        return df.withColumns({f"predict_q_{q}": sum((x[n] * float(v) for n, v in own.items()), F.lit(0.0)) for q, own in self.coef_.items()})

    def score(self, df: DataFrame) -> float:
        """The mean over the quantiles of their losses."""
        losses = [F.avg(tilted(col(self.target) - col(f"predict_q_{q}"), q)) for q in self.quantiles]
        return self.predict(df).agg(sum(losses[1:], losses[0]) / len(losses)).first()[0]


@dataclass
class LassoTimeseriesRegressor(TimeseriesRegressor):
    """A lasso for the mean, and linear quantile regressions with the same penalty. ``average_type="median"`` takes the
    regression of the median in place of the mean's."""

    alpha: float = 0.01
    rounds: int = START_ROUNDS
    average_type: str = "mean"

    def _x(self, read: Callable[[str], Column] = col) -> list[Column]:
        return [F.lit(1.0), *[read(c).cast("double") for c in self.features]]

    def _fit_one(self, rows: DataFrame, y: str) -> dict:
        if self.average_type not in ("mean", "median"):
            raise ValueError("average_type must be mean or median")
        if self.average_type == "median" and 0.5 in self.quantiles:
            raise ValueError("the median is the mean's place already; leave 0.5 out of the quantiles")
        gram, cross, _ = _sums(rows, self._x(), col(y).cast("double"), self.create_weights())
        if self.average_type == "median":
            out = {"mean": self._quantile(rows, y, 0.5, np.linalg.lstsq(gram, cross, rcond=None)[0]).tolist()}
        else:
            out = {"mean": lasso(gram, cross, self.alpha).tolist()}
        for q in self.quantiles:
            out[str(q)] = self._quantile(rows, y, q, np.linalg.lstsq(gram, cross, rcond=None)[0]).tolist()
        return out

    def _quantile(self, rows: DataFrame, y: str, q: float, w: np.ndarray) -> np.ndarray:
        return quantile_weights(rows, self._x(), col(y), q, w, self.create_weights(), self.rounds, alpha=self.alpha, free=(0,))

    def _line(self, w: Sequence[float], read: Callable[[str], Column] = col) -> Column:
        return sum((a * float(b) for a, b in zip(self._x(read)[1:], w[1:], strict=True)), F.lit(float(w[0])))

    def _outputs(self, state: dict, read: Callable[[str], Column] = col) -> dict[str, Column]:
        return {k if k == "mean" else float(k): self._line(v, read) for k, v in state.items()}

    def contributions(self, df: DataFrame, lead: int | None = None) -> DataFrame:
        """Exact additive contributions ``weight * (x - mean)`` of each feature to the mean prediction."""
        own = self.state[str(self.predict_ahead[0] if lead is None else lead)]
        w, df = np.array(own["fit"]["mean"]) * own["scale"][1], self.engineered(df)
        means = df.agg(*[F.avg(col(c)).alias(c) for c in self.features]).first()
        return df.withColumns({f"{c}_contribution": (col(c) - means[c]) * float(b) for c, b in zip(self.features, w[1:], strict=True)})


def _dense(z: Column, units: list[list[float]]) -> Column:
    """A layer over an array: by unit its weights and, last, its bias. The layer below is bound once, however many units read it."""
    dot = lambda below, unit: F.aggregate(F.zip_with(below, unit, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    layer = lambda below: F.transform(F.lit(units), lambda unit: F.tanh(dot(below, unit)))
    return F.element_at(F.transform(F.array(F.concat(z, F.array(F.lit(1.0)))), layer), 1)


@dataclass
class MLPTimeseriesRegressor(TimeseriesRegressor):
    """Dense layers with a joint loss: squared error of the mean and quantile losses. Every epoch sums the gradients of all
    rows over the tasks (see :mod:`tidegrid.functions.network`); predictions are SQL expressions.

    ``hidden``: units of the one hidden layer, or of several. ``dropout``: the share of units that an epoch leaves out, by
    row. ``validation_share`` of the rows (by a hash of their values) only judge; with ``patience`` the fit ends when they (or, without
    any, the training rows) have not become better for so many epochs. ``state`` keeps the history by lead.
    """

    hidden: int | Sequence[int] = 8
    epochs: int = 300
    rate: float = 0.02
    seed: int = 42
    dropout: float = 0.0
    validation_share: float = 0.0
    patience: int | None = None

    def fit(self, df: DataFrame, validation: DataFrame | None = None, on_epoch: network.Hook | None = None) -> MLPTimeseriesRegressor:
        """As the others. ``validation``: rows that only judge, in place of a share; ``on_epoch`` gets the scores after each epoch
        (``epoch``, ``lead``, ``loss``, ``r2``, ``val_loss``, ``val_r2``, in units of the scaled target) and may end the fit."""
        self._on_epoch, self._judges = on_epoch, None if validation is None else self.prepared(validation)
        try:
            return super().fit(df)
        finally:
            del self._on_epoch, self._judges

    def _layers(self) -> list[int]:
        return [self.hidden] if isinstance(self.hidden, int) else list(self.hidden)

    def _fit_one(self, rows: DataFrame, y: str) -> dict:
        cols = [*self.features, y]
        weight = self.create_weights()
        share = F.pmod(F.xxhash64(*[col(c).cast("double") for c in cols]), F.lit(1 << 20)) < int(self.validation_share * (1 << 20))
        parts = rows.withColumn("validation", share)
        if self._judges is not None:
            parts = rows.withColumn("validation", F.lit(False)).unionByName(self._judges.withColumn("validation", F.lit(True)), True)
        parts = parts.select(weight.alias("_weight"), *[col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)], "validation")
        n, w = len(cols), F.when(~F.col("validation"), F.col("_weight"))
        mean = [F.sum(w * F.col(f"_c{i}")) / F.sum(w) for i in range(n)]
        got = parts.agg(*[f.alias(f"m{i}") for i, f in enumerate(mean)]).first()
        centre = [got[f"m{i}"] or 0.0 for i in range(n)]
        got = parts.agg(*[F.sqrt(F.sum(w * F.pow(F.col(f"_c{i}") - centre[i], F.lit(2.0))) / F.sum(w)).alias(f"s{i}") for i in range(n)]).first()
        size = [got[f"s{i}"] or 1.0 for i in range(n)]
        scaled = [((F.col(f"_c{i}") - centre[i]) / size[i]).alias(f"_c{i}") for i in (n - 1, *range(n - 1))]
        lead = next(p for p, name in self._targets().items() if name == y)
        hook = None if self._on_epoch is None else lambda told: self._on_epoch(told | {"lead": lead})
        p, history = network.fitted(parts.select("_weight", *scaled, "validation"), self._layers(), self.quantiles, self.epochs, self.rate, self.seed, self.dropout, self.patience, hook)
        return {"x": [centre[:-1], size[:-1]], "y": [centre[-1], size[-1]], "layers": [a.tolist() for a in p], "history": history}

    def _outputs(self, state: dict, read: Callable[[str], Column] = col) -> dict[str, Column]:
        (mx, sx), (mt, st), layers = state["x"], state["y"], state["layers"]
        x = [(read(n).cast("double") - m) / s for n, m, s in zip(self.features, mx, sx, strict=True)]
        (a, b), (c, d) = layers[:2], layers[-2:]
        z = F.array(*[F.tanh(sum((x[i] * float(a[i][h]) for i in range(len(x))), F.lit(float(b[h])))) for h in range(len(b))])
        for w, bias in zip(layers[2:-2:2], layers[3:-2:2], strict=True):
            units = [[*map(float, column), float(v)] for column, v in zip(zip(*w, strict=True), bias, strict=True)]
            z = _dense(z, units)
        line = lambda k: sum((z[h] * float(c[h][k]) for h in range(len(c))), F.lit(float(d[k]))) * st + mt
        return {"mean": line(0)} | {q: line(i) for i, q in enumerate(self.quantiles, 1)}


class R2Evaluation:
    """A hook for fits of networks: keeps R2 of training and validation rows after each epoch, by lead, and logs it."""

    def __init__(self, log: bool = True):
        self.log, self.train_r2, self.val_r2 = log, {}, {}

    def __call__(self, told: dict) -> None:
        self.train_r2.setdefault(told["lead"], []).append(told["r2"])
        self.val_r2.setdefault(told["lead"], []).append(told["val_r2"])
        if self.log:
            logging.getLogger("tidegrid").info("lead %s, epoch %s: R2 %s, of validation rows %s", told["lead"], told["epoch"], told["r2"], told["val_r2"])


def shapley_contributions(model: TimeseriesRegressor, df: DataFrame, lead: int | None = None, output: str | float = "mean", orders: int = 8, seed: int = 0) -> DataFrame:
    """Adds ``{feature}_contribution`` and ``base``: how a prediction comes about from that at the features' means.

    Features are put in one after the other, in ``orders`` random orders and their reverses; what the prediction changes by
    is the feature's, on average over the orders. Contributions and the base sum to the prediction, for any model.
    """
    lead = model.predict_ahead[0] if lead is None else lead
    df, names, rng = model.engineered(df), list(model.features), np.random.default_rng(seed)
    means = df.agg(*[F.avg(col(c)).alias(c) for c in names]).first()
    found: dict[frozenset[str], str] = {}

    def with_own(own: frozenset[str]) -> str:
        return found.setdefault(own, f"_with_{len(found)}")

    chains = []
    for _ in range(orders):
        order = [names[i] for i in rng.permutation(len(names))]
        chains += [order, order[::-1]]
    steps = [(c, with_own(frozenset(order[: i + 1])), with_own(frozenset(order[:i]))) for order in chains for i, c in enumerate(order)]
    base = with_own(frozenset())
    out = df.withColumns({n: model.outputs(lead, lambda c, own=own: col(c) if c in own else F.lit(means[c]))[output] for own, n in found.items()})
    parts = {c: [F.col(a) - F.col(b) for name, a, b in steps if name == c] for c in names}
    out = out.withColumns({f"{c}_contribution": sum(own[1:], own[0]) / len(own) for c, own in parts.items()} | {"base": F.col(base)})
    return out.drop(*found.values())


def quantile_importances(model: TimeseriesRegressor, df: DataFrame, lead: int | None = None, seed: int = 0) -> DataFrame:
    """``feature, output, importance`` for the mean (absolute error) and each quantile (its loss): how much the loss grows
    when the feature's values are dealt anew."""
    lead = model.predict_ahead[0] if lead is None else lead

    def losses(rows: DataFrame) -> dict[str, float]:
        rows = make_shifted_target(rows, model.target, [lead], model.time_col, False, "_y", model.partition_by)
        error = {k: col(f"_y_lead_{lead}") - c - (col(model.target) if model.use_diff_of_y else 0) for k, c in model.outputs(lead).items()}
        row = rows.agg(*[F.avg(F.abs(e) if k == "mean" else tilted(e, k)).alias(str(k)) for k, e in error.items()]).first()
        return row.asDict()

    df = model.engineered(df)
    base = losses(df)
    out = [(c, k, v - base[k]) for i, c in enumerate(model.features) for k, v in losses(dealt_anew(df, c, seed * 1000 + i)).items()]
    return df.sparkSession.createDataFrame(out, "feature string, output string, importance double")


def dealt_anew(df: DataFrame, column: str, seed: int) -> DataFrame:
    """``df`` with the values of a column exchanged by rank of a random number inside 64 buckets of rows."""
    keyed = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(64)))
    a = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_id")))
    b = keyed.select("_b", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64("_id", F.lit(seed)))).alias("_r"), col(column).alias("_new"))
    return a.join(b, ["_b", "_r"]).withColumn(column, F.col("_new")).select(*df.columns)


def permutation_importances(model: TimeseriesRegressor, df: DataFrame, seed: int = 0) -> DataFrame:
    """``feature, importance``: how much the score falls when a feature's values are dealt anew. Values are exchanged by
    rank of a random number inside buckets of rows, so nothing is sorted as a whole."""
    df, plain = model.engineered(df), replace(model, engineer=None)
    base = plain.score(df)
    out = [(c, base - plain.score(dealt_anew(df, c, seed * 1000 + i))) for i, c in enumerate(model.features)]
    return df.sparkSession.createDataFrame(out, "feature string, importance double")


def importance_sums(importances: DataFrame, sep: str = "#") -> DataFrame:
    """Importances summed by name prefix, and the share of the whole."""
    found = importances.groupBy(F.substring_index("feature", sep, 1).alias("feature")).agg(F.sum("importance").alias("importance"))
    return found.withColumn("share", F.col("importance") / F.sum("importance").over(Window.partitionBy()))


def preprocess_data_for_benchmarking(df: DataFrame, cols: Sequence[str], target: str, time_col: str, freq: str, train_until: str, ffill_limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """As-of values on a grid, missing ones filled by the training means, split at ``train_until``."""
    from .cleaning import datetime_train_test_split
    from .reshaping import padded

    grid = padded(df, freq, [*cols, target], time_col, ffill_limit).dropna(subset=[target])
    train, test = datetime_train_test_split(grid, datetime=train_until, datecol=time_col)
    means = train.agg(*[F.avg(col(c)).alias(c) for c in cols]).first()
    fill = lambda part: part.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(means[c])) for c in cols})
    return fill(train), fill(test)


def benchmark_model(train: DataFrame, test: DataFrame, model: TimeseriesRegressor, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``lead, model, persistence, mean``: scores on the test rows of the model and of two baselines (the last known
    value, the training mean); by default mean squared errors."""
    scorer = scorer or (lambda y, p: F.avg((y - p) * (y - p)))
    model.fit(train)
    mean = train.agg(F.avg(col(model.target))).first()[0]
    rows = make_shifted_target(model.predict(test), model.target, list(model.predict_ahead), model.time_col, False, "_y", model.partition_by)
    parts = []
    for p in model.predict_ahead:
        y = col(f"_y_lead_{p}")
        known = lambda c, y=y: F.when(y.isNotNull(), c)
        parts.append(F.struct(F.lit(p).alias("lead"), scorer(y, known(col(f"predict_lead_{p}_mean"))).alias("model"), scorer(y, known(col(model.target).cast("double"))).alias("persistence"), scorer(y, known(F.lit(mean))).alias("mean")))
    return rows.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def benchmark_wrapper(models: Mapping[str, TimeseriesRegressor], datasets: Mapping[str, DataFrame], cols: Mapping[str, Sequence[str]], targets: Mapping[str, str], time_col: str, freq: str, train_until: Mapping[str, str], column_filter: Callable[[str], bool] = lambda name: True) -> DataFrame:
    """``dataset, method, lead, score`` of every model and both baselines on every wide table: each is brought to a grid,
    split, and filled before the models are fitted on the columns that pass ``column_filter``."""
    out = None
    for name, df in datasets.items():
        own = [c for c in cols[name] if column_filter(c)]
        train, test = preprocess_data_for_benchmarking(df, own, targets[name], time_col, freq, train_until[name])
        for k, (label, model) in enumerate(models.items()):
            made = replace(model, time_col=time_col, target=targets[name], features=own, state={})
            scores = benchmark_model(train, test, made).withColumnRenamed("model", label)
            scores = scores if not k else scores.drop("persistence", "mean")  # the baselines once
            long = scores.unpivot("lead", [c for c in scores.columns if c != "lead"], "method", "score").select(F.lit(name).alias("dataset"), "method", "lead", "score")
            out = long if out is None else out.unionByName(long)
    return out
