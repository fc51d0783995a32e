"""Small dense networks fitted on all rows of a table.

A round sends the parameters to the tasks; each task sums the gradients and losses of its rows, and one sum a parameter comes
back. The driver takes a step of Adam. Rows are written once as plain numbers. A table of few rows is summed on the driver: the
same sums, so the same fit but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import persisted, scope

#: Rows that are summed on the driver; beyond it, tasks sum.
LOCAL_ROWS = 20_000
#: Rows of a matrix product.
CHUNK = 4096

Sums = tuple[list[np.ndarray], np.ndarray]
Hook = Callable[[dict], bool | None]


def started(sizes: Sequence[int], seed: int) -> list[np.ndarray]:
    """Weights and biases in turn, for layers of these sizes."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:], strict=False):
        out += [rng.normal(0, 1 / np.sqrt(a or 1), (a, b)), np.zeros(b)]
    return out


def kept(rows: np.ndarray, units: int, layer: int, epoch: int, seed: int, share: float) -> np.ndarray:
    """Which units stay, by row, layer and epoch: a fixed function of their numbers, whatever task asks."""
    with np.errstate(over="ignore"):
        x = (rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ ((np.arange(units, dtype=np.uint64)[None] + np.uint64((seed * 1009 + epoch) * 64 + layer) * np.uint64(1 << 20)) * np.uint64(0xC2B2AE3D27D4EB4F))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53 < share


def summed(p: Sequence[np.ndarray], data: np.ndarray, quantiles: Sequence[float], dropout: float = 0.0, epoch: int = 0, seed: int = 0) -> Sums:
    """Of rows ``(number, validation, weight, target, features...)``: sums of the gradients, and a table of two lines, for
    training and validation rows: weight, losses, squared errors of the mean, targets and their squares, all weighted."""
    grads, told = [np.zeros_like(a) for a in p], np.zeros((2, 5))
    depth = len(p) // 2
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        number, check, w, t, x = part[:, 0], part[:, 1] > 0, part[:, 2], part[:, 3], part[:, 4:]
        layers, masks = [x], []
        for k in range(depth - 1):
            z = np.tanh(layers[-1] @ p[2 * k] + p[2 * k + 1])
            stay = kept(number, z.shape[1], k, epoch, seed, 1 - dropout) / (1 - dropout) if dropout else np.ones_like(z)
            stay[check] = 1.0  # validation rows see the whole network
            masks.append((z, stay))
            layers.append(z * stay)
        e = t[:, None] - (layers[-1] @ p[-2] + p[-1])
        g, loss = np.empty_like(e), e[:, 0] ** 2
        g[:, 0] = -2 * e[:, 0]
        for i, q in enumerate(quantiles, 1):
            g[:, i] = np.where(e[:, i] >= 0, -q, 1 - q)
            loss = loss + np.where(e[:, i] >= 0, q * e[:, i], (q - 1) * e[:, i])
        for side, own in ((0, ~check), (1, check)):
            v = w[own]
            told[side] += v.sum(), (v * loss[own]).sum(), (v * e[own, 0] ** 2).sum(), (v * t[own]).sum(), (v * t[own] ** 2).sum()
        g *= (w * ~check)[:, None]
        for k in range(depth - 1, -1, -1):
            grads[2 * k] += layers[k].T @ g
            grads[2 * k + 1] += g.sum(0)
            if k:
                z, stay = masks[k - 1]
                g = (g @ p[2 * k].T) * stay * (1 - z**2)
    return grads, told


def _over_tasks(table: DataFrame, p: list[np.ndarray], quantiles: Sequence[float], dropout: float, epoch: int, seed: int) -> Sums:
    shapes = [a.shape for a in p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            grads, told = summed(p, data, quantiles, dropout, epoch, seed)
            own = np.concatenate([*[g.ravel() for g in grads], told.ravel()])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

    rows = table.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a row for each parameter
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes) + 10)
    for r in rows:
        flat[r.k] = r.v
    grads, at = [], 0
    for s in shapes:
        grads.append(flat[at : at + int(np.prod(s))].reshape(s))
        at += int(np.prod(s))
    return grads, flat[at:].reshape(2, 5)


def scores(told: np.ndarray) -> dict[str, float | None]:
    """Mean loss and R2 of the mean, of training and validation rows (None without any)."""
    out = {}
    for name, (w, loss, squares, t, tt) in zip(("", "val_"), told, strict=True):
        spread = tt - t * t / w if w else 0.0
        out |= {f"{name}loss": loss / w if w else None, f"{name}r2": 1 - squares / spread if spread > 0 else None}
    return {k: None if v is None else float(v) for k, v in out.items()}


def fitted(rows: DataFrame, hidden: Sequence[int], quantiles: Sequence[float], epochs: int, rate: float, seed: int = 0, dropout: float = 0.0, patience: int | None = None, hook: Hook | None = None, local_rows: int = LOCAL_ROWS) -> tuple[list[np.ndarray], list[dict]]:
    """Parameters and, by epoch, the scores before its step. ``rows``: weight, target, features (all double), with a last
    column ``validation``. With ``patience`` the fit ends when the validation loss (without validation rows, the loss) has not
    fallen for so many epochs, and the best parameters stay. ``hook`` gets each epoch's scores with the ``epoch``'s number; what
    it returns as true ends the fit."""
    names = rows.columns
    table = rows.select(F.monotonically_increasing_id().cast("double").alias("_number"), F.col("validation").cast("double").alias("_check"), *[F.col(f"`{n}`") for n in names[:-1]])
    with scope():
        table = persisted(table, "network-rows")
        data = None
        if table.count() <= local_rows:
            data = table.toPandas().to_numpy(np.float64)
        p = started([len(names) - 3, *hidden, 1 + len(quantiles)], seed)
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        history, best, good, since = [], np.inf, [a.copy() for a in p], 0
        for step in range(1, epochs + 2):
            grads, told = summed(p, data, quantiles, dropout, step, seed) if data is not None else _over_tasks(table, p, quantiles, dropout, step, seed)
            now = scores(told) | {"epoch": step - 1}
            if not told[0, 0]:
                break
            if step > 1:
                history.append(now)
            loss = now["val_loss"] if now["val_loss"] is not None else now["loss"]
            if loss < best:
                best, good, since = loss, [a.copy() for a in p], 0
            else:
                since += 1
            if (step > 1 and hook is not None and hook(now)) or (patience is not None and since >= patience) or step > epochs:
                break
            for i, g in enumerate(grads):
                d = g / told[0, 0]
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return good if patience is not None else p, history
