"""Exact penalised linear quantile regression over tables of any length.

The loss is convex and piecewise linear, so a corner of it is a solution: a point at which as many residuals (or weights) are
zero as there are unknowns. From a near solution, rows whose residual is far from zero keep their side: they count as sums
only. The few rows near zero come to the driver, where the corner is found by walking along edges. As a side that is kept
can only lower a row's loss, a corner at which no row has changed sides is a solution for the whole table; else the next round
begins at the best point on the way to it. Corners are looked for in a box around the last point, which grows and shrinks with
success.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows near zero that may come to the driver.
MOST_ROWS = 20_000
#: Widths of the band around zero that are counted at once, each half of the last.
WIDTHS = 48


def _line_search(e: np.ndarray, z: np.ndarray, weight: np.ndarray, slope: float) -> tuple[float, int] | None:
    """How far to go where the residuals ``e`` fall by ``z`` a step, and the row whose residual is zero there."""
    with np.errstate(divide="ignore", invalid="ignore"):
        t = e / z
    rows = np.flatnonzero((np.abs(z) > 1e-13) & (t > 0))
    rows = rows[np.argsort(t[rows], kind="stable")]
    k = int(np.searchsorted(slope + np.cumsum(weight[rows] * np.abs(z[rows])), 0.0, "left"))
    return (float(t[rows[k]]), int(rows[k])) if k < len(rows) else None


def corner(x: np.ndarray, y: np.ndarray, up: np.ndarray, down: np.ndarray, pull: np.ndarray, start: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """The ``w`` of the least ``sum(up * max(e, 0) + down * max(-e, 0)) + pull @ w`` with ``e = y - x @ w``."""
    p = x.shape[1]
    size = np.maximum(np.abs(x).max(0, initial=0.0), 1e-300)
    total, unit = float((up + down).sum()) or 1.0, float(np.abs(y).max(initial=0.0)) or 1.0
    # Ties are told apart by tiny shifts that the last step takes back; weights that no row holds are held by their start.
    w = start * size / unit
    x = np.vstack([x / size, np.eye(p)])
    plain = np.concatenate([y / unit, w])
    y = plain + np.concatenate([1e-10 * np.random.default_rng(0).uniform(-1, 1, len(x) - p), np.zeros(p)])
    up, down = (np.concatenate([v / total, np.full(p, 1e-13)]) for v in (up, down))
    pull, both = pull / size / total, up + down
    active: list[int] = []
    w = w + 1e-11 * np.random.default_rng(1).uniform(0.5, 1, p)  # no row is at zero by chance
    while len(active) < p:
        e = y - x @ w
        e[active] = 0.0
        free = np.eye(p) if not active else np.linalg.svd(x[active])[2][len(active) :].T
        slope = pull - x.T @ np.where(e > 0, up, np.where(e < 0, -down, 0.0))
        d = -free @ (free.T @ slope)
        if np.abs(d).max() < 1e-14:
            d = free[:, 0]
        d = d / np.abs(d).max()
        z = x @ d
        z[active] = 0.0
        found = _line_search(e, z, both, float(slope @ d)) or _line_search(e, -z, both, float(-slope @ d))
        if found is None:
            break
        w = w + found[0] * (d if _line_search(e, z, both, float(slope @ d)) else -d)
        active.append(found[1])
    for _ in range(steps if len(active) == p else 0):
        e = y - x @ w
        e[active] = 0.0
        edges = np.linalg.inv(x[active])
        base = (pull - x.T @ np.where(e > 0, up, np.where(e < 0, -down, 0.0))) @ edges
        rates = np.concatenate([base + down[active], up[active] - base])
        rates = rates / np.tile(np.abs(edges).max(0), 2)
        k = int(rates.argmin())
        if rates[k] >= -1e-12:
            break
        j, sign = k % p, 1.0 if k < p else -1.0
        d = sign * edges[:, j]
        z = x @ d
        z[[a for a in active if a != active[j]]] = 0.0
        mine, z[active[j]] = active[j], 0.0
        found = _line_search(e, z, both, float(base[j] + down[mine] if sign > 0 else up[mine] - base[j]))
        if found is None:
            break
        w, active[j] = w + found[0] * d, found[1]
        if np.linalg.cond(x[active]) < 1e12:
            w = np.linalg.solve(x[active], y[active])
    if len(active) == p and np.linalg.cond(x[active]) < 1e12:
        w = np.linalg.solve(x[active], plain[active])
    return w * unit / size


def fitted(rows: DataFrame, x: Sequence[Column], y: Column, q: float, start: np.ndarray, weight: Column, alpha: float = 0.0, free: Sequence[int] = (), rounds: int = 30, most: int = MOST_ROWS) -> np.ndarray:
    """Weights of the least ``mean loss + alpha * sum(|w|)`` (means by ``weight``; those of ``free`` columns cost nothing).

    Rows with a missing value are left out. Should more than ``most`` rows lie on one hyperplane beyond telling apart, or
    ``rounds`` not suffice, the best point so far is the result."""
    p = len(x)
    table = rows.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)], y.cast("double").alias("y"), weight.cast("double").alias("s")).dropna()
    cost = np.array([0.0 if i in set(free) else alpha for i in range(p)])
    residual = lambda w: F.col("y") - sum((F.col(f"x{i}") * float(v) for i, v in enumerate(w)), F.lit(0.0))
    loss = lambda e: F.sum(F.col("s") * F.when(e >= 0, e * q).otherwise(e * (q - 1)))
    now = np.asarray(start, float)
    first = table.agg(F.sum("s").alias("s"), F.count("*").alias("n"), F.max(F.abs(residual(now))).alias("e"), *[F.max(F.abs(F.col(f"x{i}"))).alias(f"m{i}") for i in range(p)]).first()
    if not first.n or not first.s:
        return now
    size = np.array([first[f"m{i}"] or 1.0 for i in range(p)])
    reach, axes, bound = 4 * (first.e or 1.0) / size, np.diag(size), first.s * cost / size
    wall = 4 * (first.s + bound)
    for _ in range(rounds):
        e, band = residual(now), np.inf
        if first.n > most:
            widest = table.agg(F.max(F.abs(e))).first()[0]
            counts = table.agg(*[F.count_if(F.abs(e) <= widest / 2**k).alias(f"c{k}") for k in range(1, WIDTHS)]).first()
            band = next((widest / 2**k for k in range(1, WIDTHS) if counts[f"c{k}"] <= most), widest / 2**WIDTHS)
        far = F.when(e > band, F.lit(-q)).when(e < -band, F.lit(1 - q)).otherwise(F.lit(0.0))
        pull = np.array([v or 0.0 for v in table.agg(*[F.sum(far * F.col("s") * F.col(f"x{i}")) for i in range(p)]).first()])
        near = table.where(F.abs(e) <= band).groupBy("y", *[f"x{i}" for i in range(p)]).agg(F.sum("s").alias("s")).limit(4 * most).collect()
        held = np.array([[r.y, r.s, *(r[f"x{i}"] for i in range(p))] for r in near]).reshape(-1, p + 2)
        goals = np.concatenate([held[:, 0], np.zeros(p), size * (now + reach), size * (now - reach)])
        up, down = np.concatenate([q * held[:, 1], bound, np.zeros(p), wall]), np.concatenate([(1 - q) * held[:, 1], bound, wall, np.zeros(p)])
        new = corner(np.vstack([held[:, 2:], axes, axes, axes]), goals, up, down, pull, now)
        inside = (np.abs(new - now) < 0.999 * reach).all()
        # How many rows have changed sides, and the losses on the way.
        at = [now + (new - now) / 2**k for k in range(12)]
        f = residual(new)
        crossed = F.count_if(((e > band) & (f < 0)) | ((e < -band) & (f > 0)))
        row = table.agg(crossed.alias("crossed"), *[loss(residual(w)).alias(f"l{k}") for k, w in enumerate([*at, now])]).first()
        total = [row[f"l{k}"] / first.s + float(cost @ np.abs(w)) for k, w in enumerate([*at, now])]
        if not row.crossed and inside and len(near) < 4 * most:
            return new
        best = int(np.argmin(total))
        if best < len(at):
            now = at[best]
        reach = reach * 4 if best == 0 else reach / 4 if best > 2 else reach
        if (reach * size).max() < 1e-12 * (first.e or 1.0):
            break
    return now
