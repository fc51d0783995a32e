"""Similarity join of vectors by cosine, by pigeonholes over the blocks of a rotation.

Unit vectors with cosine ``t`` or more lie within a squared distance of ``2 - 2t``. After a fixed rotation that spreads every
direction, vectors are cut into blocks, each with a share of that budget in proportion to its dimensions: a pair within
the budget is within the share in one block at least. Each block is range-joined by a grid over its first dimensions, twice as
wide as the share's radius. A row lies in its home cell and is sent on to the later cells that its ball touches, so each pair
within reach meets in one cell of a block.

Rows travel as 16-bit integers. Pigeonholes are decided on them exactly, with budgets widened by the rounding; a pair counts
in the first block that finds it, so that the union of all blocks needs no pairs. Distances that rounding leaves open are
decided by the vectors themselves: cosine in double precision, and rational arithmetic within 1e-12 of the threshold.

Equal vectors are joined as one. Pairs are never emitted: a cell's task counts links by row and sends on a spanning star of
what it has connected. A cell with many rows is split, and tasks meet its parts two by two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import persisted, scope

#: Dimensions of a block, about; of these, dimensions of the grid.
BLOCK, GRID = 16, 2
#: Integer steps of a unit.
SCALE = 32767
#: Rows of a part of a cell: a task holds two parts.
PART_ROWS = 32768
#: Rows that are compared with others at once, and candidates that are looked at at once.
STRIP, CANDIDATES = 512, 1 << 17
#: Within this of the threshold a cosine is decided by rational arithmetic.
CLOSE = 1e-12
#: A cell's coordinates lie within this on either side.
SPAN = 1 << 15


def cuts_of(size: int, block: int = BLOCK) -> list[int]:
    """Where blocks begin, and the end."""
    n = max(1, round(size / block))
    return [i * size // n for i in range(n + 1)]


def budgets_of(size: int, threshold: float, block: int = BLOCK) -> tuple[list[int], list[int]]:
    """Blocks, and the squared distance in steps that each may have: shares of the whole one, widened by the rounding."""
    cuts = cuts_of(size, block)
    whole = math.ceil((SCALE * math.sqrt(max(0.0, 2 - 2 * threshold)) + math.sqrt(size) + 1) ** 2)
    return cuts, [-(-whole * (b - a) // size) for a, b in zip(cuts, cuts[1:], strict=False)]


def rotation(size: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]


def units(x: np.ndarray) -> np.ndarray:
    """Rows by their length, whatever their magnitude."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows have a cosine of ``threshold`` or more."""
    a, b = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    cosine = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
    out, bound = cosine >= threshold, Fraction(str(threshold))
    for k in np.flatnonzero(np.abs(cosine - threshold) <= CLOSE):
        p, q = ([Fraction(v) for v in z[k].tolist()] for z in (x, y))
        dot = sum(u * v for u, v in zip(p, q, strict=True))
        least = bound * abs(bound) * sum(u * u for u in p) * sum(v * v for v in q)
        out[k] = dot * abs(dot) >= least
    return out


def usable(column: str = "embedding") -> Column:
    """Not null, all components finite, not all zero."""
    x = F.col(column).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & whole & F.exists(x, lambda v: v != 0), F.lit(False))


def placed(distinct: DataFrame, threshold: float) -> DataFrame:
    """Each vector in its home cell of every block, and in the later cells that its ball touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                some = batch.take(pa.array(rows))
                x = some.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
                if size not in turns:
                    turns[size] = rotation(size)
                q = np.rint(units(x) @ turns[size] * SCALE).astype("<i2")
                raw = pa.array([r.tobytes() for r in q], pa.binary())
                cuts, budgets = budgets_of(size, threshold)
                for b, budget in enumerate(budgets):
                    radius, dims = math.isqrt(budget) + 1, list(range(cuts[b], min(cuts[b] + GRID, cuts[b + 1])))
                    at = q[:, dims].astype(np.int64)
                    home = np.floor_divide(at, 2 * radius)
                    # A ball as wide as a cell touches its cell and at most one neighbour on either side.
                    for step in np.stack(np.meshgrid(*[[-1, 0, 1]] * len(dims), indexing="ij"), -1).reshape(-1, len(dims)):
                        if tuple(step) < (0,) * len(dims):
                            continue
                        cell = home + step
                        low, high = cell * 2 * radius, (cell + 1) * 2 * radius - 1
                        near = ((at + radius >= low) & (at - radius <= high)).all(1)
                        k = np.flatnonzero(near)
                        if not len(k):
                            continue
                        code = np.zeros(len(k), np.int64)
                        for d in range(len(dims)):
                            code = code * (2 * SPAN) + cell[k, d] + SPAN
                        take, at_home = pa.array(k), not step.any()
                        columns = [pa.array(np.full(len(k), size, np.int64)), pa.array(np.full(len(k), b, np.int64)), pa.array(code), pa.array(np.full(len(k), at_home)), some.column(0).take(take), some.column(1).take(take), raw.take(take)]
                        yield pa.RecordBatch.from_arrays(columns, ["size", "block", "cell", "home", "key", "times", "q"])

    return distinct.select("key", "times", "x").mapInArrow(run, "size long, block long, cell long, home boolean, key long, times long, q binary")


def tiled(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows of cells by tile ``(i, j)``: part ``i`` of the home rows meets part ``j``, of home rows or (behind those) of others."""
    cell = ["size", "block", "cell"]
    counts = rows.groupBy(cell).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("others")).where("homes > 0 and homes + others > 1")
    parts = counts.select(*cell, F.ceil(F.col("homes") / part_rows).alias("m"), F.ceil(F.col("others") / part_rows).alias("n"))
    rows = rows.join(parts, cell).withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("home"), F.col("m")).otherwise(F.col("n"))))
    tile = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    left = F.transform(F.sequence("own", F.col("m") + F.col("n") - 1), lambda j: tile(F.col("own"), j, False))
    earlier = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("own")), lambda i: tile(i, F.col("own"), True)), lambda t: t["i"] < t["j"])
    other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda i: tile(i, F.col("m") + F.col("own"), True))
    return rows.withColumn("tile", F.explode(F.when(F.col("home"), F.concat(left, earlier)).otherwise(other))).select(*cell, "tile.i", "tile.j", "tile.right", "key", "times", "q")


class Forest:
    """Connected rows of a tile, by their smallest row."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p, q = self.low[a], self.low[b]
            apart = p != q
            if not apart.any():
                return
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(self.low, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(up := self.low[self.low], self.low):
                self.low = up


def matched(size: int, block: int, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``(a, b, n)`` of one tile. Sides are ``(key, times, q)``; no right side: the left one with itself.

    ``n > 0``: row ``a`` has ``n`` links here and is connected with ``b``. ``n = 0``: the pair ``(a, b)`` is left open."""
    cuts, budgets = budgets_of(size, threshold)
    a, b, budget = cuts[block], cuts[block + 1], budgets[block]
    sort = min(a + GRID, b - 1)
    reach, rounding = SCALE * math.sqrt(max(0.0, 2 - 2 * threshold)), math.sqrt(size) + 1
    radius = math.isqrt(budget) + 1

    def side(rows: tuple[np.ndarray, ...], flip: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(rows[2][:, sort], kind="stable")
        key, times, q = (x[order] for x in rows)
        z = q[:, a:b].astype(np.float32) / SCALE
        half, one = -(z * z).sum(1, keepdims=True) / 2, np.ones((len(z), 1), np.float32)
        return key, times, q, np.concatenate([z, half, one] if flip else [z, one, half], 1)

    one = side(left, False)
    other = side(left if right is None else right, True)
    shift = 0 if right is None else len(one[0])
    keys, times = (one[0], one[1]) if right is None else (np.concatenate([x, y]) for x, y in zip(one[:2], other[:2], strict=True))
    counts, forest = np.zeros(len(keys), np.int64), Forest(len(keys))
    least = np.float32(-budget / SCALE**2 / 2 - 1e-5)
    for s in range(0, len(one[0]), STRIP):
        e = min(s + STRIP, len(one[0]))
        low, high = int(one[2][s, sort]) - radius, int(one[2][e - 1, sort]) + radius
        f = s if right is None else int(np.searchsorted(other[2][:, sort], low, "left"))
        t = int(np.searchsorted(other[2][:, sort], high, "right"))
        for g in range(f, t, STRIP * 16):
            h = min(g + STRIP * 16, t)
            near = np.flatnonzero((one[3][s:e] @ other[3][g:h].T).ravel() >= least)
            for k in range(0, len(near), CANDIDATES):
                i, j = np.divmod(near[k : k + CANDIDATES], h - g)
                i, j = i + s, j + g
                if right is None:
                    i, j = i[j > i], j[j > i]
                d = one[2][i].astype(np.int64) - other[2][j]
                by_block = np.add.reduceat(d * d, cuts[:-1], axis=1)
                here = (by_block[:, block] <= budget) & ~(by_block[:, :block] <= np.array(budgets[:block])).any(1)
                i, j, far = i[here], j[here] + shift, np.sqrt(by_block[here].sum(1))
                sure, open_ = far + rounding <= reach, np.abs(far - reach) < rounding
                if open_.any():
                    yield keys[i[open_]], keys[j[open_]], np.zeros(int(open_.sum()), np.int64)
                i, j = i[sure], j[sure]
                if len(i):
                    np.add.at(counts, i, times[j])
                    np.add.at(counts, j, times[i])
                    forest.join(i, j)
    found = np.flatnonzero(counts)
    yield keys[found], keys[forest.low[found]], counts[found]


def met(tiles: DataFrame, threshold: float) -> DataFrame:
    """The rows of :func:`matched` for all tiles."""

    def run(group: pa.Table) -> pa.Table:
        size, block = group.column("size")[0].as_py(), group.column("block")[0].as_py()
        right = group.column("right").to_numpy()

        def rows(k: np.ndarray) -> tuple[np.ndarray, ...]:
            some = group.take(pa.array(np.flatnonzero(k)))
            return some.column("key").to_numpy(), some.column("times").to_numpy(), np.frombuffer(b"".join(some.column("q").to_pylist()), "<i2").reshape(-1, size)

        alone = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        parts = list(matched(size, block, rows(~right), None if alone else rows(right), threshold)) if (~right).any() and (alone or right.any()) else []
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "n"])

    return tiles.groupBy("size", "block", "cell", "i", "j").applyInArrow(run, "a long, b long, n long")


def decided(pairs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` that the vectors link, with the copies of each side."""
    one, other = (distinct.select(F.col("key").alias(k), F.col("times").alias(f"{k}_times"), F.col("x").alias(f"{k}_x")) for k in ("a", "b"))
    both = pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "a_times", "b_times", "a_x", "b_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keep = batch.column(4).value_lengths().to_numpy(), np.zeros(len(batch), bool)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x, y = (batch.column(c).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) for c in (4, 5))
                keep[rows] = linked(x, y, threshold)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long, a_times long, b_times long")


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, part_rows: int = PART_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``embeddings`` (``vec_id``, ``embedding``).

    Rows link whose vectors have a cosine of ``threshold`` (0 to 1) or more; vectors of different lengths don't. Rows without an id,
    and vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, their own id
    as component (null without one), kept. Rows of a repeated id are vectors each by itself. ``kept``: the id is the
    component's smallest. Extra columns are ignored; an empty table gives no rows."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x")).withColumn("use", usable("x") & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})
    with scope() as here:
        # Copies are told by 128 bits of hash; those that differ in them (as by a negative zero) are linked by their cosine.
        distinct = rows.where("use").groupBy("h1", "h2").agg(F.first("x").alias("x"), F.count("*").alias("times"), F.min("vec_id").alias("low"))
        distinct = persisted(distinct.withColumn("key", F.monotonically_increasing_id()), "vectors-distinct")
        cells = persisted(placed(distinct, threshold), "vectors-cells")
        found = persisted(met(tiled(cells, part_rows), threshold), "vectors-met")
        sure = persisted(decided(found.where("n = 0"), distinct, threshold), "vectors-decided")
        counts = found.where("n > 0").select(F.col("a").alias("key"), "n").unionByName(sure.select(F.col("a").alias("key"), F.col("b_times").alias("n"))).unionByName(sure.select(F.col("b").alias("key"), F.col("a_times").alias("n")))
        nodes = components(found.where("n > 0 and a != b").select("a", "b").unionByName(sure.select("a", "b")), "vectors-components")
        nodes = nodes.join(distinct.select(F.col("key").alias("node"), "low"), "node")
        lows = nodes.groupBy("component").agg(F.min("low").alias("least"))
        by_key = distinct.select("key", "h1", "h2", "times", "low").join(counts.groupBy("key").agg(F.sum("n").alias("n")), "key", "left")
        by_key = by_key.join(nodes.join(lows, "component").select(F.col("node").alias("key"), "least"), "key", "left")
        by_key = by_key.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("least", "low").alias("least"), F.lit(True).alias("use"))
        out = rows.drop("x").join(by_key, ["h1", "h2", "use"], "left")
        out = out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
        return here.result(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vectors-near")
