"""Connected components of a link table, by alternating large-star and small-star contraction.

The tasks that make the links contract theirs to stars at once, in blocks of at most ``BLOCK``. As long as more than one
block is left, each round is two grouped minima and joins over the links alone; a vertex with very many links is reduced
by partial aggregation, never gathered. What fits a block is finished in a task, without a shuffle. Rounds are written to
the shared folder. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import persisted, scope

#: Links that a task contracts at once (about 150 MB).
BLOCK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links ``a, b`` in order, and by node the smallest one that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # x and y are roots: a root goes below a smaller one
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _contracted(names: tuple[str, str], roots: bool):
    """The links of a task as stars, block by block; with ``roots`` also a row for each smallest node."""

    def made(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in batches]) for i in (0, 1))
        nodes, least = stars(a, b)
        keep = np.flatnonzero((nodes != least) | roots)
        for i in range(0, len(keep), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[keep[i : i + 100_000]]) for v in (nodes, least)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(map(len, held)) + len(batch) > BLOCK:
                yield from made(held)
                held = []
            held.append(batch)
        if held:
            yield from made(held)

    return run, f"{names[0]} long, {names[1]} long"


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links ``u > v``."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``links``: two long columns ``a, b`` (nulls and self-links are ignored). Returns ``node, component`` for every
    node that has a link; ``component`` is the smallest node that it reaches. No links give no rows."""
    links = links.where("a is not null and b is not null and a != b").select("a", "b")
    small, kind = _contracted(("u", "v"), False)
    last, kind_out = _contracted(("node", "component"), True)
    with scope() as here:
        now, seen = persisted(links.mapInArrow(small, kind), label), None
        while True:
            state = now.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if state[0] <= BLOCK:
                return here.result(now.coalesce(1).mapInArrow(last, kind_out), label)
            if state == seen:
                break
            seen = state
            now = persisted(_starred(_starred(now, True), False), label)
            here.drop(but=1)
        found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        return here.result(found, label)
