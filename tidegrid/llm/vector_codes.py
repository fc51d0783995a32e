"""Product codes of vectors, by Lloyd rounds over integers that skip what triangle bounds rule out (Yinyang).

Components become integers (``floor(1024 x)``) and vectors are cut into equal parts, each with a codebook. The entries of a
codebook are clustered into groups once. Each row keeps, by part, its entry and one lower bound a group for all other entries
of it; as entries move, bounds shrink by the group's largest drift, and only groups whose bound is not above the distance to
the own entry are scanned. Bounds are rounded to the safe side, distances are exact integers, so the result is that of plain
rounds, ties included.

A round is one pass that writes the rows' new state and one that sums parts by entry; tasks send at most one sum an entry
and component. Codebooks are on the driver; they are bounded by their parameters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .store import Scope, persisted, scope

#: Integer steps of a unit.
SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Groups of a codebook's entries.
GROUPS = 16
#: Relative and absolute slack of bounds, far above rounding.
SLACK = 1e-9
#: Distances computed at once.
BLOCK = 1 << 20


def bounds_of(size: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and the end."""
    return [i * size // parts for i in range(parts + 1)]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: a matrix product where doubles hold every sum, else 64-bit integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    out, step = np.empty((len(x), len(c)), np.int64), max(1, BLOCK // max(1, c.size))
    for i in range(0, len(x), step):
        out[i : i + step] = ((x[i : i + step, None, :] - c[None]) ** 2).sum(2)
    return out


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a few rounds of plain k-means on the entries, begun at every so many."""
    x = entries.astype(np.float64)
    centers = x[:: max(1, -(-len(x) // groups))][:groups]
    for _ in range(rounds):
        own = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.stack([x[own == g].mean(0) if (own == g).any() else c for g, c in enumerate(centers)])
    return ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)


class Codebook:
    """One part's entries, their groups, and how far each has moved in the last round."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.group = entries, group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max(initial=-1)) + 1)]
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        self.drift = np.array([moved[m].max(initial=0.0) for m in self.members])

    def moved(self, entries: np.ndarray) -> Codebook:
        """After a round."""
        return Codebook(entries, self.group, self.entries)


def assign(x: np.ndarray, book: Codebook, code: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of integer rows (ties: the lower index), exact squared distances, lower bounds by group for all
    entries but the own one, and how many distances were computed. Without ``code`` and ``lower`` all groups are scanned."""
    n, groups = len(x), len(book.members)
    if code is None:
        best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book.entries), np.int64)
        near, computed = np.full((n, groups), -1.0), 0
    else:
        at = code.astype(np.int64)
        mine = book.entries[at]
        best = ((x - mine) ** 2).sum(1)
        near, computed = lower.astype(np.float64) * (1 - SLACK) - book.drift[None], n
    start, own = at.copy(), best.copy()
    first, second = np.full((n, groups), -1.0), np.full((n, groups), -1.0)
    which = np.full((n, groups), -1, np.int64)
    for g, members in enumerate(book.members):
        # The own distance is the upper bound; it can only fall as groups are scanned.
        rows = np.flatnonzero(near[:, g] <= np.sqrt(best.astype(np.float64)) * (1 + SLACK) + SLACK) if len(members) else np.zeros(0, int)
        if not len(rows):
            continue
        d = squared(x[rows], book.entries[members])
        computed += d.size
        k = d.argmin(1)
        least = d[np.arange(len(rows)), k]
        entry = members[k]
        first[rows, g], which[rows, g] = np.sqrt(least.astype(np.float64)), entry
        d[np.arange(len(rows)), k] = np.iinfo(np.int64).max
        second[rows, g] = np.where(len(members) > 1, np.sqrt(d.min(1).astype(np.float64)), np.inf)
        better = (least < best[rows]) | ((least == best[rows]) & (entry < at[rows]))
        best[rows[better]], at[rows[better]] = least[better], entry[better]
    seen = which >= 0
    bound = np.where(seen, np.where(which == at[:, None], second, first), near)
    if code is not None:
        # A group that was not scanned knows nothing of the entry that the row has left.
        left = np.flatnonzero((at != start) & ~seen[np.arange(n), book.group[start]])
        g = book.group[start[left]]
        bound[left, g] = np.minimum(bound[left, g], np.sqrt(own[left].astype(np.float64)))
    return at, best, np.nextafter((bound * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), computed


def integers(embeddings: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id, label, q`` (little-endian 64-bit integers) of the rows that are kept, and the length of their vectors.

    Rows whose vector is null or holds null or non-finite components go. So do those of another length than that of the
    smallest kept id, and those with a component whose squared distances fit no long (for 64 components beyond 2**27 steps)."""
    real = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", real.alias("x"))
    rows = rows.where("x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))")
    one = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).first()
    size = one[0] if one else 0
    limit = math.isqrt((1 << 62) // (4 * max(1, size)))
    rows = rows.where((F.size("x") == size) & F.forall("x", lambda v: F.abs(v * scale) < limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False) * scale).astype("<i8").reshape(len(batch), size)
            yield batch.set_column(2, "q", pa.array([r.tobytes() for r in x], pa.binary()))

    kind = StructType([*rows.select("vec_id", "label").schema.fields, StructField("q", BinaryType())])
    return rows.mapInArrow(run, kind), size


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _assigning(books: list[Codebook], size: int, fresh: bool, last: bool) -> Callable:
    """A pass over the rows: new entries and bounds; in the last one the codes and errors."""
    cuts = bounds_of(size, len(books))
    width = sum(len(b.members) for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column(2), "<i8", size)
            codes = None if fresh else _matrix(batch.column(3), np.uint8, len(books))
            lower = None if fresh else _matrix(batch.column(4), "<f4", width)
            at, errors, bounds, first = [], np.zeros(len(batch), np.int64), [], 0
            for p, book in enumerate(books):
                end = first + len(book.members)
                code, d, low, _ = assign(q[:, cuts[p] : cuts[p + 1]], book, None if fresh else codes[:, p], None if fresh else lower[:, first:end])
                at.append(code.astype(np.uint8))
                bounds.append(low.astype("<f4"))
                errors += d
                first = end
            both = np.stack(at, 1)
            if last:
                columns, names = [batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in both]), pa.array(errors)], ["vec_id", "label", "code", "error"]
            else:
                new = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (both, np.ascontiguousarray(np.concatenate(bounds, 1)))]
                columns, names = [*batch.columns[:3], *new], ["vec_id", "label", "q", "codes", "lower"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _summing(parts: int, entries: int, size: int) -> Callable:
    """Sums of the parts by entry, one row an entry and component (component -1: how many) at a task's end."""
    cuts = bounds_of(size, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros((entries, b - a), np.int64) for a, b in zip(cuts, cuts[1:], strict=False)], np.zeros((parts, entries), np.int64)
        for batch in batches:
            q, codes = _matrix(batch.column(0), "<i8", size), _matrix(batch.column(1), np.uint8, parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], q[:, cuts[p] : cuts[p + 1]])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            table = np.concatenate([counts[p][used, None], sums[p][used]], 1)
            k = np.arange(-1, table.shape[1] - 1)
            columns = [np.full(table.size, p), np.repeat(used, len(k)), np.tile(k, len(used)), table.ravel()]
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "component", "total"])

    return run


def _moved(state: DataFrame, books: list[Codebook], size: int) -> list[Codebook]:
    """The codebooks after a round: floors of the means; unused entries stay."""
    entries = max(len(b.entries) for b in books)
    sums = state.select("q", "codes").mapInArrow(_summing(len(books), entries, size), "part long, entry long, component long, total long")
    new, counts = [b.entries.copy() for b in books], {}
    rows = sums.groupBy("part", "entry", "component").agg(F.sum("total").alias("total")).collect()  # entries x components at most
    counts = {(r.part, r.entry): r.total for r in rows if r.component < 0}
    for r in rows:
        if r.component >= 0:
            new[r.part][r.entry, r.component] = r.total // counts[r.part, r.entry]
    return [b.moved(n) for b, n in zip(books, new, strict=True)]


def trained(rows: DataFrame, size: int, here: Scope, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, list[Codebook]]:
    """The last round's state (``vec_id, label, q, codes, lower``; as given where there was no round) and the codebooks.

    ``rows``: those of :func:`integers`. ``entries``: 256 at most. The codebooks begin as the parts of the smallest ids (ties by
    components, null ids last)."""
    if not 0 < entries <= 256:
        raise ValueError("codes take a byte: 1 to 256 entries")
    first = [np.frombuffer(r.q, "<i8") for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()]
    x = np.stack(first) if first else np.zeros((0, size), np.int64)
    cuts = bounds_of(size, parts)
    books = [Codebook(x[:, a:b].astype(np.int64), grouped(x[:, a:b], groups) if len(x) else np.zeros(0, np.int64)) for a, b in zip(cuts, cuts[1:], strict=False)]
    state, kind = rows, StructType([*rows.schema.fields, StructField("codes", BinaryType()), StructField("lower", BinaryType())])
    for k in range(rounds if first else 0):
        state = persisted(state.mapInArrow(_assigning(books, size, not k, False), kind), "codes-state")
        here.drop(but=1)
        books = _moved(state, books, size)
    return state, books


def codebooks_digest(books: list[Codebook]) -> str:
    """SHA-256 of all components, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def coded(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of the rows of ``embeddings`` (``vec_id``, ``embedding``,
    ``label``) that :func:`integers` keeps.

    ``code``: an index of two hexadecimal digits a part; ``error``: its squared distance in steps; ``label_error``: summed over
    equal labels (nulls together). Null and repeated ids are rows like others. No row that is kept gives an empty table. Extra
    columns are ignored."""
    with scope() as here:
        rows, size = integers(embeddings, scale)
        rows = persisted(rows, "codes-rows")
        state, books = trained(rows, size, here, parts, entries, rounds)
        fresh = "codes" not in state.columns
        kind = StructType([*rows.select("vec_id", "label").schema.fields, *StructType.fromDDL("code string, error long").fields])
        found = persisted(state.mapInArrow(_assigning(books, size, fresh, True), kind), "codes-final")
        totals = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
        out = found.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
        return here.result(out, "codes")
