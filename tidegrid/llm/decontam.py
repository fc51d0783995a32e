"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, matched against all word windows.

A window is ``size`` consecutive words of an item (an item of fewer words is one window). Every document's windows are
hashed and looked up, hits are verified word by word, and the words inside verified occurrences are hit. Documents that
have hits can be dropped, or the hit spans cut out.

The hash set is broadcast while it holds at most ``most_windows`` windows (about 100 bytes each on a worker); a larger
benchmark is taken in blocks of that many windows, each a broadcast pass over the documents, and the hits of a document
are united by its row. Blocks are cut by item hash, and the driver reads one after the other.

Defined results: null texts have no words; an item without words has no windows; equal windows of several items count
for each; items with a null id hit as others do and count as one item without a name; rows with a null or repeated
``doc_id`` are judged each by itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import persisted, scope, small_batches
from .textcore import Words, slices, table_alnum, windows

#: Words of a window, and windows in one broadcast (about 200 MB on a worker).
SIZE, MOST_WINDOWS = 10, 2_000_000
HITS = "doc_id long, row long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


class Benchmark:
    """Windows of a block of items, by their length in words."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        text = pa.array([t for _, t in items], pa.string())
        self.names = [i for i, _ in items]
        found: dict[int, dict[int, list[tuple[int, bytes]]]] = {}
        for a, b, data, bounds in slices(text):
            w = Words(data, bounds, table_alnum())
            hashes = w.hashes()
            for i in range(b - a):
                first, end = int(w.first[i]), int(w.first[i + 1])
                length = min(size, end - first)
                if not length:
                    continue
                for k, h in enumerate(windows(hashes[first:end], length).tolist()):
                    found.setdefault(length, {}).setdefault(h, []).append((a + i, w.text(first + k, first + k + length)))
        self.by_length = {n: (np.array(sorted(v), np.uint64), v) for n, v in found.items()}

    def plain(self) -> tuple:
        """Its state as built-in types and arrays, for a broadcast."""
        return self.names, self.by_length

    @classmethod
    def of(cls, state: tuple) -> Benchmark:
        """From :meth:`plain`."""
        out = cls.__new__(cls)
        out.names, out.by_length = state
        return out

    def match(self, w: Words) -> tuple[list[list[tuple[int, int]]], list[set[str | None]]]:
        """By text the hit spans (first word, last word exclusive, in the text) and the items."""
        docs = len(w.first) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
        items: list[set[str | None]] = [set() for _ in range(docs)]
        hashes = w.hashes()
        for length, (keys, known) in self.by_length.items():
            run = windows(hashes, length)
            if not len(run):
                continue
            inside = w.doc[: len(run)] == w.doc[length - 1 :]
            at = np.minimum(np.searchsorted(keys, run), len(keys) - 1)
            for k in np.flatnonzero((keys[at] == run) & inside).tolist():
                text = w.text(k, k + length)
                own = [i for i, x in known[int(run[k])] if x == text]
                if own:
                    d = int(w.doc[k])
                    begin = k - int(w.first[d])
                    if spans[d] and spans[d][-1][1] >= begin and spans[d][-1][0] <= begin:
                        spans[d][-1] = (spans[d][-1][0], max(spans[d][-1][1], begin + length))
                    else:
                        spans[d].append((begin, begin + length))
                    items[d].update(self.names[i] for i in own)
        return [united(s) for s in spans], items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, most: int) -> tuple[int, Iterator[list[tuple[str | None, str | None]]]]:
    """How many blocks of about ``most`` windows the items make, and the blocks, each read when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    # Words cannot be more than half of the characters (and one).
    bound = items.agg(F.sum(F.length(F.coalesce("text", F.lit(""))) / 2 + 1)).first()[0] or 0
    parts = max(1, -(-int(bound) // most))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return parts, ([(r.item_id, r.text) for r in items.where(block == k).collect()] for k in range(parts))


def _scan(texts: DataFrame, block: Benchmark) -> DataFrame:
    """One pass of one block over all documents."""
    shared = texts.sparkSession.sparkContext.broadcast(block.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Benchmark.of(shared.value)
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(2)):
                w = Words(data, bounds, table_alnum())
                spans, items = own.match(w)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(w.first).astype(np.int64)),
                        pa.array([[{"first": x, "last": y} for x, y in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                        pa.array([sorted(i, key=lambda x: (x is None, x)) for i in items], pa.list_(pa.string())),
                    ],
                    ["doc_id", "row", "n_words", "spans", "items"],
                )

    return texts.select("doc_id", "row", "text").mapInArrow(run, HITS)


def hits(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """By row of ``docs``: ``doc_id, row, n_words, spans, items``; spans are hit words, in order and apart."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    count, blocks = _blocks(benchmark, most_windows)
    if count == 1:
        return _scan(texts, Benchmark(next(blocks), size))
    with scope() as here:
        texts = persisted(texts, "decontam-rows")  # row numbers must hold over several passes
        return here.result(_united(_passes(texts, blocks, size)), "decontam-hits")


def _passes(texts: DataFrame, blocks: Iterator[list], size: int) -> DataFrame:
    """The hits of each block, one pass after the other; each row is there once with its words, else where it has hits."""
    out = None
    for block in blocks:
        found = _scan(texts, Benchmark(block, size))
        found = persisted(found if out is None else found.where("size(spans) > 0"), "decontam-pass")
        out = found if out is None else out.unionByName(found)
    return out


def _united(passes: DataFrame) -> DataFrame:
    """The passes' hits, by row."""
    kind = "array<struct<first:long,last:long>>"
    ordered = F.array_sort(F.flatten(F.collect_list("spans")))
    joined = F.aggregate(
        ordered,
        F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["first"] <= F.element_at(acc, -1)["last"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], s["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return passes.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), joined.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select("doc_id", "row", "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The counts of the contract, by row."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _cut(part: pa.RecordBatch, k: int, data: np.ndarray, bounds: np.ndarray, w: Words, spans: list[list[tuple[int, int]]], drop_from: float) -> pa.RecordBatch:
    """A slice of rows without the hit ``spans`` of the texts in column ``k``, or without the row."""
    if not any(spans):
        return part
    counts = np.diff(w.first)
    texts, keep = part.column(k).to_pylist(), np.ones(len(part), bool)
    for i, own in enumerate(spans):
        if not own:
            continue
        if sum(y - x for x, y in own) >= drop_from * counts[i]:
            keep[i] = False
            continue
        raw, at, base = [], int(bounds[i]), int(w.first[i])
        for x, y in own:
            raw.append(data[at : w.start[base + x]].tobytes())
            at = int(w.end[base + y - 1])
        texts[i] = b"".join([*raw, data[at : bounds[i + 1]].tobytes()]).decode()
    return part.set_column(k, part.schema.names[k], pa.array(texts, part.column(k).type)).filter(pa.array(keep))


def cleaned(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE, most_windows: int = MOST_WINDOWS, drop_from: float = 0.5) -> DataFrame:
    """``docs`` without the hit spans: the characters from the first hit word to the last of each span are cut out.
    A document whose hit words are at least ``drop_from`` of its words goes. Columns are those of ``docs``; a column
    ``n_chars`` follows the text. A benchmark of several blocks takes a pass for each, and its spans meet the rows in a join."""
    small_batches(docs.sparkSession)
    names, kind = docs.columns, docs.schema
    k = names.index("text")
    count, blocks = _blocks(benchmark, most_windows)
    if count == 1:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(next(blocks), size).plain())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Benchmark.of(shared.value)
            for batch in batches:
                for a, b, data, bounds in slices(batch.column(k)):
                    w = Words(data, bounds, table_alnum())
                    yield _cut(batch.slice(a, b - a), k, data, bounds, w, own.match(w)[0], drop_from)

        out = docs.mapInArrow(run, kind)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.select(range(len(names)))
                found = batch.column(len(names)).to_pylist()
                for a, b, data, bounds in slices(batch.column(k)):
                    spans = [[(x["first"], x["last"]) for x in f or ()] for f in found[a:b]]
                    yield _cut(rows.slice(a, b - a), k, data, bounds, Words(data, bounds, table_alnum()), spans, drop_from)

        with scope() as here:
            number, spans = (_free(n, names) for n in ("_row", "_spans"))
            rows = persisted(docs.withColumn(number, F.monotonically_increasing_id()), "decontam-rows")
            texts = rows.select(F.lit(None).cast("long").alias("doc_id"), F.col(number).alias("row"), F.col("text").cast("string").alias("text"))
            hit = _united(_passes(texts, blocks, size)).where("size(spans) > 0").select(F.col("row").alias(number), F.col("spans").alias(spans))
            both = rows.join(hit, number, "left").select(*[F.col(f"`{n}`") for n in names], spans)
            out = here.result(both.mapInArrow(run, kind), "decontam-cleaned")
    return out.withColumn("n_chars", F.length("text").cast(kind["n_chars"].dataType)) if "n_chars" in names else out


def _free(name: str, taken: list[str]) -> str:
    """A column name that isn't taken, in any case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def items_digest(items: list[str]) -> str:
    """The digest of item names that :func:`digest` gives, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
