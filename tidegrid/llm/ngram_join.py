"""Exact similarity join of documents on word shingles, by a grouped prefix join.

A document's set holds its distinct shingles; two documents link when the Jaccard similarity reaches ``percent``. Under
one order of all shingles (frequent ones last, by a bounded summary of every partition's counts; the order affects cost,
never results) two sets that link share a shingle among their first ``n - ceil(percent n) + 1``: the prefix.

1. Documents with the same prefix and size become one group, so copies and near copies meet before any join.
2. Groups meet by prefix shingle. In each bucket, as in each group, neighbours by size are candidates (a chain, not all
   pairs), filtered by size and by exact bounds, and verified.
3. Verified links give components. Buckets and groups that lie in one component are done. The others are expanded to
   members; buckets with the same groups are taken once. In each, the documents are held against the one that shares
   most of its prefix with others, which links most of a family of copies at once.
4. In the buckets that are still open, all pairs across components that pass the filters are verified. No link between
   two components can be missed, so the components are those of all links.

The filters are exact. Size: one set has at least ``percent`` of the other's shingles. Place: with their first common
shingle at places i and j, two sets share at most the shingles from there on, so a pair is taken only in buckets where
that suffices; the bucket of the first common shingle is one of them for every pair that links. Difference: bits that
differ between two parity bitmaps never exceed the symmetric difference; a short bitmap is compared first, and for sets
too large for it a long one that follows the size of the set.

Sets are sent only for the members of pairs that pass all filters. All joins are between tables; the driver holds the
bounded summary of frequent shingles and a few counts.

Defined results: a null, empty or blank text has no shingles and links with nothing; a text of fewer words than a
shingle is one shingle; equal sets always link; rows that share a ``doc_id`` are one vertex with the links of all; a
null ``doc_id`` links with nothing and its component is null; other columns are ignored, whatever their names.
Shingles are compared by 64-bit hashes (in verification by the upper 48 bits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import persisted, scope, small_batches
from .textcore import Words, mix, slices, table_white, tidy, windows

#: Longs of the short parity bitmap. Sets of more shingles than LOOSE have a long one too, of 4 to 8 bits a shingle.
BITMAP, LOOSE = 16, 512
#: Shingles of more than two to this power documents are chained in several tasks.
SALT_FROM = 12
#: Distinct sets that a task remembers, so as to leave out copies early (it then starts anew; copies meet later on).
REMEMBERED = 500_000
#: Shingles that the summary of frequent ones keeps in a task and in all.
TASK_TOP, TOP, AT_LEAST = 20_000, 100_000, 4
#: Document ids that a semi-join may broadcast (16 MB); beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of consecutive texts, and by text the position of its first (one more at the end)."""
    w = Words(data, bounds, table_white(lower=True))
    hashes, counts = w.hashes(), np.diff(w.first)
    run = windows(hashes, words)
    starts = np.flatnonzero(w.doc[: len(run)] == w.doc[words - 1 :]) if len(run) else np.zeros(0, np.int64)
    shingle, doc = run[starts], w.doc[starts]
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        short = [windows(hashes[w.first[d] : w.first[d + 1]], int(counts[d]))[0] for d in few]
        shingle, doc = np.concatenate([shingle, np.array(short, np.uint64)]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        shingle, doc = shingle[order], doc[order]
    begin = np.searchsorted(doc, np.arange(len(bounds)))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        shingle[a:b].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    shingle, doc = shingle[new], doc[new]
    return shingle, np.searchsorted(doc, np.arange(len(bounds)))


def prefix_size(n, percent: int):
    """Shingles of a set of ``n`` that must hold one of any set that links with it."""
    return n - (n * percent + 99) // 100 + 1


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        return total[first[1:]] - total[first[:-1]]


def set_keys(shingle: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set."""
    return mix(_sum_by(mix(shingle), first)), mix(_sum_by(mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), first))


def counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their times."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


def long_maps(shingle: np.ndarray, first: np.ndarray) -> pa.Array:
    """Parity bitmaps of sets of more than ``LOOSE`` shingles, of a power of two of bits (4 to 8 a shingle); else null."""
    n = np.diff(first)
    large = n > LOOSE
    bits = np.where(large, 1 << np.ceil(np.log2(np.maximum(4 * n, 8))).astype(np.int64), 0)
    base = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(n)), n)
    of = large[doc]
    at = base[doc[of]] + (mix(shingle[of]) & (bits[doc[of]] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)
    raw = np.packbits(odd, bitorder="little") if len(odd) else np.zeros(0, np.uint8)
    empty = pa.py_buffer(np.packbits(large, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(n), [empty, pa.py_buffer(base // 8), pa.py_buffer(raw)]).cast(pa.binary())


def apart(x: bytes, y: bytes) -> int:
    """Bits that differ between two long bitmaps; the larger is folded to the size of the smaller."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _profiles(words: int):
    """By document its size, key and bitmaps; at the end of the task its frequent shingles as rows with ``heavy``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, top_count, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), set()
        names = ["doc_id", "n", "k1", "k2", "bitmap", "long_map", "heavy", "times"]
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(1)):
                shingle, first = shingle_sets(data, bounds, words)
                n = np.diff(first)
                k1, k2 = set_keys(shingle, first)
                doc = np.repeat(np.arange(b - a), n)
                bits = np.bincount(doc * (64 * BITMAP) + (shingle & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=(b - a) * 64 * BITMAP) & 1
                maps = np.packbits(bits.astype(np.uint8).reshape(-1, 64 * BITMAP), axis=1).reshape(-1).view("<i8")
                maps = pa.FixedSizeListArray.from_arrays(pa.array(maps), BITMAP).cast(pa.list_(pa.int64()))
                if len(seen) > REMEMBERED:
                    seen.clear()
                fresh = np.zeros(b - a, bool)
                for i, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                top, top_count = counted(np.concatenate([shingle[fresh[doc]], top]), np.concatenate([np.ones(int(n[fresh].sum()), np.int64), top_count]))
                if len(top) > TASK_TOP:
                    keep = np.argpartition(-top_count, TASK_TOP)[:TASK_TOP]
                    top, top_count = top[keep], top_count[keep]
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), maps, long_maps(shingle, first), none, none], names)
        often = top_count >= AT_LEAST
        if often.any():
            m = int(often.sum())
            empty = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary()), pa.array(top[often].view(np.int64)), pa.array(top_count[often])], names)

    return run, "doc_id long, n long, k1 long, k2 long, bitmap array<long>, long_map binary, heavy long, times long"


def _prefixes(words: int, percent: int, heavy: np.ndarray, tier: np.ndarray):
    """By distinct set of a task its group key and prefix; the order is by tier, then by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(1)):
                shingle, first = shingle_sets(data, bounds, words)
                n = np.diff(first)
                k1, k2 = set_keys(shingle, first)
                doc = np.repeat(np.arange(b - a), n)
                at = np.minimum(np.searchsorted(heavy, shingle), max(len(heavy) - 1, 0))
                rank = np.where(heavy[at] == shingle, tier[at], 0) if len(heavy) else np.zeros(len(shingle), np.int8)
                order = np.argsort(doc * 64 + rank, kind="stable")  # hashes are in order already
                shingle = shingle[order]
                take = np.arange(len(shingle)) - first[:-1][doc] < prefix_size(n, percent)[doc]
                prefix, of = shingle[take], doc[take]
                begin = np.searchsorted(of, np.arange(b - a + 1))
                g1, g2 = set_keys(prefix, begin)
                ids = batch.column(0).slice(a, b - a)
                good = np.flatnonzero((n > 0) & np.asarray(ids.is_valid()))
                rows = []
                if len(seen) > REMEMBERED:
                    seen.clear()
                for i in good.tolist():
                    key = (int(k1[i]), int(k2[i]))
                    if key not in seen:
                        seen.add(key)
                        rows.append(i)
                if not rows:
                    continue
                raw = pa.array([prefix[begin[i] : begin[i + 1]].astype("<u8").tobytes() for i in rows], pa.binary())
                r = np.array(rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(n[r].astype(np.int64)), pa.array(mix(g1 + mix(g2))[r].view(np.int64)), raw], ["doc_id", "n", "gkey", "prefix"])

    return run, "doc_id long, n long, gkey long, prefix binary"


def _tokens(heavy: np.ndarray, tier: np.ndarray):
    """One row for each shingle of each group's prefix, with its place. Shingles that very many documents have are
    salted by the group, so that no one task chains them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, group = batch.column(2), batch.column(0).to_numpy()
            for at in range(0, len(batch), 500):
                part = raw.slice(at, 500).to_pylist()
                size = np.array([len(x) // 8 for x in part])
                row = np.repeat(np.arange(at, at + len(part)), size)
                token = np.frombuffer(b"".join(part), "<u8")
                k = np.minimum(np.searchsorted(heavy, token), max(len(heavy) - 1, 0))
                salts = np.where(heavy[k] == token, np.maximum(tier[k] - SALT_FROM, 0), 0) if len(heavy) else np.zeros(len(token), np.int64)
                salt = (mix(group[row].view(np.uint64)) & ((1 << salts.astype(np.uint64)) - np.uint64(1))).astype(np.int32)
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt), pa.array(salts > 0), batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32))], ["token", "salt", "salted", "g", "n", "place"])
        tidy()

    return run, "token long, salt int, salted boolean, g long, n long, place int"


def _sets(words: int):
    """By document its set: the upper 48 bits of each shingle, sorted, six bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(1)):
                shingle, first = shingle_sets(data, bounds, words)
                raw = np.ascontiguousarray((shingle >> np.uint64(16)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                out = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((first * 6).astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out.cast(pa.binary())], ["doc_id", "value"])

    return run, "doc_id long, value binary"


def _verify(percent: int):
    """Pairs whose sets link."""

    def unpacked(raw: bytes) -> np.ndarray:
        wide = np.zeros((len(raw) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return wide.view("<u8").reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = unpacked(left[i].as_py()), unpacked(right[i].as_py())
                whole = np.concatenate([x, y])
                whole.sort(kind="stable")
                same = int((whole[1:] == whole[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column(0), batch.column(1))], ["a", "b"])
        tidy()

    return run, "a long, b long"


def _folded(percent: int):
    """Pairs that long bitmaps can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            both = batch.column(4).to_numpy()
            keep = np.array([(100 + percent) * apart(x[i].as_py(), y[i].as_py()) <= (100 - percent) * int(both[i]) for i in range(len(batch))], bool)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column(0), batch.column(1), batch.column(4))], ["a", "b", "both"])
        tidy()

    return run, "a long, b long, both long"


def _bound(a: str, b: str, percent: int):
    """Size filter, then the bound of the difference by short bitmaps."""
    differ = sum((F.bit_count(F.col(f"{a}.bitmap")[i].bitwiseXOR(F.col(f"{b}.bitmap")[i])) for i in range(BITMAP)), F.lit(0))
    return _size(F.col(f"{a}.n"), F.col(f"{b}.n"), percent) & ((100 + percent) * differ <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _size(m, n, percent: int):
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _place(a: str, b: str, percent: int):
    """Place filter: the shingles from the common one on suffice to link."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
    return (100 + percent) * left >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _beside(pairs: DataFrame, source: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pairs`` (a written table) with the value of either side as ``x`` and ``y``; ``made`` turns the rows of ``source``
    that are in pairs to ``doc_id, value``."""
    ids = persisted(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "join-ids")
    few = ids.count() <= BROADCAST_IDS
    own = made(source.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))
    both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("value").alias("x")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("value").alias("y")), "b")
    return both.select("a", "b", "x", "y", "both")


def _verified(pairs: DataFrame, profiles: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs`` (a, b, both), each once and ``both`` the sum of their sizes, whose sets link."""
    with scope() as here:
        pairs = persisted(pairs, "join-pairs")
        # A set has at least percent of the other's shingles: where their sum is large, both have long bitmaps.
        large = F.col("both") * percent > (100 + percent) * LOOSE
        run, kind = _folded(percent)
        maps = _beside(persisted(pairs.where(large), "join-large"), profiles.where("long_map is not null"), lambda rows: rows.select("doc_id", F.col("long_map").alias("value")))
        left = persisted(pairs.where(~large).unionByName(maps.mapInArrow(run, kind)), "join-bounded")
        made, kind = _sets(words)
        sets = _beside(left, texts, lambda rows: rows.mapInArrow(made, kind))
        run, kind_out = _verify(percent)
        return here.result(sets.mapInArrow(run, kind_out), "join-links")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scope() as here:
        if not texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
            return here.result(_joined(texts, words, percent), "join-result")
        # Rows are joined each by itself; those of an id become one vertex when components are.
        texts = persisted(texts.withColumn("row", F.monotonically_increasing_id()), "join-rows")
        found = persisted(_joined(texts.select(F.expr("if(doc_id is null, null, row)").alias("doc_id"), "text"), words, percent).withColumnRenamed("doc_id", "row"), "join-by-row")
        found = found.join(texts.where("doc_id is not null").select("row", "doc_id"), "row", "left")
        least = found.groupBy("component_id").agg(F.min("doc_id").alias("least"))
        links = found.join(least, "component_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
        final = components(persisted(links, "join-id-links"))
        found = found.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return here.result(found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "join-result")


def _joined(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """As :func:`near_duplicates`, for ids (nulls apart) that don't repeat."""
    run, kind = _profiles(words)
    seen = persisted(texts.mapInArrow(run, kind), "join-profiles")
    profiles = seen.where("heavy is null").drop("heavy", "times")
    frequent = seen.where("heavy is not null").groupBy("heavy").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "heavy").limit(TOP).collect()
    heavy = np.array([r.heavy for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(heavy)
    heavy, tier = heavy[order], np.ceil(np.log2(np.array([max(r.times, 2) for r in frequent], float)))[order].astype(np.int8)

    # Equal sets are linked from the start; the smallest id stands for them.
    same = profiles.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("head"), F.min_by("bitmap", "doc_id").alias("bitmap"), F.count("*").alias("rows"))
    same = persisted(same, "join-equal")
    twins = persisted(profiles.where("n > 0 and doc_id is not null").join(same.where("rows > 1").drop("bitmap"), ["n", "k1", "k2"]).where("doc_id != head").select("doc_id", "head").distinct(), "join-twins")
    heads = same.select(F.col("head").alias("doc_id"), "n", "bitmap")

    # Groups of equal prefix and size, and the places of their shingles.
    run, kind = _prefixes(words, percent, heavy, tier)
    found = persisted(texts.mapInArrow(run, kind), "join-prefixes")
    groups = found.groupBy("gkey", "n").agg(F.min_by("prefix", "doc_id").alias("prefix"), F.min("doc_id").alias("g"))
    run, kind = _tokens(heavy, tier)
    rows = groups.select("g", "n", "prefix").mapInArrow(run, kind)
    bucket = Window.partitionBy("token", "salt").orderBy("n", "g")
    rows = rows.withColumns({"prev": F.lag("g").over(bucket), "prev_n": F.lag("n").over(bucket), "next": F.lead("g").over(bucket)})
    rows = persisted(rows.where("prev is not null or next is not null or salted").drop("next", "salt", "salted"), "join-buckets")

    # Members: (group, document) for each distinct set; only the head's id of equal sets.
    heads_of = groups.select("gkey", "n", "g")
    members = found.select("gkey", "n", "doc_id").join(heads_of, ["gkey", "n"]).select("g", "doc_id", "n")
    members = members.join(twins, "doc_id", "left").select("g", F.coalesce("head", "doc_id").alias("doc_id"), "n").distinct()
    members = persisted(members, "join-members")

    # First links: neighbours in buckets (their heads) and in groups. Of each document, the neighbour found most often.
    near = rows.where("prev is not null").where(_size(F.col("n"), F.col("prev_n"), percent)).groupBy("g", "prev").agg(F.count("*").alias("times"))
    near = near.groupBy("g").agg(F.max_by("prev", F.struct("times", "prev")).alias("prev")).select(F.col("prev").alias("a"), F.col("g").alias("b"))
    inner = members.withColumn("prev", F.lag("doc_id").over(Window.partitionBy("g").orderBy("doc_id"))).where("prev is not null").select(F.col("prev").alias("a"), F.col("doc_id").alias("b"))
    headed = near.join(twins.select(F.col("doc_id").alias("a"), F.col("head").alias("ha")), "a", "left").join(twins.select(F.col("doc_id").alias("b"), F.col("head").alias("hb")), "b", "left").select(F.coalesce("ha", "a").alias("a"), F.coalesce("hb", "b").alias("b"))
    pairs = inner.unionByName(headed).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _verified(_bounded(pairs, heads, percent), profiles, texts, words, percent)
    comps = components(links)

    # What is left: buckets and groups with members in two components or more, each set of groups once: in the bucket of
    # the shingle that comes first in the order of all, which holds the first common shingle of any two of them.
    labelled = members.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("g", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))
    shared = rows.groupBy("g").agg(F.count("*").alias("times"))
    labelled = labelled.join(shared, "g", "left").withColumn("shared", F.coalesce(F.col("times"), F.lit(0)) / F.col("n")).drop("times")
    labelled = persisted(labelled, "join-labelled")
    by_group = labelled.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_rows = rows.select("token", "g", "place").join(by_group, "g")
    per_bucket = open_rows.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bit_xor(F.xxhash64("g")).alias("who"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("who2"), F.count("*").alias("many"), F.min(F.struct("g", "place")).alias("least"))
    chosen = per_bucket.where("low != high").groupBy("who", "who2", "many", "low", "high").agg(F.min_by("token", F.struct("least.place", "token")).alias("token")).select("token")
    alone = by_group.where("low != high").select(F.col("g").alias("token"), "g", F.lit(0).alias("place"))  # a group itself is a bucket
    wide = rows.select("token", "g", "place").join(chosen, "token", "left_semi").select(F.concat(F.lit("t"), F.col("token")).alias("bucket"), "g", "place")
    wide = wide.unionByName(alone.select(F.concat(F.lit("g"), F.col("token")).alias("bucket"), "g", "place")).join(labelled, "g")
    wide = persisted(wide.groupBy("bucket", "doc_id", "n", "comp").agg(F.min("place").alias("place"), F.max("shared").alias("shared")), "join-open")

    # The document that shares most of its prefix stands in the middle of a family: the others of its size are held
    # against it first, which links most of the family at once.
    wide_class = wide.withColumn("class", F.round(F.log("n") * 8).cast("int"))
    hubs = wide_class.groupBy("bucket", "class").agg(F.max_by(F.struct("doc_id", "comp"), F.struct("shared", (-F.col("doc_id")).alias("last"))).alias("hub"))
    star = wide_class.select("bucket", "class", "doc_id", "comp").join(hubs, ["bucket", "class"]).where("comp != hub.comp").select("doc_id", F.col("hub.doc_id").alias("hub"))
    star = star.groupBy("doc_id", "hub").agg(F.count("*").alias("times")).groupBy("doc_id").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
    star = star.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    comps = components(_linked(comps).unionByName(_verified(_bounded(star, heads, percent), profiles, texts, words, percent)))

    # All pairs across what are still different components, in the buckets that are still open.
    wide = wide.drop("comp", "shared").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    wide = persisted(wide, "join-relabelled")
    still = persisted(wide.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket"), "join-still-open")
    wide = persisted(wide.join(still, "bucket", "left_semi").join(heads.select("doc_id", "bitmap"), "doc_id"), "join-crossing")
    x, y = wide.alias("x"), wide.alias("y")
    crossing = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") < F.col("y.comp")) & _place("x", "y", percent) & _bound("x", "y", percent))
    crossing = crossing.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"), (F.col("x.n") + F.col("y.n")).alias("both")).distinct()
    more = _verified(crossing, profiles, texts, words, percent)

    final = components(_linked(comps).unionByName(more))
    head = F.coalesce("head", "doc_id")
    rows = profiles.select("doc_id", "n").join(twins, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), head.alias("node"))
    return rows.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def _linked(comps: DataFrame) -> DataFrame:
    """Components as links: each node with the smallest one."""
    return comps.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _bounded(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the filters, with the sum of their sizes."""
    both = pairs.join(heads.withColumnRenamed("doc_id", "a").select("a", F.struct("n", "bitmap").alias("x")), "a").join(heads.withColumnRenamed("doc_id", "b").select("b", F.struct("n", "bitmap").alias("y")), "b")
    return both.where(_bound("x", "y", percent)).select("a", "b", (F.col("x.n") + F.col("y.n")).alias("both"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without the copies: of each component the row with the smallest ``doc_id`` stays, of rows that
    share this id one. Rows with a null id or without shingles stay. Columns are those of ``docs``."""
    with scope() as here:
        found = near_duplicates(docs, **options)
        gone = here.result(found.where("component_id < doc_id").select("doc_id").distinct(), "join-gone")
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))
