"""Prefix tries of conversations, by an external mergesort that knows common prefixes.

A turn is a key of ``WIDTH`` bytes (a hash of role and text, and the text's size), a conversation the keys of its turns one
after the other; texts are hashed where they are read and never shuffled.

1. Every task sorts its conversations in runs of bounded size and writes them with the common prefix (LCP) of neighbours.
2. The runs are dealt by range of (keys, id). A task merges its slices of the runs by a loser tree whose comparisons start
   behind the turns that both sides share with the last winner.
3. The merged stream keeps the open path on a stack. A node is finished when the stream leaves it, and goes out. Nodes on the
   first and the last path of a range may go on in the next one: their sums go to the spine, of two rows a range.
4. The spine is merged by the same stack, in one task.

A node's conversations that end there come in ascending order, so their hash is fed as they come. Where such a list crosses
ranges its parts are hashed in a row: SHA-256 has no other way.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import persisted, scope

#: Bytes of a turn's key: 16 of a SHA-256 of role and text, 4 of the text's size.
WIDTH = 20
#: Rows and bytes of a sorted run.
RUN_ROWS, RUN_BYTES = 100_000, 16 << 20
#: Bytes of keys in a range. One conversation is never split.
RANGE_BYTES = 16 << 20
#: Ids in one piece of a list that crosses ranges.
PIECE = 50_000
#: Turns taken from the base conversation are fewer than this.
HEADS = 9
RUNS = "run long, pos long, lcp long, seq binary, conv_id long"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SUMS = "array<struct<n:bigint,low:bigint,children:bigint,leaves:bigint,saved:bigint>>"
MERGED = f"kind string, digest binary, parent binary, {NODE}, seq binary, since long, sums {SUMS}, ids string"
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """A turn's key as hexadecimal digits; null role and text are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, seq``: each conversation's turns in order of ``turn`` (null first; rows of one turn by their keys), the first
    ``crc32(id) % 9`` of them taken from the conversation whose id is the multiple of five below (towards zero). Rows without
    an id belong to no conversation. A conversation's keys are held in one row."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_key(F.col("role").cast("string"), F.col("text").cast("string")).alias("key"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key"))).getField("key").alias("keys"))
    whole = whole.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")})
    heads = rows.where("conv_id % 5 = 0").groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "key"))).getField("key"), 1, HEADS - 1).alias("head"))
    both = whole.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    keys = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.slice("keys", F.col("h") + 1, F.size("keys") + 1))
    return both.select("conv_id", F.unhex(F.array_join(keys, "")).alias("seq"))


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that both begin with; the first ``at`` are known to be equal. Doubling steps, then a search by halves."""
    most, step = min(len(a), len(b)) // WIDTH, 1
    while at + step <= most and a[at * WIDTH : (at + step) * WIDTH] == b[at * WIDTH : (at + step) * WIDTH]:
        at, step = at + step, step * 2
    end = min(at + step - 1, most)
    while at < end:
        middle = (at + end + 1) // 2
        if a[at * WIDTH : middle * WIDTH] == b[at * WIDTH : middle * WIDTH]:
            at = middle
        else:
            end = middle - 1
    return at


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of ``conv_id, seq`` with the common prefix of neighbours."""
    rows, size, made = [], 0, TaskContext.get().partitionId() << 32

    def run() -> pa.RecordBatch:
        rows.sort()
        lcps = [0] + [common(rows[i - 1][0], rows[i][0]) for i in range(1, len(rows))]
        columns = [pa.array([made] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(lcps, pa.int64()), pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["run", "pos", "lcp", "seq", "conv_id"])

    for batch in batches:
        for conv, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.append((seq or b"", conv))
            size += len(rows[-1][0])
            if len(rows) >= RUN_ROWS or size >= RUN_BYTES:
                yield run()
                rows, size, made = [], 0, made + 1
    if rows:
        yield run()


def merged(slices: list[list[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merges sorted ``(seq, conv_id, lcp with the one before)`` by a loser tree. ``shared[i]`` is the common prefix of slice
    i's head and the winner that it last lost to (or followed): the longer one is the smaller head, and only equal ones need
    a comparison, which starts behind it."""
    k = 1 << max(0, len(slices) - 1).bit_length()
    at, ends, shared = [0] * k, [len(s) for s in slices] + [0] * (k - len(slices)), [0] * k

    def wins(i: int, j: int) -> bool:
        if at[i] == ends[i] or at[j] == ends[j]:
            return at[j] == ends[j]
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        a, b = slices[i][at[i]], slices[j][at[j]]
        both = common(a[0], b[0], shared[i])
        first = (a[0][both * WIDTH : (both + 1) * WIDTH], a[1]) < (b[0][both * WIDTH : (both + 1) * WIDTH], b[1])
        shared[j if first else i] = both
        return first

    losers, level = [0] * k, list(range(k))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            won, lost = (a, b) if wins(a, b) else (b, a)
            losers[(len(level) + i) // 2] = lost
            up.append(won)
        level = up
    best, last = level[0], None
    while at[best] < ends[best]:
        seq, conv, _ = slices[best][at[best]]
        yield seq, conv, shared[best] if last is not None else 0
        last = seq
        at[best] += 1
        shared[best] = slices[best][at[best]][2] if at[best] < ends[best] else 0
        node = (best + k) >> 1
        while node:
            if wins(losers[node], best):
                losers[node], best = best, losers[node]
            node >>= 1


class Open:
    """A node on the open path."""

    __slots__ = ("n", "low", "children", "leaves", "saved", "size", "digest", "edge", "sha", "ids", "kids")

    def __init__(self, size: int, digest: bytes, edge: bool):
        self.n = self.children = self.leaves = self.saved = 0
        self.low, self.size, self.digest, self.edge = None, size, digest, edge
        self.sha, self.ids, self.kids = None, [], []

    def add(self, n: int, low: int | None) -> None:
        self.n += n
        if low is not None and (self.low is None or low < self.low):
            self.low = low

    def closed(self) -> tuple[int, int]:
        """Leaves and saved tokens of the whole subtree."""
        return self.leaves or 1, self.saved + (self.n - 1) * self.size

    def take(self, child: Open) -> None:
        leaves, saved = child.closed()
        self.add(child.n, child.low)
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + leaves, self.saved + saved

    def row(self, depth: int) -> dict:
        leaves, saved = self.closed()
        return {"conv_id": self.low, "depth": depth, "n_convs": self.n, "n_children": self.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": self.sha.hexdigest() if self.sha else NOTHING}

    def sums(self) -> dict:
        return {"n": self.n, "low": self.low, "children": self.children, "leaves": self.leaves, "saved": self.saved}


def below(parent: Open | None, seq: bytes, depth: int, edge: bool) -> Open:
    """The node of the first ``depth`` turns. Only nodes that may cross ranges are named by a digest."""
    key = seq[(depth - 1) * WIDTH : depth * WIDTH] if depth else b""
    digest = hashlib.sha256((parent.digest if parent else b"") + key).digest()[:16] if edge else b""
    return Open(int.from_bytes(key[-4:], "big"), digest, edge)


def grown(stream: Iterator[tuple[bytes, int, int]], last: bytes) -> Iterator[dict]:
    """The rows of one range: finished nodes, pieces of id lists and up to two rows of the spine. ``last``: the last keys."""
    path: list[Open] = []
    first, ahead, fresh = b"", 0, True
    edges: dict[int, Open] = {}  # the first path's nodes that the stream has left, by depth

    def pieces(node: Open) -> Iterator[dict]:
        if node.ids:
            yield {"kind": "ids", "digest": node.digest, "conv_id": node.ids[0], "ids": ",".join(map(str, node.ids))}
            node.ids = []

    def leave(depth: int) -> Iterator[dict]:
        while len(path) - 1 > depth:
            node, at = path.pop(), len(path)
            if node.edge:
                edges[at] = node
                yield from pieces(node)
                continue
            path[-1].take(node)
            for kid in node.kids:
                yield kid | {"parent_conv_id": node.low}
            own = {"kind": "node"} | node.row(at)
            if path[-1].edge:
                yield own | {"parent": path[-1].digest}
            else:
                path[-1].kids.append(own)

    for seq, conv, lcp in stream:
        if fresh:
            first = seq
        yield from leave(lcp)
        ahead = common(seq, last, ahead)
        for depth in range(len(path), len(seq) // WIDTH + 1):
            path.append(below(path[-1] if path else None, seq, depth, fresh or depth <= ahead))
        fresh = False
        end = path[-1]
        end.add(1, conv)  # the nodes above take it over as this one is finished
        if end.edge:
            end.ids.append(conv)
            if len(end.ids) >= PIECE:
                yield from pieces(end)
        else:
            text = str(conv).encode()
            if end.sha is None:
                end.sha = hashlib.sha256(text)
            else:
                end.sha.update(b"," + text)
    if fresh:
        return
    for node in path:  # what is still open is the last path
        yield from pieces(node)
    both = common(first, last)
    front = [edges[d] if d > both else path[d] for d in range(len(first) // WIDTH + 1)]
    yield {"kind": "spine", "seq": first, "conv_id": 0, "since": 0, "sums": [x.sums() for x in front]}
    if first != last:
        yield {"kind": "spine", "seq": last, "conv_id": 1, "since": both + 1, "sums": [x.sums() for x in path[both + 1 :]]}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _node_fields() -> list[pa.Field]:
    return [pa.field(k, pa.string() if k == "ends_sha256" else pa.int64()) for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]


def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: rows come by run and place, and are held (a range is bounded), then merged and grown to nodes."""
    slices: list[list[tuple[bytes, int, int]]] = []
    now = None
    for batch in batches:
        for run, lcp, seq, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if run != now:
                now, lcp = run, 0  # its neighbour is in another range
                slices.append([])
            slices[-1].append((seq, conv, lcp))
    if not slices:
        return
    sums = pa.list_(pa.struct([(k, pa.int64()) for k in ("n", "low", "children", "leaves", "saved")]))
    schema = pa.schema([pa.field("kind", pa.string()), pa.field("digest", pa.binary()), pa.field("parent", pa.binary()), *_node_fields(), pa.field("seq", pa.binary()), pa.field("since", pa.int64()), pa.field("sums", sums), pa.field("ids", pa.string())])
    yield from _batches(grown(merged(slices), max(s[-1][0] for s in slices)), schema)


def merge_spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spine's rows in order: sums of nodes along a path, met with those of the ranges before."""
    path: list[Open] = []

    def leave(depth: int) -> Iterator[dict]:
        while len(path) - 1 > depth:
            node, at = path.pop(), len(path)
            for kid in node.kids:
                yield kid | {"parent_conv_id": node.low}
            own = node.row(at) | {"digest": node.digest}
            if path:
                path[-1].take(node)
                path[-1].kids.append(own)
            else:
                yield own

    def rows() -> Iterator[dict]:
        before = b""
        for batch in batches:
            for seq, since, sums in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path:
                    yield from leave(common(before, seq))
                before = seq
                for depth in range(len(path), len(seq) // WIDTH + 1):
                    path.append(below(path[-1] if path else None, seq, depth, True))
                for node, more in zip(path[since:], sums, strict=True):
                    node.add(more["n"], more["low"])
                    node.children, node.leaves, node.saved = node.children + more["children"], node.leaves + more["leaves"], node.saved + more["saved"]
        yield from leave(-1)

    yield from _batches(rows(), pa.schema([*_node_fields(), pa.field("digest", pa.binary())]))


def hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the id lists, whose pieces come in order."""
    def rows() -> Iterator[dict]:
        now, sha = None, None
        for batch in batches:
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    yield {"digest": now, "ends": sha.hexdigest()}
                now, sha = digest, hashlib.sha256(ids.encode())
        if now is not None:
            yield {"digest": now, "ends": sha.hexdigest()}

    yield from _batches(rows(), pa.schema([pa.field("digest", pa.binary()), pa.field("ends", pa.string())]))


def trie(sequences: DataFrame, ranges: int | None = None) -> DataFrame:
    """The trie of ``conv_id, seq`` (as of :func:`rebuilt`; ids differ): one row a node, as :func:`prefix_trie` says.

    ``ranges``: ranges of the order; without it by bytes, at least one a shuffle partition. No rows give no nodes."""
    spark = sequences.sparkSession
    with scope() as here:
        runs = persisted(sequences.mapInArrow(sorted_runs, RUNS), "trie-runs")
        size = runs.agg(F.sum(F.length("seq") + 64)).first()[0] or 0
        ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
        ranged = runs.repartitionByRange(ranges, "seq", "conv_id").sortWithinPartitions("run", "pos").select("run", "lcp", "seq", "conv_id")
        found = persisted(ranged.mapInArrow(merge_range, MERGED), "trie-merged")
        here.drop(but=1)
        columns = [c.split()[0] for c in NODE.split(", ")]
        spine = found.where("kind = 'spine'").repartition(1).sortWithinPartitions("seq", "conv_id").select("seq", "since", "sums")
        spine = persisted(spine.mapInArrow(merge_spine, f"{NODE}, digest binary"), "trie-spine")
        lists = found.where("kind = 'ids'").repartition("digest").sortWithinPartitions("digest", "conv_id").select("digest", "ids").mapInArrow(hash_lists, "digest binary, ends string")
        top = spine.join(lists, "digest", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256"))
        nodes = found.where("kind = 'node'")
        under = nodes.where("parent is not null").drop("parent_conv_id").join(spine.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
        out = top.select(columns).unionByName(nodes.where("parent is null").select(columns)).unionByName(under.select(columns))
        return here.result(out, "trie-nodes")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``; see :func:`rebuilt`).

    One row a node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (UTF-8 bytes of shared last texts, over the subtree) and ``ends_sha256``
    (of the ids that end there). Nulls, empty and repeated rows: see :func:`rebuilt`; a conversation that keeps no turn belongs
    to the root alone. Extra columns are ignored; an empty table has no nodes."""
    return trie(rebuilt(conversations))
