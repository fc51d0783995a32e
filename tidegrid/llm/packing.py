"""Mixture-controlled packing of documents into token windows by deficit round-robin.

Each source is a queue of its documents' tokens. In every round a queue's deficit grows by its quantum (the window's
tokens times the source's target proportion) and the queue sends the packets, runs of at most ``packet`` ids of one
document, that the deficit covers; what is left is carried into the next round, across windows and partitions. While
a queue has tokens, the packet that ends at token ``e`` of its queue is sent in round ``ceil(e / quantum)``: a closed
form that needs only running sums, so the rounds of one queue are worked out in parallel. An empty queue just drops out.
The packets in order of (round, queue, place) form one stream that is cut every ``window`` ids, so all sequences but the
last are full and none is padded.

Running sums are made in three levels (inside blocks of bounded size, inside groups of blocks, over groups): no source, however large,
is sorted in one task by document. Ids are encoded once, kept as Parquet in the shared folder, and meet the pieces by
one join on a row number.

Defined results: a null text is empty; an empty text is the id 1 alone; rows with a null or repeated ``doc_id`` are
packed each by itself and keep their ``doc_id``; a null source is a queue of its own, first of all, and there may be any
number of sources: their quanta are a table; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import persisted, scope, small_batches
from .tokens import END_ID, Encoder, vocabulary_file

#: Documents in a block of the running sums, blocks of a group (as bits), and the ids in a block of the stream (2**17: 64
#: windows) below most_blocks.
BLOCK_DOCS, GROUP_BITS, BLOCK_IDS = 512, 10, 1 << 17
#: Up to so many queues their quanta are broadcast, beyond it they are joined.
BROADCAST_QUEUES = 10_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenised(docs: DataFrame, vocabulary: str, text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """``doc_id, source, n, ids``: ids as little-endian unsigned 16-bit numbers, with ``end_id`` behind each document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for a, b, ids, first in encoder.batches(batch.column(2)):
                n = np.diff(first)
                if end_id is not None:
                    ids, first = np.insert(ids, first[1:], end_id), first + np.arange(len(first))
                raw = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((first * 2).astype(np.int64)), pa.py_buffer(ids.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n + (end_id is not None)), raw.cast(pa.binary())], ["doc_id", "source", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id long, source string, n long, ids binary")


def pack(
    docs: DataFrame,
    *,
    vocabulary: str | None = None,
    window: int = 2048,
    packet: int = 512,
    proportions: Mapping[str, float] | None = None,
    temperature: float = 1.0,
    most_blocks: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``with_ids`` adds the ids themselves.

    ``proportions``: target shares by source, at most 1 in all. Sources that are not named share what is left by their
    tokens to the power ``temperature``: at 1 all queues end together, below 1 small sources are brought forward. Where a
    queue ends, the others go on in their proportions; every document is packed once whatever the targets.
    """
    with scope() as here:  # the ids, the largest table, go as the pieces are there
        out = _packed(docs, vocabulary or vocabulary_file(), window, packet, proportions or {}, temperature, most_blocks, with_ids)
        return here.result(out, "packing-pieces")


def _packed(docs: DataFrame, vocabulary: str, window: int, packet: int, proportions: Mapping[str, float], temperature: float, most_blocks: int, with_ids: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    kept = persisted(tokenised(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "packing-ids")
    shared = F.when(F.col("source").isNull(), F.lit("null:")).otherwise(F.concat(F.lit("s:"), F.col("source")))
    meta = kept.select("row", "n", shared.alias("queue"))
    given = {f"s:{k}": float(v) for k, v in proportions.items()}
    if any(v <= 0 for v in given.values()) or sum(given.values()) > 1 + 1e-9:
        raise ValueError("proportions must be above 0, and at most 1 in all")
    spark = docs.sparkSession
    totals = persisted(meta.groupBy("queue").agg(F.sum("n").alias("total")), "packing-queues")
    weight = F.pow(F.col("total").cast("double"), F.lit(float(temperature)))
    if given:
        shares = spark.createDataFrame(list(given.items()), "queue string, share double")
        totals = totals.join(F.broadcast(shares), "queue", "left")
    else:
        totals = totals.withColumn("share", F.lit(None).cast("double"))
    sums = totals.agg(F.count("*").alias("queues"), F.sum("total").alias("whole"), F.sum(F.when(F.col("share").isNull(), weight)).alias("rest")).first()
    whole = sums.whole
    if not whole:
        return spark.createDataFrame([], PIECES + (", ids binary" if with_ids else ""))
    left = max(0.0, 1 - sum(given.values()))
    quantum = F.greatest(window * F.coalesce("share", left * weight / F.lit(sums.rest)), F.lit(1.0))
    quanta = totals.select("queue", "total", quantum.alias("quantum"))
    rounds = quanta.agg(F.max(F.ceil(F.col("total") / F.col("quantum")))).first()[0]
    quanta = quanta.select("queue", "quantum")
    meta = meta.join(F.broadcast(quanta) if sums.queues <= BROADCAST_QUEUES else quanta, "queue")

    # Tokens before each document in its queue: blocks of rows, groups of blocks, then the groups' totals.
    bits = BLOCK_DOCS.bit_length() - 1
    block = (F.shiftrightunsigned("row", 33) * F.lit(1 << (33 - bits)) + F.shiftright(F.col("row").bitwiseAND((1 << 33) - 1), bits)).alias("block")
    meta = meta.withColumn("block", block)
    blocks = meta.groupBy("queue", "block").agg(F.sum("n").alias("tokens")).withColumn("group", F.shiftright("block", GROUP_BITS))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = blocks.groupBy("queue", "group").agg(F.sum("tokens").alias("tokens")).select("queue", "group", before(Window.partitionBy("queue").orderBy("group")).alias("group_start"))
    blocks = blocks.withColumn("in_group", before(Window.partitionBy("queue", "group").orderBy("block"))).join(groups, ["queue", "group"])
    blocks = blocks.select("queue", "block", (F.col("group_start") + F.col("in_group")).alias("block_start"))
    inside = Window.partitionBy("queue", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = meta.withColumn("in_block", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["queue", "block"]).withColumn("queue_start", F.col("block_start") + F.col("in_block"))

    # Packets and the rounds in which their deficits cover them.
    steps = placed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))))
    steps = steps.withColumn("length", F.least(F.lit(packet).cast("long"), F.col("n") - F.col("start")))
    steps = steps.withColumn("queue_end", F.col("queue_start") + F.col("start") + F.col("length"))
    steps = steps.withColumn("round", F.ceil(F.col("queue_end") / F.col("quantum")).cast("long"))
    blocks = min(most_blocks, -(-whole // BLOCK_IDS))
    steps = steps.select("row", "start", "length", "round", "queue", "queue_end", F.expr(f"round * {blocks} div {rounds}").alias("span"))

    # Place in the stream, again by the totals of blocks of rounds; there are at most most_blocks + 1.
    steps = persisted(steps, "packing-rounds")
    firsts = steps.groupBy("span").agg(F.sum("length").alias("tokens")).orderBy("span").collect()
    at = np.concatenate([[0], np.cumsum([r.tokens for r in firsts])]).tolist()
    starts = spark.createDataFrame([(r.span, x) for r, x in zip(firsts, at, strict=False)], "span long, span_start long")
    stream = Window.partitionBy("span").orderBy("round", "queue", "queue_end").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("in_span", F.coalesce(F.sum("length").over(stream), F.lit(0))).join(F.broadcast(starts), "span").withColumn("place", F.col("span_start") + F.col("in_span"))

    first, last = F.floor(F.col("place") / window), F.floor((F.col("place") + F.col("length") - 1) / window)
    pieces = steps.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * window)
    end = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * window)
    pieces = pieces.select("row", F.struct((F.col("start") + begin - F.col("place")).alias("start"), (end - begin).alias("length"), "sequence_id", (begin - F.col("sequence_id") * window).alias("offset")).alias("piece"))
    by_row = pieces.groupBy("row").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))  # of one document
    squeezed = kept.mapInArrow(_squeeze, kept.schema)
    joined = squeezed.join(by_row, "row").select("doc_id", "source", "n", "ids", "pieces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of, pieces_of = batch.column(3).to_pylist(), batch.column(4)
            rows = pieces_of.flatten()
            start, length = (rows.field(k).to_numpy() for k in ("start", "length"))
            of = np.repeat(np.arange(len(batch)), pieces_of.value_lengths().to_numpy())
            crc, parts, own, now = np.zeros(len(of), np.int64), [], None, -1
            for k in range(len(of)):
                if of[k] != now:
                    now = of[k]
                    own = np.frombuffer(zlib.decompress(ids_of[now]), "<u2").astype("<u4")
                raw = own[start[k] : start[k] + length[k]].tobytes()
                crc[k] = zlib.crc32(raw)
                if with_ids:
                    parts.append(raw)
            take = pa.array(of)
            columns = [batch.column(0).take(take), rows.field("start"), rows.field("length"), pa.array(crc), batch.column(2).take(take), rows.field("sequence_id"), rows.field("offset"), batch.column(1).take(take)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return joined.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses the ids before they are shuffled."""
    for batch in batches:
        k = batch.schema.get_field_index("ids")
        small = pa.array([zlib.compress(x, 1) for x in batch.column(k).to_pylist()], pa.binary())
        yield batch.set_column(k, "ids", small)
