"""Extendible hashing into byte-bounded shards, with DataFrame functions only.

The directory is indexed by the leading bits of a key's hash. A bucket that holds more bytes than the limit is split on
the next bit; all others stay as they are. A bucket's final depth is therefore the least number of bits at which the
bytes under its prefix fit the limit, which a histogram over the deepest prefixes gives for all buckets at once: bytes
are summed before the shuffle, every coarser prefix is summed from the histogram, and no row moves for it.

The depth of the histogram follows the data: the bits that an even spread needs and ``spare`` more, at most
``most_bits``. Where one prefix of that depth is still too large, a second histogram over its rows alone goes on to all
bits of the hash. What is still too large then (rows that share a key, or a single row beyond the limit), hashing can't
part; the bucket gets overflow pages, and ``overflow`` is true. Pages are cut at multiples of the limit from a running
sum of bytes over the bucket's rows, in two levels so that no bucket is sorted in one task: page ``2k`` has the rows
wholly between the multiples ``k`` and ``k + 1``, page ``2k + 1`` the one row that begins there and crosses the next
multiple. So each page fits; page numbers may have gaps.

Defined results: a null text has no bytes; a null key hashes as the empty string; repeated rows go to the same bucket
(to its pages beyond the limit); an empty table gives no rows; a single row beyond the limit has a page of its own, of
more than the limit; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import persisted, scope

#: Bits of the key's hash that a prefix may take.
HASH_BITS = 32
#: Directory rows that may be broadcast (a few MB); beyond it the join is shuffled.
BROADCAST_ROWS = 1 << 16
#: Rows of a block of a running sum, as bits of the row number.
BLOCK_BITS = 12


def hashed(key: Column) -> Column:
    """The key's hash: the first 32 bits of MD5, as a long, so that other engines can compute it too."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def leaves(sizes: DataFrame, limit: int, bits: int, least: int = 0) -> DataFrame:
    """``fine, depth, bucket, bytes`` for every prefix of ``bits`` bits in use: the least depth from ``least`` on at which
    the bytes fit, or all bits. ``sizes``: columns ``hash`` and ``bytes``; ``bucket`` is the prefix of ``depth`` bits.
    """
    histogram = sizes.groupBy(F.shiftright("hash", HASH_BITS - bits).alias("fine")).agg(F.sum("bytes").alias("bytes"))
    histogram = persisted(histogram, "shard-histogram")
    prefix = F.expr(f"shiftright(fine, {bits} - depth)").alias("bucket")
    depths = histogram.select("fine", "bytes", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth")).select("depth", prefix, "bytes")
    sums = persisted(depths.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes")), "shard-sums")
    # A leaf fits (or has all bits) and hangs below a bucket that doesn't; at the first depth nothing is above.
    split = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("above"))
    below = sums.withColumn("above", F.shiftright("bucket", 1)).join(split, ["depth", "above"], "left_semi").drop("above")
    leaf = below.unionByName(sums.where(F.col("depth") == least)).where((F.col("bytes") <= limit) | (F.col("depth") == bits))
    leaf = persisted(leaf.select("depth", "bucket", "bytes"), "shard-leaves")
    used = sorted(r.depth for r in leaf.select("depth").distinct().collect())  # at most 33; prefixes go to these depths only
    if not used:
        return histogram.select("fine", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket"), "bytes").limit(0)
    return histogram.select("fine", F.explode(F.array(*[F.lit(d) for d in used])).alias("depth")).select("fine", "depth", prefix).join(leaf, ["depth", "bucket"]).select("fine", "depth", "bucket", "bytes")


def paged(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` of buckets that can't be parted, with ``page``; each page of a ``hash`` fits the limit if its rows do."""
    rows = persisted(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_row", BLOCK_BITS)), "shard-pages")
    blocks = rows.groupBy("hash", "_block").agg(F.sum("n_bytes").alias("_bytes"))
    earlier = Window.partitionBy("hash").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("hash", "_block", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_base"))
    own = Window.partitionBy("hash", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_end", F.sum("n_bytes").over(own)).join(blocks, ["hash", "_block"])
    out = out.withColumn("_end", F.col("_end") + F.col("_base")).withColumn("_start", F.col("_end") - F.col("n_bytes"))
    first, last = F.expr(f"_start div {limit}"), F.expr(f"(_end - 1) div {limit}")
    crosses = (F.col("n_bytes") > 0) & (first != last)
    return out.withColumn("page", (2 * first + crosses.cast("int")).cast("long")).drop("_row", "_block", "_end", "_base", "_start")


def sharded(docs: DataFrame, *, limit: int = 1 << 20, spare: int = 4, most_bits: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, depth, bucket, page, overflow, shard`` for every row; a shard's name is its depth and prefix."""
    with scope() as here:
        return here.result(_sharded(docs, limit, spare, most_bits, id_col, text_col), "shards")


def _sharded(docs: DataFrame, limit: int, spare: int, most_bits: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    rows = rows.withColumn("hash", hashed(F.col("doc_id")))
    sizes = rows.select("hash", F.col("n_bytes").alias("bytes"))
    whole = sizes.agg(F.sum("bytes")).first()[0] or 0
    bits = min(most_bits, HASH_BITS, spare + max(0, math.ceil(math.log2(max(1, whole / limit)))))
    found = persisted(leaves(sizes, limit, bits), "shard-directory")
    found = F.broadcast(found) if (1 << bits) <= BROADCAST_ROWS else found
    columns = ["doc_id", "n_bytes", "hash", "depth", "bucket", "bytes"]
    out = rows.withColumn("fine", F.shiftright("hash", HASH_BITS - bits)).join(found, "fine").select(*columns)
    if found.where(F.col("bytes") > limit).limit(1).count():
        # The rows of buckets beyond the limit go on to all bits; all others stay as they are.
        large = persisted(out.where(F.col("bytes") > limit).select("doc_id", "n_bytes", "hash"), "shard-large")
        deep = persisted(leaves(large.select("hash", F.col("n_bytes").alias("bytes")), limit, HASH_BITS, bits).withColumnRenamed("fine", "hash"), "shard-directory")
        deep = F.broadcast(deep) if deep.count() <= BROADCAST_ROWS else deep
        more = persisted(large.join(deep, "hash").select(*columns), "shard-deep")
        parted = out.where(F.col("bytes") <= limit).unionByName(more.where(F.col("bytes") <= limit))
        out = parted.withColumn("page", F.lit(0).cast("long")).unionByName(paged(more.where(F.col("bytes") > limit), limit))
    else:
        out = out.withColumn("page", F.lit(0).cast("long"))
    out = out.withColumn("overflow", F.col("bytes") > limit)
    name = F.concat_ws("-", F.col("depth").cast("string"), F.col("bucket").cast("string"), F.when(F.col("overflow"), F.col("page").cast("string")))
    return out.select("doc_id", "n_bytes", F.col("depth").cast("long").alias("depth"), "bucket", "page", "overflow", name.alias("shard"))
