"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, ngram_join, packing, pii, prefix_trie, quality_rules, secrets_scan, sharding, token_counts, url_filter, vector_codes, vector_join
from .store import persisted, scope, temporary

#: Words of five-word shingles, pairs by shared shingles, then reachable documents.
OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

#: Windows of the benchmark, matched against windows of all documents.
OP9_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), bw AS MATERIALIZED (
  SELECT DISTINCT item_id, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g
  FROM (SELECT item_id, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, unnest(generate_series(1, len(ws) - k + 1)) AS p, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g
  FROM d, ks WHERE len(ws) >= k
), h AS MATERIALIZED (SELECT dw.doc_id, dw.p, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g
), n AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS w FROM h) GROUP BY doc_id
), i AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""

#: Bytes by hash prefix at every depth; a document's shard is the shortest prefix that fits.
OP4_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) AS h FROM documents
), p AS (SELECT doc_id, n_bytes, h, unnest(generate_series(0, 32)) AS depth FROM d
), q AS (SELECT doc_id, n_bytes, depth, h >> (32 - depth) AS bucket FROM p
), s AS (SELECT depth, bucket, sum(n_bytes) AS total FROM q GROUP BY depth, bucket
), l AS (
  SELECT doc_id, n_bytes, min({'depth': q.depth, 'bucket': q.bucket}) AS leaf FROM q JOIN s ON q.depth = s.depth AND q.bucket = s.bucket
  WHERE s.total <= 1048576 OR q.depth = 32 GROUP BY doc_id, n_bytes
)
SELECT doc_id, n_bytes, leaf.depth AS depth, leaf.bucket AS bucket, CAST(0 AS BIGINT) AS page, false AS overflow, concat(leaf.depth, '-', leaf.bucket) AS shard FROM l
"""

#: Cosines of all pairs in double precision, then reachable vectors.
OP11_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9
), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id, m.c = e.vec_id AS kept FROM embeddings e JOIN m ON m.a = e.vec_id
"""

#: CRC-32 by its table, rebuilt sequences of turn keys, and nodes as their prefixes.
OP12_SQL = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))
), rows AS (
  SELECT conv_id, turn, sha256(concat(length(role), ':', role, text))[1:32] AS k, strlen(text) AS b
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, list({'k': k, 'b': b} ORDER BY turn NULLS FIRST, k, b) AS ts FROM rows GROUP BY conv_id
), h AS (
  SELECT conv_id, ts, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 9 AS h
  FROM own, tab
), s AS (
  SELECT h.conv_id, coalesce(o.ts, [])[1:h.h] || h.ts[h.h + 1:] AS ts FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 5
), p AS (
  SELECT conv_id, len(ts) AS n, d, array_to_string(list_transform(ts[1:d], lambda x: x.k), '') AS p, CASE WHEN d > 0 THEN ts[d].b ELSE 0 END AS b FROM s, unnest(generate_series(0, len(ts))) u(d)
), nodes AS MATERIALIZED (
  SELECT p, d, min(conv_id) AS c, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS e FROM p GROUP BY p, d
), kids AS (SELECT p[1:32 * (d - 1)] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), up AS (
  SELECT x.p[1:32 * a] AS p, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.b) AS saved
  FROM nodes x LEFT JOIN kids ON kids.p = x.p, unnest(generate_series(0, x.d)) u(a) GROUP BY ALL
)
SELECT x.c AS conv_id, x.d AS depth, y.c AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children, CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, x.e AS ends_sha256
FROM nodes x JOIN up ON up.p = x.p LEFT JOIN kids ON kids.p = x.p LEFT JOIN nodes y ON x.d > 0 AND y.p = x.p[1:32 * (x.d - 1)]
"""

_OP13_ROUND = """), a{k} AS (
  SELECT v.vec_id, v.p, arg_min(c.e, (v.n + c.n - 2 * list_inner_product(v.v, c.v), c.e)) AS e, min(v.n + c.n - 2 * list_inner_product(v.v, c.v)) AS d FROM v JOIN c{k} c ON c.p = v.p GROUP BY v.vec_id, v.p
), c{j} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v, list_inner_product(coalesce(m.v, c.v), coalesce(m.v, c.v)) AS n
  FROM c{k} c LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS m FROM (SELECT v.p, a.e, unnest(v.v) AS x, unnest(range(len(v.v))) AS i FROM v JOIN a{k} a USING (vec_id, p)) GROUP BY ALL) GROUP BY p, e
  ) m USING (p, e)
"""

#: Lloyd rounds written out, in doubles that hold every integer exactly.
OP13_SQL = (
    """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, p, q[p * len(q) // 4 + 1:(p + 1) * len(q) // 4] AS v, list_inner_product(q[p * len(q) // 4 + 1:(p + 1) * len(q) // 4], q[p * len(q) // 4 + 1:(p + 1) * len(q) // 4]) AS n FROM k, range(4) r(p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v, n FROM v QUALIFY e < 256
"""
    + "".join(_OP13_ROUND.format(k=k, j=k + 1) for k in range(4))
    + """), f AS (
  SELECT vec_id, p, min(v.n + c.n - 2 * list_inner_product(v.v, c.v)) AS d, arg_min(c.e, (v.n + c.n - 2 * list_inner_product(v.v, c.v), c.e)) AS e FROM v JOIN c4 c USING (p) GROUP BY vec_id, p
), o AS (
  SELECT vec_id, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id
), h AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS s FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM c4)
)
SELECT o.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM o JOIN k USING (vec_id), h
"""
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens. Sources are mixed by their tokens to the power 0.7, so that small
    ones come earlier than their share."""
    return packing.pack(table(spark, sf_dir, "documents"), temperature=0.7)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four commits: all documents come; all counts are revised
    to include the end id, under a new version; documents without text go; the first batch comes again and is ignored."""
    with scope() as here:
        counts = persisted(token_counts.counted(table(spark, sf_dir, "documents")), "token-counts")
        rollup = token_counts.Rollup(spark, temporary(spark, "rollup"))
        ended = counts.withColumns({"tokenizer_version": F.concat("tokenizer_version", F.lit("+end")), "n_tokens": F.col("n_tokens") + 1})
        rollup.commit("load", token_counts.inserted(counts))
        rollup.commit("revise", token_counts.revised(counts, ended))
        rollup.commit("purge", token_counts.deleted(ended.where("n_tokens = 1")))
        rollup.commit("load", token_counts.inserted(counts))
        return here.result(rollup.totals(), "token-totals")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict."""
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of at most 1 MiB of text."""
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: fixed patterns and candidates that the boosted trees select."""
    return pii.scanned(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: fixed patterns and entropy spans."""
    return secrets_scan.scanned(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component of documents of similarity 0.8 or more."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's role, recovered from the texts, and its canonical form."""
    return chat_format.formatted(table(spark, sf_dir, "conversations"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside occurrences of ten-word windows of the benchmark."""
    return decontam.digest(decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict under rules learned from the labels."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learned(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(quality_rules.measured(docs), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links of cosine 0.9 or more, and its component."""
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code of four bytes and its error, under codebooks of four rounds."""
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    """By registered name."""
    return {f.__name__: f for f in (op1_mixture_packing, op2_token_counts, op3_url_filters, op4_extendible_sharding, op5_pii, op6_secret_scans, op7_ngram_jaccard_join, op8_chat_formatting, op9_benchmark_decontamination, op10_quality_rules, op11_vector_join, op12_prefix_trie, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express on whole tables."""
    return {"op4_extendible_sharding": OP4_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op9_benchmark_decontamination": OP9_SQL, "op11_vector_join": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_codes": OP13_SQL}
