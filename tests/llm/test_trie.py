"""The prefix trie of conversations against brute force."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import prefix_trie, queries

DATA = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    nodes = collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c / 5) * 5
        seq = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append((c, len(seq) == d))
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    low = {k: min(c for c, _ in m) for k, m in nodes.items()}
    out = []
    for k, m in nodes.items():
        ends = hashlib.sha256(",".join(str(c) for c, e in m if e).encode()).hexdigest()
        out.append((low[k], len(k), low[k[:-1]] if k else None, len(m), kids[k], leaves[k], saved[k], ends))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    a, b = queries.queries()["op12_prefix_trie"](spark, DATA).toPandas(), con.sql(queries.oracle_sql()["op12_prefix_trie"]).df()
    key = ["conv_id", "depth"]
    a, b = (x.sort_values(key).reset_index(drop=True)[sorted(x.columns)] for x in (a, b))
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    for c in a.columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def made(seed, convs):
    rng, rows = random.Random(seed), []
    for c in convs:
        for turn in range(rng.randint(1, 7) if rng.random() < 0.9 else 30):
            rows.append((c, turn, rng.choice(["user", "bot"]) if turn % 3 == 0 else "user", rng.choice(["a", "bb", "é", ""])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges", [1, 2, 7, 60])
def test_trie_equals_brute_force(spark, ranges):
    rows = made(ranges, range(-20, 140))
    df = spark.createDataFrame(rows, KIND).repartition(6)
    assert told(prefix_trie.trie(prefix_trie.rebuilt(df), ranges)) == brute(rows)


def test_many_runs_and_a_hot_conversation(spark, monkeypatch):
    """A third of all conversations are one text; runs are short, lists of ids come in several pieces and cross ranges."""
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", 7)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = made(1, range(100, 200)) + [(c, t, "user", "same") for c in range(0, 60) for t in range(4)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert told(prefix_trie.trie(prefix_trie.rebuilt(df), 13)) == brute(rows)


def test_odd_rows(spark):
    long = "x" * 300_000
    rows = [(1, 0, None, None), (1, None, "user", long), (2, 0, "", ""), (None, 0, "user", "a"), (10, 1, "user", "b"), (10, 0, "user", long), (10, 1, "user", "b"), (11, 0, "user", long), (13, None, None, None), (2**62, 5, "é", "日本"), (-7, 0, "user", "q"), (-5, 0, "user", "p")]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("clash") for c in ("key", "base", "h", "seq", "head", "keys", "run", "kind", "digest")})
    assert told(prefix_trie.prefix_trie(df)) == brute(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], KIND)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "a")], KIND)).collect() == []


def test_merge_starts_behind_shared_turns():
    rng = random.Random(3)
    for _ in range(200):
        rows = [(b"".join(bytes([rng.randint(0, 2)]) * prefix_trie.WIDTH for _ in range(rng.randint(0, 12))), i) for i in range(rng.randint(1, 40))]
        k = rng.randint(1, 9)
        plain = lambda a, b: next((i for i in range(min(len(a), len(b)) // 20) if a[20 * i : 20 * i + 20] != b[20 * i : 20 * i + 20]), min(len(a), len(b)) // 20)
        slices = [sorted(rows[i::k]) for i in range(k) if rows[i::k]]
        out = list(prefix_trie.merged([[(s, c, plain(x[i - 1][0], s) if i else 0) for i, (s, c) in enumerate(x)] for x in slices]))
        assert [(s, c) for s, c, _ in out] == sorted(rows)
        assert [x[2] for x in out] == [0] + [plain(out[i - 1][0], out[i][0]) for i in range(1, len(out))]
