"""The vector operators against brute force: joins by cosine, product codes."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import queries, vector_codes, vector_join

DATA = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", ["op11_vector_join", "op13_vector_codes"])
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    same(queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df())


def clustered(seed, size, n):
    """Copies at angles on both sides of the threshold, exact copies, and lone vectors."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        c = rng.standard_normal(size)
        c /= np.linalg.norm(c)
        noise = rng.choice([0.0, 0.1, 0.3, 0.33, 0.36, 0.5])
        for _ in range(int(rng.integers(1, 25))):
            u = rng.standard_normal(size)
            out.append((c + noise * u / np.linalg.norm(u)) * rng.uniform(0.01, 100))
    x = np.array(out[:n], np.float32)
    return x[rng.permutation(n)]


def brute(ids, vectors, threshold):
    """Links and components of usable rows."""
    units = [v / np.linalg.norm(v) for v in (np.asarray(v, float) for v in vectors)]
    n = len(ids)
    links = [[j for j in range(n) if j != i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    low = list(ids)
    while True:
        new = [min([low[i], *(low[j] for j in links[i])]) for i in range(n)]
        if new == low:
            return {i: (len(k), c) for i, k, c in zip(range(n), links, low, strict=True)}
        low = new


@pytest.mark.parametrize(("size", "threshold", "part_rows"), [(64, 0.9, 32768), (64, 0.9, 40), (40, 0.95, 25), (3, 0.99, 50), (1, 0.9, 16), (17, 0.5, 60)])
def test_join_equals_brute_force(spark, size, threshold, part_rows):
    x = clustered(size, size, 400)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], KIND).repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_join.near_vectors(df, threshold, part_rows).collect()}
    want = brute(list(range(400)), x, threshold)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert sum(n > 0 for n, _ in want.values()) > 100


def test_join_never_loses_a_pair_at_the_edge_of_a_block(spark):
    """Pairs just within the threshold whose difference is spread evenly over all blocks, after the rotation."""
    rng, rows = np.random.default_rng(5), []
    turn = vector_join.rotation(64)
    for i in range(150):
        c = rng.standard_normal(64)
        c /= np.linalg.norm(c)
        d = rng.choice([-1.0, 1.0], 64) @ turn.T
        d -= (d @ c) * c
        d /= np.linalg.norm(d)
        for cosine in (1.0, 0.9 + 1e-7, 0.9 - 1e-7):
            rows.append((len(rows), (cosine * c + math.sqrt(1 - cosine**2) * d).tolist(), i))
    got = vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = brute([r[0] for r in rows], [r[1] for r in rows], 0.9)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_ties_at_the_threshold_are_decided_exactly():
    x, y = np.array([[3.0, 0, 1], [3, 0, 1], [-3, 0, 1]]), np.array([[3.0, 1, 0], [3, 1 + 1e-15, 0], [3, 1, 0]])
    assert vector_join.linked(x, y, 0.9).tolist() == [True, False, False]  # 9 / 10, hardly less, negative
    assert vector_join.linked(x * 1e300, y * 1e-300, 0.9).tolist() == [True, False, False]


def test_join_of_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (2, v), (None, v), (3, None), (4, []), (5, [0.0, 0.0, -0.0]), (6, [1.0, None, 3.0]), (7, [NAN, 2.0, 3.0]), (8, [INF, 2.0, 3.0]), (9, [1.0, 2.0]), (10, [-0.0, 1.0, 0.0]), (11, [0.0, 1.0, 0.0]), (12, [3e38, 6e38 / 2, 3e38]), (13, [1e-40, 1e-40, 1e-40])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], KIND).withColumns({c: F.lit("clash") for c in ("key", "x", "times", "h1", "use", "low", "n_links", "component")})
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_join.near_vectors(df).collect())
    lone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    # 12 and 13 point the same way (1, 1, 1): cosine 0.926 with (1, 2, 3).
    assert got == sorted([(-1, 0, None, True), (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), *lone, (10, 1, 10, True), (11, 1, 10, False), (12, 4, 1, False), (13, 4, 1, False)])
    assert vector_join.near_vectors(spark.createDataFrame([], KIND)).collect() == []


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(2)
    hot = rng.standard_normal(64)
    x = np.concatenate([np.tile(hot, (200, 1)), hot + 0.02 * rng.standard_normal((200, 64)), rng.standard_normal((300, 64))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], KIND)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.near_vectors(df, part_rows=64).collect()}
    assert got == {i: (399, 0) if i < 400 else (0, i) for i in range(700)}


def plain_codes(rows, parts, entries, rounds):
    """Rounds in Python integers, nothing skipped. ``rows``: id, components, label."""
    q = [[math.floor(1024 * float(np.float32(v))) for v in x] for _, x, _ in rows]
    cut = [i * len(q[0]) // parts for i in range(parts + 1)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, q[i]))
    books = [[q[i][a:b] for i in order[:entries]] for a, b in zip(cut, cut[1:], strict=False)]

    def nearest(x, book):
        return min((sum((u - v) ** 2 for u, v in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in q:
                own.setdefault(nearest(x[cut[p] : cut[p + 1]], books[p])[1], []).append(x[cut[p] : cut[p + 1]])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    found = [[nearest(x[cut[p] : cut[p + 1]], books[p]) for p in range(parts)] for x in q]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    of = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        of[label] = of.get(label, 0) + e
    return [(r[0], "".join(f"{e:02x}" for _, e in f), e, of[r[2]], digest) for r, f, e in zip(rows, found, errors, strict=True)]


def told(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("size", "entries", "spread", "steps"), [(8, 16, 1.0, 0), (10, 40, 1.0, 0.25), (12, 256, 30000.0, 0)])
def test_codes_equal_plain_rounds(spark, size, entries, spread, steps):
    rng = np.random.default_rng(size)
    x = (rng.standard_normal((300, size)) * spread).astype(np.float32)
    if steps:  # many ties
        x = np.round(x / steps).astype(np.float32) * np.float32(steps)
    rows = [(int(i), v.tolist(), None if i % 7 == 0 else int(i % 3)) for i, v in zip(rng.permutation(300), x, strict=True)]
    rows += rows[:5] + [(None, rows[0][1], 1)]  # repeated and without an id
    got = told(vector_codes.coded(spark.createDataFrame(rows, KIND).repartition(4), 4, entries, 4))
    assert got == sorted(plain_codes(rows, 4, entries, 4), key=str)


def test_codes_of_odd_rows(spark):
    kept = [(4, [0.5, -0.5, 0.25, 1.0], None), (2, [0.5, -0.5, 0.25, -1.0], None), (9, [0.0, 0.0, 0.0, 0.0], 1)]
    odd = [(1, None, 1), (3, [1.0, None, 0.0, 0.0], 1), (5, [NAN, 0.0, 0.0, 0.0], 1), (6, [0.0, INF, 0.0, 0.0], 1), (7, [0.0, 0.0], 1), (8, [1e30, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(kept + odd, KIND).withColumns({c: F.lit("clash") for c in ("q", "x", "code", "codes", "error", "of", "label_error")})
    assert told(vector_codes.coded(df)) == sorted(plain_codes(kept, 4, 256, 4), key=str)
    assert vector_codes.coded(df.where("vec_id in (1, 3)")).collect() == []
    assert vector_codes.coded(spark.createDataFrame([], KIND)).collect() == []


def test_bounds_spare_most_distances():
    """On clustered rows, later rounds compute a part of all distances, and get the same entries as a full scan."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.rint(c + 20 * rng.standard_normal((60, 16))) for c in rng.uniform(-3000, 3000, (80, 16))]).astype(np.int64)
    x = x[rng.permutation(len(x))]
    book = vector_codes.Codebook(x[:256], vector_codes.grouped(x[:256]))
    code = lower = None
    shares = []
    for _ in range(5):
        code, d, lower, computed = vector_codes.assign(x, book, code, lower)
        plain = vector_codes.squared(x, book.entries)
        assert (code == plain.argmin(1)).all() and (d == plain.min(1)).all()
        others = np.sqrt(np.where(np.arange(256)[None] == code[:, None], np.inf, plain))
        for g, members in enumerate(book.members):
            assert (lower[:, g] <= others[:, members].min(1)).all()
        shares.append(computed / plain.size)
        new = book.entries.copy()
        for e in np.unique(code):
            new[e] = np.floor_divide(x[code == e].sum(0), (code == e).sum())
        book = book.moved(new)
    assert shares[0] == 1 and shares[-1] < 0.35
