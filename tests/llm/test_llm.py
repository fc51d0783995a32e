"""The pipeline operators against brute force on small fixtures, and their edge cases."""

import dataclasses
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import chat_format, components, decontam, ngram_join, packing, pii, quality_rules, queries, secrets_scan, sharding, token_counts, tokens, url_filter

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, one very long text, ties and repeated rows.
ODD = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, "one two", "en", "b", 7), (None, "one two three four five six", "en", "b", 1), (5, "x y z " * 30_000, "de", "a", 1), (6, "one two", "en", "b", 7), (6, "one two", "en", "b", 7), (7, "é😀 ü", "fr", None, 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("n", "row", "spans", "kind", "hash", "start", "n_words", "kept", "component", "ids", "queue", "bytes", "digits")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def hugging(text):
    if not hasattr(hugging, "own"):
        import public_tokenizers
        from tokenizers import Tokenizer

        hugging.own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        hugging.own.encode_special_tokens = True
    return hugging.own.encode(text, add_special_tokens=False).ids


def test_token_ids_are_those_of_the_tokenizers_file():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "\u00a0", "1", "'s", ".", "\u3000", "日", "!", "\t", "\x1c", "😀", "\x85", " the", ", and", "<|endoftext|>"]
    odd = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    got = []
    for a, b, ids, first in tokens.Encoder.of(tokens.vocabulary_file()).batches(pa.array(odd)):
        got += [ids[first[i - a] : first[i - a + 1]].tolist() for i in range(a, b)]
    assert got == [hugging(t or "") for t in odd]


def check_packing(rows, want):
    """``want``: the ids of each document, in any order, by doc_id."""
    pieces = pd.DataFrame([r.asDict() for r in rows])
    for s, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length.to_numpy())[:-1]])).all()
    sizes = pieces.groupby("sequence_id").length.sum()
    assert (sizes.iloc[:-1] == 2048).all() and sizes.iloc[-1] <= 2048 and sizes.index.tolist() == list(range(len(sizes)))
    for doc, ids in want.items():
        g = pieces[pieces.doc_id == doc].sort_values("start")
        assert g.length.sum() == len(ids) and (g.doc_tokens == len(ids)).all()
        for r in g.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    return pieces


def test_packing(docs, texts, odd, empty):
    pieces = check_packing(packing.pack(docs).collect(), {k: hugging(t) + [1] for k, t in texts.items()})
    share = pieces.groupby("source").length.sum() / pieces.length.sum()
    half = pieces[pieces.sequence_id < pieces.sequence_id.max() / 2]
    assert ((half.groupby("source").length.sum() / half.length.sum()).reindex(share.index).fillna(0) - share).abs().max() < 0.06
    got = packing.pack(odd).collect()
    check_packing(got, {1: [1], 2: [1], 5: hugging(ODD[5][1]) + [1]})
    assert sum(r.doc_id == 6 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert packing.pack(empty).count() == 0


def round_robin(queues, quanta, packet):
    """Plain deficit round-robin: queues of (document, tokens), in order; packets (document, start, length) as they are sent."""
    waiting = {q: [(d, s, min(packet, n - s)) for d, n in own for s in range(0, n, packet)] for q, own in queues.items()}
    spent, sent, rounds = dict.fromkeys(queues, 0), [], 0
    while any(waiting.values()):
        rounds += 1
        for q in sorted(waiting):
            while waiting[q] and waiting[q][0][2] <= rounds * quanta[q] - spent[q]:  # the deficit, without sums of rounding errors
                spent[q] += waiting[q][0][2]
                sent.append(waiting[q].pop(0))
    return sent


@pytest.mark.parametrize(("proportions", "temperature"), [({"a": 0.125, "b": 0.5}, 1.0), (None, 0.0), ({"c": 0.25}, 0.5)])
def test_packing_is_deficit_round_robin(spark, proportions, temperature):
    """Window by window as the plain scheduler fills them, with targets far from the natural shares, over several tasks."""
    rng = random.Random(7)
    rows = [(i, "x y " * rng.randint(0, 900), rng.choice("aaaabbc")) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ids = {i: len(hugging(t)) + 1 for i, t, _ in rows}
    queues = {q: [(i, ids[i]) for i, _, s in rows if s == q] for q in "abc"}
    total = {q: sum(n for _, n in own) for q, own in queues.items()}
    given = proportions or {}
    rest = sum(n**temperature for q, n in total.items() if q not in given)
    quanta = {q: max(256 * given.get(q, (1 - sum(given.values())) * n**temperature / rest), 1.0) for q, n in total.items()}
    want, at = [], 0
    for doc, start, length in round_robin(queues, quanta, 100):
        while length:
            n = min(length, 256 - at % 256)
            want.append((at // 256, at % 256, doc, start, n))
            at, start, length = at + n, start + n, length - n
    for blocks in (3, 4096):
        got = packing.pack(df, window=256, packet=100, proportions=proportions, temperature=temperature, most_blocks=blocks).collect()
        assert sorted((r.sequence_id, r.offset, r.doc_id, r.start, r.length) for r in got) == want
    if proportions == {"a": 0.125, "b": 0.5}:  # windows hold the targets while all queues last
        first = [w for w in want if w[0] < 20]
        source = {i: s for i, _, s in rows}
        assert abs(sum(w[4] for w in first if source[w[2]] == "b") / sum(w[4] for w in first) - 0.5) < 0.06


def test_packing_of_many_sources(spark, monkeypatch):
    """Three thousand sources, each a queue of its own, by broadcast quanta and by joined ones."""
    rng = random.Random(9)
    rows = [(i, "x y " * rng.randint(0, 12), None if i == 7 else f"s{i % 3000}") for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3)
    ids = {t: len(hugging(t)) + 1 for t in {t for _, t, _ in rows}}
    queues = {}
    for i, t, s in rows:
        queues.setdefault("" if s is None else f"s:{s}", []).append((i, ids[t]))
    total = {q: sum(n for _, n in own) for q, own in queues.items()}
    rest = sum(n**0.5 for n in total.values())
    want, at = [], 0
    for doc, start, length in round_robin({q: queues[q] for q in sorted(queues)}, {q: max(256 * n**0.5 / rest, 1.0) for q, n in total.items()}, 100):
        while length:
            n = min(length, 256 - at % 256)
            want.append((at // 256, at % 256, doc, start, n))
            at, start, length = at + n, start + n, length - n
    for most in (10_000, 100):
        monkeypatch.setattr(packing, "BROADCAST_QUEUES", most)
        got = packing.pack(df, window=256, packet=100, temperature=0.5).collect()
        assert sorted((r.sequence_id, r.offset, r.doc_id, r.start, r.length) for r in got) == want


def test_packing_round_trip(docs, texts):
    back = {}
    for r in packing.pack(docs, with_ids=True).collect():
        back.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for doc, parts in back.items():
        assert [i for _, p in sorted(parts) for i in p] == hugging(texts[doc]) + [1]


def test_token_counts(spark, docs, texts, odd, empty, tmp_path):
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in queries.op2_token_counts(spark, DATA).collect()}
    want = {}
    for r in docs.collect():
        n = len(hugging(r.text or "")) + 1
        if n > 1:
            k = (r.source, r.lang, "byte_bpe_50k+end")
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + n)
    assert got == want
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    counts = token_counts.counted(odd)
    assert rollup.commit("a", token_counts.inserted(counts)) and not rollup.commit("a", token_counts.inserted(counts))
    assert rollup.commit("none", token_counts.inserted(token_counts.counted(empty)))
    before = {tuple(r) for r in rollup.totals().collect()}
    assert sum(r[3] for r in before) == len(ODD)
    rollup.compact()
    assert {tuple(r) for r in rollup.totals().collect()} == before and not rollup.commit("a", token_counts.inserted(counts))
    assert rollup.commit("b", token_counts.deleted(counts)) and rollup.totals().count() == 0
    rollup.compact()
    assert rollup.totals().count() == 0


class Refusing:
    """A store that moves nothing, but else is as the other."""

    def __init__(self, store):
        self.store = store

    def rename(self, a, b):
        return False

    def __getattr__(self, name):
        return getattr(self.store, name)


def test_a_refused_move_is_no_silent_loss(spark, tmp_path):
    one = spark.createDataFrame([("a", "en", "v", 1, 10)], token_counts.SCHEMA)
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    rollup.commit("first", one)
    store = rollup._fs
    rollup._fs = Refusing(store)
    with pytest.raises(OSError, match="nothing is committed"):
        rollup.commit("second", one)
    with pytest.raises(OSError, match="could not be moved"):
        rollup.compact()
    assert not rollup.commit("first", one)  # this one is there
    rollup._fs = store
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 10)]
    assert rollup.commit("second", one) and not rollup.commit("second", one)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 2, 20)]
    # Two writers of one id: whoever moves second leaves the other's batch.
    writer = token_counts.Rollup(spark, rollup.path)
    there = writer._there
    writer._there = lambda path: False if path == writer._folder("second") and not hasattr(writer, "looked") and not setattr(writer, "looked", 1) else there(path)
    assert not writer.commit("second", one) and [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 2, 20)]
    assert rollup.compact() and not rollup.commit("second", one) and [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 2, 20)]


def test_compaction_neither_loses_nor_doubles(spark, tmp_path):
    one = spark.createDataFrame([("a", "en", "v", 1, 10)], token_counts.SCHEMA)
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    total = lambda: [tuple(r) for r in rollup.totals().collect()]
    rollup.commit("first", one)
    # A batch that comes while the others are folded counts once, before and after the next compaction.
    summed = rollup._summed
    rollup._summed = lambda *a: (rollup.commit("meanwhile", one), summed(*a))[1]
    assert rollup.compact()
    rollup._summed = summed
    assert total() == [("a", "en", "v", 2, 20)] and not rollup.commit("first", one) and not rollup.commit("meanwhile", one)
    assert rollup.compact() and total() == [("a", "en", "v", 2, 20)]
    assert not rollup.commit("first", one) and not rollup.commit("meanwhile", one)
    # Where the table can't be put in place nothing is deleted.
    rollup.commit("third", one)
    placed = rollup._placed
    rollup._placed = lambda *a: False
    assert not rollup.compact()
    rollup._placed = placed
    assert total() == [("a", "en", "v", 3, 30)]
    # A writer that died leaves a folder that isn't read, and goes in the end.
    (tmp_path / "r" / "_writing-dead").mkdir()
    assert total() == [("a", "en", "v", 3, 30)] and rollup.compact(stale=-5.0)
    assert not list((tmp_path / "r").glob("_writing-*")) and total() == [("a", "en", "v", 3, 30)]


def test_url_rules_and_model(spark):
    rows = [(1, "http://A.Example.NET/en/1?x"), (2, "https://x.example.net/fr/1"), (3, "http://example.com/de/"), (4, "http://b.org/fr/#t"), (5, "http://b.org/en/"), (6, None), (7, "no scheme"), (8, "http://notexample.com/de/1"), (8, "http://notexample.com/de/1"), (9, "http://foo.net"), (10, "a://b://c/d"), (11, "")]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))).collect()}
    assert [got[i].rule for i in range(1, 6)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None]
    assert (got[1].host, got[1].path, got[1].verdict) == ("a.example.net", "/en/1", "allow") and got[2].verdict == got[3].verdict == "block"
    assert (got[6].host, got[6].path, got[6].verdict) == ("", "", "allow") and got[7].host == "" and got[8].rule is None and got[9].rule is None
    assert (got[10].host, got[10].path) == ("b:", "//c/d")
    pages = queries.op3_url_filters(spark, "/root/testdata/sf0.01").where("rule IS NULL").collect()
    bad = [r for r in pages if re.search("spam|casino|pills|bets|ads-", r.host)]
    assert all(r.verdict == "block" for r in bad) and sum(r.verdict == "block" for r in pages) <= len(bad) + 0.01 * len(pages)
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_rules_on_the_whole_table(spark):
    """Host, path and rule of every page against plain string operations, and verdicts where a rule decides."""
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for r in queries.op3_url_filters(spark, DATA).collect():
        host = path = ""
        if "://" in (pages[r.page_id] or ""):
            rest = pages[r.page_id].split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("block", "allow")


def test_url_models_learn_given_labels(spark):
    """Labels that no seed word gives: held-out URLs are told apart, and few accepted ones are blocked."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
    url = lambda good: f"http://{word('aeioubdlmnrst' if good else 'qxzjkvwy0123')}.info/{word('aeioubdlmnrst' if good else 'qxzjkvwy0123')}/{rng.randint(1, 99)}"
    rows = [(i, url(i % 3 > 0), i % 3 > 0) for i in range(3000)]
    train = [(u, a) for i, u, a in rows if i < 2000] + [(None, True), ("no scheme", False), ("http://q.info/", None)]
    test = spark.createDataFrame([(i, u) for i, u, _ in rows if i >= 2000] + [(-1, "http://" + "a" * 100_000 + ".info/" + "b" * 100_000)], "page_id long, url string")
    labelled = spark.createDataFrame(train, "url string, accepted boolean")
    both = [{r.page_id: r.verdict for r in url_filter.judged(test, labelled=labelled, false_blocks=0.01, max_contexts=n).collect()} for n in (10**9, 0)]
    assert both[0] == both[1] and len(both[0]) == 1001
    good = [both[0][i] for i, _, a in rows if i >= 2000 and a]
    bad = [both[0][i] for i, _, a in rows if i >= 2000 and not a]
    assert good.count("block") <= 0.03 * len(good) and bad.count("block") >= 0.95 * len(bad)
    assert url_filter.judged(test, labelled=labelled.limit(0)).where("verdict = 'block'").count() == 0


def test_url_verdicts_do_not_depend_on_max_contexts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    more = spark.createDataFrame([(-1, None), (-2, "http://Ünder😀^.org/\n~^a?b"), (-3, "http://spam.org/x"), (-3, "http://spam.org/x"), (-4, "")], "page_id long, url string")
    rows = pages.unionByName(more)
    got = [sorted((tuple(r) for r in url_filter.judged(rows, max_contexts=n).collect()), key=str) for n in (10**9, 3000, 0)]
    assert len(got[0]) == rows.count() and got[0] == got[1] == got[2]
    assert sum(r[4] == "block" and r[3] is None for r in got[0]) > 5 and len({r[5] for r in got[0]}) > 100


def test_markov_is_a_distribution():
    model = url_filter.Markov({"": {"a": 3, "b": 1}, "a": {"b": 2}})
    symbols = sorted(url_filter._PLAIN) + [url_filter.OTHER]
    for context in ("", "a", "ba"):
        assert math.isclose(sum(model.chance(context, s) for s in symbols), 1)


def test_sharding(spark, docs, odd, empty):
    got = sharding.sharded(docs, limit=20_000).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
    assert max(sizes.values()) <= 20_000
    whole = {(r.depth, r.bucket): sizes[r.shard] for r in got}
    for (depth, bucket), n in whole.items():  # a split was needed: both halves together are beyond the limit
        if depth:
            parent = sum(b for (d, k), b in whole.items() if d >= depth and k >> (d - depth + 1) == bucket >> 1)
            assert parent > 20_000
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.OP4_SQL.replace("1048576", "20000")).df()
    assert sorted(want.shard + want.doc_id.astype(str)) == sorted(r.shard + str(r.doc_id) for r in got)
    assert sharding.sharded(odd, limit=1000).count() == len(ODD) and sharding.sharded(empty).count() == 0
    same = spark.createDataFrame([(1, "x" * 100)] * 200, "doc_id long, text string")
    hot = sharding.sharded(same, limit=5000).groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.first("overflow").alias("o")).collect()
    assert len(hot) > 3 and all(r.o for r in hot)


def test_shards_fit_their_limit(spark):
    code = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16)
    near = [i for i in range(100_000) if code(i) >> 20 == code(0) >> 20][:20]  # 12 bits in common
    rng = random.Random(3)
    rows = [(i, "x" * 700) for i in near] + [(-1, "y" * rng.randint(0, 999)) for _ in range(300)] + [(-2, "z" * 2500)] + [(-2, ""), (-2, None)]
    rows += [(-3, "é" * rng.randint(0, 5)) for _ in range(9000)] + [(-4, "w" * 1000), (-4, "w" * 1000)]  # several blocks; whole pages
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sharding.sharded(df, limit=1000).collect()
    assert len(got) == len(rows)
    sizes, members = Counter(), {}
    for r in got:
        sizes[r.shard] += r.n_bytes
        members.setdefault(r.shard, []).append(r)
    assert all(b <= 1000 or (len([r for r in members[k] if r.n_bytes]) == 1 and members[k][0].doc_id == -2) for k, b in sizes.items())
    own = [r for r in got if r.doc_id in near]
    assert len({r.shard for r in own}) == len(near) and not any(r.overflow or r.page for r in own)  # one more bit parts them
    assert all(r.bucket == code(r.doc_id) >> (32 - r.depth) for r in got)
    assert all(r.overflow and r.depth == 32 for r in got if r.doc_id in (-1, -3, -4))
    hot = {r.shard for r in got if r.doc_id == -1}
    assert len(hot) <= 2 * sum(r.n_bytes for r in got if r.doc_id == -1) / 1000 + 1


def pii_base(t):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    sp = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    sp += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            sp.append((m.start(), 2, m.end()))
    return sorted(sp + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def check_spans(rows, texts, base, kinds):
    for r in rows:
        spans = base(texts[r.doc_id] or "")
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert hashlib.sha256(text.encode()).hexdigest() == r.base_sha256, texts[r.doc_id][:200]
        found = [x for x in r.spans.split(",") if x]
        assert {x for x in text.split(",") if x} <= set(found)
        assert [(int(x.split(":")[1]), kinds.index(x.split(":")[0])) for x in found] == sorted((int(x.split(":")[1]), kinds.index(x.split(":")[0])) for x in found)


def test_pii(spark, docs, texts, empty, odd):
    rng = random.Random(3)
    parts = ["a", "1", "2", "@", ".", "b.c", "-", " ", "+", "(", ")", "_", "é", "😀", "12", "4111111111111111", "x@y.com", "1.2.3.4", "+1 (555) 123-4567", "255", "\n", "%"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", None, "1" * 5000, "a" * 20_000, "a@" + "b." * 3000 + "c", "+1" + "(" * 5000, "x@y.com_z@w.com", "1.2.3.4.5.6.7.8", "1.2.3.4 " * 300]
    more = ["call me (212) 555-0199 ok", "mail joe.smith (at) example (dot) com now", "my visa 4111.1111.1111.1111 thanks", "order 4111111111111112 x", "version 1.2.3 of 2024-01-02"]
    df = spark.createDataFrame(list(enumerate(cases + more)), "doc_id long, text string")
    got = pii.scanned(df).collect()
    check_spans(got, dict(enumerate(cases + more)), pii_base, pii.KINDS)
    last = [r.spans for r in sorted(got, key=lambda r: r.doc_id)[-5:]]
    assert last[0] == "phone:8:22" and last[1] == "email:5:37" and last[2] == "card:8:27" and last[3:] == ["", ""]
    rows = queries.op5_pii(spark, DATA).collect()
    check_spans(rows, texts, pii_base, pii.KINDS)
    assert all(r.n_email == sum(k == 0 for _, k, _ in pii_base(texts[r.doc_id])) for r in rows)
    assert pii.scanned(empty).count() == 0 and pii.scanned(odd).count() == len(ODD)
    assert not [n for n in str(pii.scanned(docs)._jdf.queryExecution().executedPlan()).split() if re.search("Python|Pandas|Arrow", n)]


def test_pii_address_of_every_form_is_proposed(spark):
    at = ["(at)", " (at) ", "[at]", " [AT] ", "{at}", " {at} ", " at ", " @ "]
    dot = ["(dot)", " (dot) ", "[dot]", " [DOT] ", "{dot}", " {dot} ", " dot ", " . ", "."]
    forms = [f"jane{a}{host}{d}com" for a in at for d in dot for host in ("example", "e" * 63)]
    df = spark.createDataFrame([(i, f"so {t} it is") for i, t in enumerate(forms)], "doc_id long, text string")
    every = dataclasses.replace(pii.fitted(spark), thresholds=(-1e9,) * 4)
    assert {r.doc_id: r.spans for r in pii.scanned(df, model=every).collect()} == {i: ("email:3:%d" % (3 + len(t))) for i, t in enumerate(forms)}


def test_pii_spans_of_the_trees_by_recall_and_precision(spark):
    """Whole sentences with cues other than the features look for, in other shapes than the fixed patterns find."""
    rng = random.Random(12)
    word = lambda: rng.choice("river stone garden window orange silver market".split())
    digits = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))

    def luhn(k):
        body = digits(k - 1)
        return body + next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(body + c))) % 10 == 0)

    cards = lambda: (lambda c, s: s.join(c[i : i + 4] for i in range(0, 16, 4)))(luhn(16), rng.choice("./"))
    make = {
        "email": lambda: f"{word()}{rng.choice(('.', '_'))}{word()}{rng.choice((' (at) ', ' at ', '[at]'))}{word()}{rng.choice((' (dot) ', ' dot ', '[dot]'))}{rng.choice(('com', 'org'))}",
        "ip": lambda: rng.choice(("[.]", " . ", " dot ")).join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": cards,
        "phone": lambda: rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"00{rng.randint(1, 9)}{digits(10)}")),
    }
    clean = [lambda: f"{digits(4)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 99)}.{rng.randint(0, 9)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{word()} at {word()}. Then", lambda: f"{digits(3)},{digits(3)}", lambda: f"{digits(4)} {word()}"]
    texts, real = [], {}
    for i in range(800):
        kind = rng.choice(list(make)) if i % 2 else None
        lead = f"the {word()} {rng.choice(('is', 'said', 'has', 'was sent to', 'under'))} "
        own = make[kind]() if kind else rng.choice(clean)()
        texts.append((i, f"{lead}{own} and so the {word()} went on"))
        if kind:
            real[i] = (kind, len(lead), len(lead) + len(own))
    got = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.scanned(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for kind in make:
        own = [i for i in real if real[i][0] == kind]
        hit = sum(any(k == kind and int(a) < real[i][2] and real[i][1] < int(b) for k, a, b in got[i]) for i in own)
        print("recall", kind, round(hit / len(own), 3), "of", len(own))
        assert hit >= 0.9 * len(own), kind
    wrong = sum(bool(got[i]) for i, _ in texts if i not in real)
    print("clean texts with a span", wrong, "of", 400)
    assert wrong <= 20
    assert pii.scanned(spark.createDataFrame([(1, "contact me at joe.smith at example dot com")], "doc_id long, text string")).first().spans == "email:14:42"


def test_pii_redaction(spark, odd, empty):
    rows = [(1, "é mail a.b@c.org, +1 (212) 555-0199 or 10.0.0.1", "en", "a", 3), (2, None, "en", "a", None), (3, "clean", "en", "a", 5), (4, "1.2.3.4 " * 500, "en", "a", 0), (5, "", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("base", "more", "_at", "_digits", "_proposed", "_c1")})
    got = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert got[1].text == "é mail [EMAIL], [PHONE] or [IP]" and got[1].n_chars == len(got[1].text) and got[2].text is None and got[3].text == "clean"
    assert got[4].text == "[IP] " * 500 and got[5].text == "" and pii.redacted(df).columns == df.columns
    assert pii.redacted(odd).count() == len(ODD) and pii.redacted(empty).count() == 0


def test_pii_model_from_given_labels(spark):
    """A model fitted on labels that turn the templates' round selects what they call real."""
    turned = [(k, own, a, b, 1 - y) for k, own, a, b, y in pii.examples(900, seed=5)]
    given, plain = pii.fitted(spark, turned), pii.fitted(spark)
    x = pii._features(spark, pii.examples(300, seed=6))
    score = lambda m: m.first + sum(t.predict(x[:, 2:]) for t in m.trees)
    assert np.corrcoef(score(given), score(plain))[0, 1] < -0.8 and pii.fitted(spark) is plain


def test_pii_model_separates_held_out_examples(spark):
    model = pii.fitted(spark)
    rows = [dict(zip(("kind", "own", "before", "after", "label"), r, strict=True)) for r in pii.examples(600, seed=99)]
    df = spark.createDataFrame(pd.DataFrame(rows)).withColumn("kind", F.col("kind").cast("int"))
    x = pii.features(F.col("kind"), F.col("own"), F.col("before"), F.col("after"))
    score = model.score(lambda i: x[pii.FEATURES[i]])
    got = df.select("label", (score > 0.5).cast("int").alias("p")).toPandas()
    assert (got.label == got.p).mean() > 0.9


def secrets_base(t):
    sp = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    sp += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(sp + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(spark, texts, odd, empty):
    rng = random.Random(5)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "abcd1234", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "ſecret", "\n", "xyz", "-", "/"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + [None, "password" * 3000, "token" + " " * 50_000]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    check_spans(secrets_scan.scanned(df).collect(), dict(enumerate(cases)), secrets_base, secrets_scan.KINDS)
    check_spans(queries.op6_secret_scans(spark, DATA).collect(), texts, secrets_base, secrets_scan.KINDS)
    assert secrets_scan.scanned(odd).count() == len(ODD) and secrets_scan.scanned(empty).count() == 0
    assert secrets_scan.redacted(odd).columns == odd.columns and secrets_scan.redacted(odd).count() == len(ODD) and secrets_scan.redacted(empty).count() == 0
    clean = secrets_scan.redacted(spark.createDataFrame([(1, "é token = abcdefgh1 and 0123456789abcdef0123456789abcdef.", "en", "a", 3), (2, None, "en", "a", None)], DOCS)).orderBy("doc_id").collect()
    assert clean[0].text == "é [SECRET] and [SECRET]." and clean[0].n_chars == len(clean[0].text) and clean[1].text is None


def test_entropy_by_incremental_counts():
    rng = random.Random(2)
    for kind in secrets_scan.CLASSES:
        for _ in range(60):
            text = "".join(rng.choice("abc123XYZdef456/+Q~") for _ in range(rng.randint(0, 90)))
            want = set()
            for i in range(len(text) - kind.window + 1):
                w = text[i : i + kind.window]
                h = -sum(c / kind.window * math.log2(c / kind.window) for c in Counter(w).values())
                if set(w) <= kind.members and h >= kind.bits - 1e-12 and sum(c.isdigit() for c in w) >= kind.digits and sum(c.islower() for c in w) >= kind.lower and sum(c.isupper() for c in w) >= kind.upper:
                    want |= set(range(i, i + kind.window))
            assert {p for a, b in secrets_scan.entropy_runs(text, kind) for p in range(a, b)} == want
    rng, found = random.Random(3), {16: 0, 24: 0}
    for n in found:
        for i in range(2000):
            kind = secrets_scan.CLASSES[i % 5]
            found[n] += bool(secrets_scan.all_spans("so " + "".join(rng.choice(sorted(kind.members - set("+/_=-"))) for _ in range(n)) + " it")[1])
    assert found[24] >= 0.97 * 2000, found
    for t in ("internationalization", "a-rather-long-hyphenated-word", "https://example.org/some/path/2024/01/index.html", "CamelCaseIdentifierName", "2024-01-02T10:20:30", "1234567890123456"):
        assert secrets_scan.all_spans(t)[1] == [], t
    assert secrets_scan.all_spans("key Zx9Kq2LmV7tRw4YpB8nJc3Hd ok", allowed=secrets_scan.allow_list(["Zx9.*"]))[1] == []
    many = " ".join(f"token = abcdefgh{i} Zx9Kq2LmV7tRw4YpB8nJc3Hd{i}" for i in range(50))
    assert len(secrets_scan.all_spans(many)[1]) == 100
    assert secrets_scan.all_spans("key Zx9Kq2LmV7tRw4YpB8nJc3Hd ok")[1] == [(4, 3, 28)]
    assert secrets_scan.all_spans("id 123e4567-e89b-12d3-a456-426614174000")[1] == []


def test_secrets_are_covered_whole(spark):
    """By class: how many random strings are hit, and how many of these are covered from end to end."""
    rng = random.Random(5)
    for kind in secrets_scan.CLASSES:
        letters = sorted(kind.members - set("+/_=-"))
        for n in (16, 40):
            cases = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(800)]
            found = [[(a, b) for a, _, b in secrets_scan.all_spans(f"so {c} it")[1]] for c in cases]
            hit = sum(map(bool, found))
            assert hit >= (0.9 if n == 16 else 0.99) * len(cases), (kind.name, n, hit)
            assert sum(min(f)[0] <= 3 and max(b for _, b in f) >= 3 + n for f in found if f) >= 0.99 * hit
    token = "ghp_" + "x7Kq2LmV9tRw4YpB" + "aaaaaaaaaaaaaaaaaaaa"
    mixed = "Zx9Kq2LmV7tRw4Yp" + "0123456789abcdef" * 2 + "Q"  # a fixed pattern finds the middle only
    rows = [(1, f"a {token} b {mixed} c", "en", "a", 1), (2, f"token = {token}", "en", "a", 1)]
    assert [r.text for r in secrets_scan.redacted(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()] == ["a [SECRET] b [SECRET] c", "[SECRET]"]


def join_brute(texts):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in keys}


def family(seed, copies, base_words=80):
    """Copies of one text with different numbers of edits, repeated rows among them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5, 9))):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own[: len(own) - rng.choice((0, 0, 0, 3))]))
    return out


def test_near_duplicates(spark):
    texts = family(1, 60) + family(2, 25, 300) + family(3, 12, 9) + ["A b c d", "a B c d", "a b c", "", " ", "one"]
    texts = dict(enumerate(texts))
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df.repartition(5)).collect()}
    assert got == join_brute(texts)


def test_near_duplicates_edges(spark, odd, empty):
    got = ngram_join.near_duplicates(odd).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, (r.component_id or 0)) for r in got) == [(0, 2, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 3, 5), (6, 1, 4), (6, 1, 4), (7, 1, 7)]
    assert ngram_join.near_duplicates(empty).count() == 0
    one = ngram_join.one_of_each(odd)
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 2, 3, 4, 5, 7] and one.columns == odd.columns
    twice = spark.createDataFrame([(9, "a b c d e f"), (9, "q r s t u v"), (3, "a b c d e f"), (5, "q r s t u v")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_duplicates(twice).collect()} == {3}


def test_near_duplicates_of_long_sets_and_a_large_family(spark):
    """Sets beyond the short bitmaps, one family of a thousand, and pairs on either side of the bound."""
    rng = random.Random(9)
    long = [f"v{rng.randrange(10**6)}" for _ in range(4000)]
    texts = {0: " ".join(long)}
    for i, cut in enumerate((3, 60, 83, 90, 100, 140, 400), 1):  # each changed word takes five shingles
        own = list(long)
        for k in range(cut):
            own[10 + k * (3900 // cut)] = f"z{i}_{k}"
        texts[i] = " ".join(own)
    texts[8], texts[9] = " ".join(long[:3300]), " ".join(long[:3100])
    texts |= {20 + i: t for i, t in enumerate(family(4, 1000, 60))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df.repartition(6)).collect()}
    assert got == join_brute(texts)


def test_long_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m, both in ((600, 700, 500), (520, 3000, 20), (5000, 5200, 4900)):
        x, shared = rng.integers(0, 2**63, n + m, dtype=np.uint64), both
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:shared], x[n : n + m - shared]]))
        maps = ngram_join.long_maps(np.concatenate([a, b]), np.array([0, n, n + m])).to_pylist()
        assert ngram_join.apart(*maps) == ngram_join.apart(*maps[::-1]) <= n + m - 2 * shared
        assert ngram_join.apart(maps[0], maps[0]) == 0
    assert ngram_join.long_maps(np.arange(600, dtype=np.uint64), np.array([0, 512, 600])).to_pylist() == [None, None]


def test_intermediate_tables_go(spark):
    """What operators write on their way is deleted; what they hand on stays."""
    from tidegrid.llm.store import persisted, scope, shared_dir

    at = shared_dir(spark).removeprefix("file://") + "/tidegrid"
    before = set(os.listdir(at)) if os.path.exists(at) else set()
    out = ngram_join.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"))
    left = set(os.listdir(at)) - before
    assert len(left) == 1 and left.pop().startswith("join-result") and out.count() == 2
    with scope() as outer:
        with scope() as inner:
            one = persisted(spark.range(3), "one")
            two = inner.result(one, "two")
        assert two.count() == 3 and not [n for n in os.listdir(at) if n.startswith("one-")]
        outer.drop()
    assert not [n for n in os.listdir(at) if n.startswith("two-")]


def test_rows_of_one_id_keep_the_links_of_each_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = [(9, a), (9, b), (3, a), (20, b + " more"), (None, b), (30, "quite another text of its own"), (30, None)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 96, 0), (3, 96, 3), (9, 96, 3), (9, 96, 3), (20, 97, 3), (30, 0, 30), (30, 2, 30)]


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_a_chain_take_few_tables(spark, monkeypatch):
    """Links are contracted in the tasks that make them, by blocks; those that fit one block take no rounds."""
    written, inner = [], components.persisted
    monkeypatch.setattr(components, "persisted", lambda df, label: written.append(label) or inner(df, label))
    ids = list(range(3000))
    random.Random(5).shuffle(ids)
    links = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(2999) if i != 1500], "a long, b long").repartition(7)
    low, high = min(ids[:1501]), min(ids[1501:])
    expected = {x: low if i < 1501 else high for i, x in enumerate(ids)}
    found = [(r.node, r.component) for r in components.components(links).collect()]
    assert len(found) == 3000 and dict(found) == expected
    assert len(written) == 1
    monkeypatch.setattr(components, "BLOCK", 100)
    found = [(r.node, r.component) for r in components.components(links).collect()]
    assert len(found) == 3000 and dict(found) == expected
    assert len(written) > 3


def decontam_brute(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for k, t in texts.items():
        w, hit, names = words(t), set(), []
        for name, item in items.items():
            v = words(item)
            n = min(10, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            at = [i for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in grams]
            if at:
                names.append(str(name))
            hit |= {j for i in at for j in range(i, i + n)}
        out[k] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, odd, empty):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "B", "ç", "d1", "Eé", "f_g", "日"])
    items = {i: " ".join(word() for _ in range(rng.choice((0, 1, 3, 10, 12, 30)))) for i in range(12)} | {12: None}
    texts = {i: rng.choice([" ", "-", ". "]).join(word() for _ in range(rng.randint(0, 60))) + (items[rng.randrange(12)] if rng.random() < 0.6 else "") for i in range(80)} | {80: None}
    docs_ = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for most in (2_000_000, 40):  # one broadcast, then several
        got = {r.doc_id: tuple(r)[1:] for r in decontam.digest(decontam.hits(docs_, bench, most_windows=most)).collect()}
        assert got == decontam_brute(texts, items)
    assert decontam.hits(odd, bench).count() == len(ODD) and decontam.hits(empty, bench).count() == 0
    assert decontam.digest(decontam.hits(docs_, bench.limit(0))).where("contaminated").count() == 0
    passage = " ".join(f"p{i}" for i in range(15))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, "start here " + passage.upper() + ", " + "and so on " * 20, "en", "a", 0), (2, passage, "en", "a", 0), (3, "clean", "en", "a", 5), (4, None, "en", "a", None)]
    bench = bench.unionByName(spark.createDataFrame([(2, "other words that are in no document at all " * 3), (3, None)], bench.schema))
    clash = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("row", "spans", "_row", "_SPANS", "n_words", "items")})
    first = [sorted(map(tuple, decontam.cleaned(clash, bench, most_windows=n).collect()), key=str) for n in (2_000_000, 10)]
    assert first[0] == first[1] and decontam.cleaned(clash, bench).columns == clash.columns
    for most in (2_000_000, 5):  # a very long text, repeated and null ids, an empty table
        kept = decontam.cleaned(odd, bench, most_windows=most)
        assert kept.columns == odd.columns and kept.count() == len(ODD) and decontam.cleaned(empty, bench, most_windows=most).count() == 0
    out = {r.doc_id: r for r in decontam.cleaned(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert out[1].text == "start here , " + "and so on " * 20 and out[1].n_chars == len(out[1].text) and 2 not in out and out[3].text == "clean" and out[4].text is None


def test_items_without_an_id_are_found(spark):
    """A null name counts as one item, as in the query's SQL, and is left out of the digest."""
    passage, other = (" ".join(f"{c}{i}" for i in range(15)) for c in "pq")
    bench = spark.createDataFrame([(None, passage), (None, other), (7, passage + " end")], "item_id long, text string")
    docs_ = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"{other} and so on " + "x y " * 30), (3, "clean"), (4, f"{passage} {other}")], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs_.toPandas())
    con.register("benchmark", bench.toPandas().astype({"item_id": "Int64"}))
    want = {tuple(r) for r in con.sql(queries.OP9_SQL).df()[["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]].itertuples(index=False)}
    for most in (2_000_000, 10):
        got = {tuple(r) for r in decontam.digest(decontam.hits(docs_, bench, most_windows=most)).collect()}
        assert got == want
    assert {(x[0], x[2], x[3]) for x in got} == {(1, 15, 2), (2, 15, 1), (3, 0, 0), (4, 30, 2)}
    assert [x[4] for x in got if x[0] == 1] == [decontam.items_digest(["7"])]
    left = {r.doc_id: r.text for r in decontam.cleaned(docs_, bench).collect()}
    assert set(left) == {2, 3} and "q0" not in left[2]


def test_quality(spark, docs, texts, odd, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in queries.op10_quality_rules(spark, DATA).collect():
        t = texts[r.doc_id]
        w = word.findall(t)
        lines = [x for x in t.split("\n") if word.search(x)]
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and (not r.kept or not r.base_failed)
    assert quality_rules.judged(quality_rules.measured(odd), quality_rules.DecisionList()).where("kept").count() == 0
    assert quality_rules.filtered(empty, labels).count() == 0
    same = quality_rules.filtered(docs.withColumn("n_words", F.lit("clash")), labels.limit(0))
    assert same.columns == [*docs.columns, "n_words"] and same.count() == sum(1 for t in texts.values() if True) - docs.join(queries.op10_quality_rules(spark, DATA).where("base_failed").select("doc_id"), "doc_id").count()


def test_quality_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.learned(d, labels.where("doc_id % 2 = 0"))
    got = quality_rules.judged(quality_rules.measured(d), rules).join(labels.where("doc_id % 2 = 1 AND quality = 1"), "doc_id").where("NOT base_failed")
    assert rules.rules and got.where("NOT kept").count() <= 0.02 * got.count()
    bad = quality_rules.judged(quality_rules.measured(d), rules).join(labels.where("doc_id % 2 = 1 AND quality = 0"), "doc_id").where("NOT base_failed")
    assert bad.where("NOT kept").count() >= 0.7 * bad.count()


def test_decision_list_column_is_its_prediction(spark):
    rules = quality_rules.DecisionList([quality_rules.Rule([("symbol_share", ">=", 0.5), ("word_length", "<", 3.0)]), quality_rules.Rule([("bar_share", ">=", 0.1)])])
    stats = quality_rules.measured(spark.createDataFrame([(i, t) for i, t in enumerate(["# $ a", "a | b", "plain words here", ""])], "doc_id long, text string"))
    rows = stats.select("doc_id", rules.column().alias("k"), *[quality_rules.share(n).alias(n) for n in quality_rules.FEATURES]).orderBy("doc_id").toPandas()
    assert rows.k.tolist() == rules.predict({n: rows[n].to_numpy() for n in quality_rules.FEATURES}).tolist() == [False, False, True, True]


def chat_brute(convs, models, half):
    """Plain Viterbi by lines: ``convs`` maps a conversation to its ordered texts; turns as (role, text)."""
    markers = [re.compile(p) for _, p in chat_format.MARKERS]
    out = {}
    for conv, texts in convs.items():
        own, states = models[1 - half[conv]], range(chat_format.STATES)
        lines = [(line, i == 0) for t in texts for i, line in enumerate(t.split("\n"))]
        best = []
        for k, (line, first) in enumerate(lines):
            marker = next((i + 1 for i, m in enumerate(markers) if m.match(line)), 0) + 4 * first
            cell = (marker * 10 + min(9, int(math.log2(len(line) + 1)))) * 2 + line.rstrip(" ").endswith("?")
            step = {}
            for s in states:
                if not k:
                    came = (own.start[s] if s < 3 else -math.inf, None)
                else:
                    came = max(((best[-1][p][0] + own.step[p][s], p) for p in states), key=lambda x: x[0])
                step[s] = (came[0] + own.emit[s][cell], came[1])
            best.append(step)
        path = [max(states, key=lambda s: best[-1][s][0])]
        for step in best[:0:-1]:
            path.append(step[path[-1]][1])
        turns, k = [], 0
        for text in texts:
            for line in text.split("\n"):
                state = path[::-1][k]
                k += 1
                if state < 3:
                    turns.append((chat_format.ROLES[state], []))
                turns[-1][1].append(line)
        canon = []
        for role, part in turns:
            said = [name for (name, _), m in zip(chat_format.MARKERS, markers, strict=True) if m.match(part[0])][:1]
            plain = "\n".join(part)
            if said == [role]:
                plain = plain[markers[chat_format.ROLES.index(role)].match(part[0]).end() :].lstrip()
            canon.append((role, f"<|{role}|>\n{plain}\n<|end|>\n"))
        out[conv] = canon
    return out


def test_chat(spark):
    rows = [(1, 0, "system", "System: be kind"), (1, 1, "user", "User: what is this?"), (1, 2, "assistant", "Assistant: a test.\nOf two lines."), (2, 0, None, "Human: hi"), (2, 1, "user", None), (2, 1, "user", None), (None, 3, "odd", "AI: hello")]
    rows += [(4, None, None, "User: b\nmore of b\nAssistant: c\nUser: d?"), (4, None, None, "User: b\nmore of b\nAssistant: c\nUser: d?"), (5, 0, None, "line of text\n" * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("conv", "part", "half", "x", "row", "way", "edge")})
    got = chat_format.formatted(df).collect()
    assert len(got) == len(rows) + 4
    by = {(r.conv_id, r.turn, r.part): r for r in got}
    assert [by[*k, 0].role for k in ((1, 0), (1, 1), (1, 2), (2, 0), (None, 3))] == ["system", "user", "assistant", "user", "assistant"]
    assert by[1, 2, 0].rendered == "<|assistant|>\na test.\nOf two lines.\n<|end|>\n"
    assert [by[4, None, i].rendered for i in range(3)] == ["<|user|>\nb\nmore of b\n<|end|>\n", "<|assistant|>\nc\n<|end|>\n", "<|user|>\nd?\n<|end|>\n"]
    assert sum(r.conv_id == 4 for r in got) == 6 and by[2, 1, 0].rendered.endswith("|>\n\n<|end|>\n")
    assert chat_format.formatted(spark.createDataFrame([], df.schema)).count() == 0
    # Roles of conversations that the model was not fitted on (each half is decoded by the other's).
    sf = "/root/testdata/sf0.01"
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    joined = queries.op8_chat_formatting(spark, sf).withColumnRenamed("role", "r").join(conv, ["conv_id", "turn"])
    assert joined.count() == conv.count() and joined.where("r = role").count() >= 0.9 * conv.count()


def test_one_marker_is_taken_off_and_given_back(spark):
    """Of two markers the first goes, of another role's none; what was taken off and the rest are the text."""
    cases = [("user", "User: Model: T-800, what year?", "Model: T-800, what year?"), ("user", "me: AI: is it safe?", "AI: is it safe?"), ("user", "Model: T-800?", "Model: T-800?"), ("assistant", "  Answer:\n\n  42 ", "42 "), ("user", " plain  ", " plain  "), ("assistant", "\nUser: x", "\nUser: x"), ("system", "", ""), ("user", "q: a: b", "a: b")]
    df = spark.createDataFrame([(r, t) for r, t, _ in cases], "role string, text string")
    got = df.select("text", chat_format.rendered(F.col("role"), F.col("text")).alias("r"), chat_format.marker(F.col("role"), F.col("text")).alias("m"), "role").collect()
    for r, (role, text, want) in zip(got, cases, strict=True):
        assert r.r == f"<|{role}|>\n{want}\n<|end|>\n" and r.m + want == text
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("turn", F.col("turn") + 1)  # numbered from 1
    own = {(r.conv_id, r.turn): r.text for r in conv.collect()}
    back = {}
    for r in sorted(chat_format.formatted(conv).collect(), key=lambda r: (r.conv_id, r.turn, r.part)):
        back.setdefault((r.conv_id, r.turn), []).append(r.marker + r.rendered.removeprefix(f"<|{r.role}|>\n").removesuffix("\n<|end|>\n"))
    assert {k: "\n".join(v) for k, v in back.items()} == own
    models = chat_format.fitted(chat_format.prepared(conv))
    assert all(m.start.max() > np.log(0.4) for m in models)  # starts are learnt though no turn has the number 0


def test_viterbi_over_partitions_is_plain_viterbi(spark):
    rng = np.random.default_rng(0)
    models = tuple(chat_format.Hmm.of(rng.integers(0, 50, 3), rng.integers(0, 50, (3, 3)), rng.integers(0, 9, (6, chat_format.CELLS))) for _ in range(2))
    line = lambda: str(rng.choice(["User: ", "Assistant: ", "System: ", "", "", "> quoted Bot: "])) + "x" * int(rng.integers(0, 200)) + ("?" if rng.random() < 0.4 else "")
    texts = {c: ["\n".join(line() for _ in range(rng.integers(1, 6))) for _ in range(n)] for c, n in enumerate([150, 1, 2, 3, 40, 1, 1, 90, 2])}
    df = spark.createDataFrame([(c, i, "user", t) for c, own in texts.items() for i, t in enumerate(own)], "conv_id long, turn long, role string, text string")
    half = {r.conv: r.half for r in chat_format.prepared(df).select("conv", "half").distinct().collect()}
    want = chat_brute(texts, models, half)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {}
            for r in sorted(chat_format.formatted(df, models=models).collect(), key=lambda r: (r.conv_id, r.turn, r.part)):
                got.setdefault(r.conv_id, []).append((r.role, r.rendered))
            assert got == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sql_of_op7_and_op9(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("op7_ngram_jaccard_join", "op9_benchmark_decontamination"):
        got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert (got[cols].sort_values("doc_id").to_numpy() == want[cols].sort_values("doc_id").to_numpy()).all()


def test_pipeline(spark, texts):
    """Each stage against brute force on what it was given; the last packs exactly what is left."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, d, DATA).cache()
    own = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == d.columns and all(own[k] == texts[k] for k in own) and len(own) > 0.6 * len(texts)
    one = stages["ngram_jaccard_join"](spark, kept, DATA).cache()
    want = {c for _, c in join_brute(own).values()}
    assert {r.doc_id for r in one.collect()} == want and one.columns == d.columns
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    clean = stages["benchmark_decontamination"](spark, one, DATA).cache()
    after = {r.doc_id: r.text for r in clean.collect()}
    brute = decontam_brute({k: own[k] for k in want}, items)
    assert all(after[k] == own[k] for k in want if not brute[k][1]) and not any(x[1] for x in decontam_brute(after, items).values())
    safe = stages["secret_scans"](spark, clean, DATA).cache()
    left = {r.doc_id: r.text for r in safe.collect()}
    assert set(left) == set(after) and not any(secrets_base(t) for t in left.values())
    check_packing(stages["mixture_packing"](spark, safe, DATA).collect(), {k: hugging(t) + [1] for k, t in left.items()})
    assert corpus_pipeline.run(spark, DATA).agg(F.sum("length")).first()[0] == sum(len(hugging(t)) + 1 for t in left.values())


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
        out = stage(spark, docs_, str(tmp_path))
        assert out.count() == 0 and out.columns == docs_.columns
