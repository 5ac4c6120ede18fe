"""The trie of conversation prefixes against brute force."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import pytest


from sketchloom.llm import queries, trie

DATA = "/root/testdata/sf0.01"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """Rows of every prefix, each from its members."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select(OUT).fillna(-1, ["parent_conv_id"]).collect())


def frame(spark, convs):
    rows = [(c, t, role, text) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("seed,parts,pending", [(1, 1, 10_000), (2, 7, 10_000), (3, 23, 10_000), (4, 40, 10_000), (5, 5, 2), (6, 1, 1)])
def test_ranges_and_stitching(spark, seed, parts, pending, monkeypatch):
    rnd = random.Random(seed)
    convs = {}
    for c in rnd.sample(range(-50, 5000), 240):
        convs[c] = [(rnd.choice("ab"), rnd.choice(["", "x", "yé", "zzz"])) for _ in range(rnd.choice([1, 1, 2, 3, 4, 9]))]
    for c in range(5000, 5120):
        convs[c] = [("a", "x"), ("b", "yé")]
    df = trie.conversations(frame(spark, convs))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    monkeypatch.setattr(trie, "PENDING", pending)
    try:
        assert rows_of(trie.prefix_trie(df)) == brute(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pending_children_are_written(monkeypatch):
    monkeypatch.setattr(trie, "PENDING", 3)
    key = lambda *t: b"".join(bytes([x]) * 16 for x in t)
    sweep = trie._Sweep(0)
    for i, t in enumerate([(1,), *((2, 2, j) for j in range(9)), (3,)]):
        sweep.add(key(*t), i, [1] * len(t))
    sweep.end()
    assert sum(r[0] == trie.PART and r[5] == 2 for r in sweep.rows) == 1
    assert sum(r[0] == trie.NODE and r[5] == 3 and r[3] is not None for r in sweep.rows) == 9


def test_cases(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, turns int, key string"
    rows = [(1, None, None, "a"), (1, 5, "u", None), (2, 0, "", "a"), (2, 0, "", "a"), (None, 0, "u", "x"), (3, 1, "u", "long " * 50_000), (3, 0, "u", "a"), (4, 0, "u", "a")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], schema)
    want = {1: [("", "a"), ("u", "")], 2: [("", "a"), ("", "a")], 3: [("u", "a"), ("u", "long " * 50_000)], 4: [("u", "a")]}
    assert rows_of(trie.prefix_trie(trie.conversations(df))) == brute(want)
    assert trie.prefix_trie(trie.conversations(df.limit(0))).collect() == []
    none = spark.createDataFrame([(1, []), (2, [])], "conv_id bigint, turns array<struct<key: string, size: bigint>>")
    assert rows_of(trie.prefix_trie(none)) == brute({1: [], 2: []})


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_rebuilding(spark):
    convs = {c: [("u", f"{c % 3}{i}") for i in range(c % 7 + 1)] for c in [*range(100, 160), *range(205, 230)]}
    got = trie.prefix_trie(queries.rebuilt(trie.conversations(frame(spark, convs))))
    assert any(not t for t in rebuilt(convs).values())
    assert rows_of(got) == brute(rebuilt(convs))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_query(spark):
    own = defaultdict(list)
    for c, role, text in duckdb.sql(f"SELECT conv_id, coalesce(role, ''), coalesce(text, '') FROM '{DATA}/conversations.parquet' ORDER BY conv_id, turn NULLS FIRST").fetchall():
        own[c].append((role, text))
    df = queries.op12_prefix_trie(spark, DATA)
    assert df.columns == OUT and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    assert rows_of(df) == brute(rebuilt(own))
