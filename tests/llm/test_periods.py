"""Periodic runs against brute force."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import periods, queries

DATA = "/root/testdata/sf0.01"


def brute_runs(words):
    """All maximal stretches by trying every period."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(6, 4 * q) and not any(all(words[j] == words[j + s] for j in range(start, end - s)) for s in range(1, q)):
                out.add((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def result(words):
    rs = brute_runs(words)
    gone = {i for s, n, q in rs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in rs), default=None)
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        len(rs),
        *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in rs).encode()).hexdigest(),
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
    )


def found(texts):
    """Runs of several texts named together."""
    sizes = [len(t) for t in texts]
    words = np.concatenate([np.array(t, np.int64) for t in texts]) if sum(sizes) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    start, end, period = periods.runs(words, row)
    first = np.cumsum(sizes) - sizes
    out = [[] for _ in texts]
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        out[row[s]].append((s - first[row[s]], e - s, q))
    return out


def test_runs_of_random_texts():
    rng = np.random.default_rng(7)
    for letters in (1, 2, 3, 5):
        for _ in range(150):
            texts = []
            for _ in range(4):
                t = rng.integers(0, letters, rng.integers(0, 40)).tolist()
                for _ in range(rng.integers(0, 4)):
                    unit = rng.integers(0, letters, rng.integers(1, 9)).tolist()
                    t = t + (unit * 9)[: rng.integers(1, 8 * len(unit) + 1)]
                texts.append(t)
            assert found(texts) == [brute_runs(t) for t in texts]


def test_long_runs():
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 50, 700).tolist()
    texts = [[1] * 5000, [1, 2] * 2500 + [1], unit * 5, ([1] * 40 + [2]) * 30, (unit[:90] * 4 + [77]) * 5]
    got = found(texts)
    assert got[0] == [(0, 5000, 1)] and got[1] == [(0, 5001, 2)] and got[2] == [(0, 3500, 700)]
    assert got[3] == brute_runs(texts[3]) and got[4] == brute_runs(texts[4])


def test_cases(spark):
    texts = [None, "", " \n\t ", "a a a a a", "a a a a a a", "x " + "a b " * 4, "é é " * 9, "a a a a a a\x0bb\x0cc", "w " * 20000, "a a a a a a"]
    df = spark.createDataFrame([(i if i != 8 else None, t, "t", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, runs string, n_words int")
    rows = periods.collapse_runs(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = 8 if r["doc_id"] is None else r["doc_id"]
        words = re.findall("[^\x20\x09-\x0d]+", texts[i] or "")
        rs = brute_runs(words) if i != 8 else [(0, 20000, 1)]
        assert [tuple(x) for x in r["runs"]] == rs and r["n_words"] == len(words)
        gone = {k for s, n, q in rs for k in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for k, w in enumerate(words) if k not in gone) and r["n_dropped"] == len(gone)
    assert periods.collapse_runs(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_query(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    rows = queries.op13_periodic_runs(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    checked = 0
    for r in rows:
        words = re.findall("[^\x20\x09-\x0d]+", texts[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if n > 4000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert tuple(r)[1:] == result(words)
        checked += 1
    assert checked > 900


def test_planting_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (10, None), (11, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, queries.repeated_tails(df).select(F.coalesce("doc_id", F.lit(0)), "text").fillna("").collect())) == [(0, "a b"), (10, ""), (11, "")]
