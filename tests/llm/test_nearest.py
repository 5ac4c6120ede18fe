"""Nearest neighbours: exact where the search covers all, and by recall against brute force."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import nearest, queries

DATA = "/root/testdata/sf0.1"


def brute(vectors, asked, limit=20):
    """(query, rank, id, score) over dicts of usable vectors."""
    out = []
    for q in asked:
        scores = sorted((-sum(x * y for x, y in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:limit])]
    return sorted(out)


def same(got, want):
    got = sorted(map(tuple, got))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))


def test_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (40, []), (60, [1.0]), (10, [-1.0, -0.0]), (11, [-1.0, 0.0]), (4, [0.5, 0.5]), (80, [0.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id bigint, embedding array<double>, id int, vector string")
    usable = {0: [1.0, 0.0], 20: [1.0, 0.0], 3: [1.0, 0.0], 4: [0.5, 0.5], 10: [-1.0, 0.0], 11: [-1.0, 0.0], 80: [0.0, 2.0]}
    same(nearest.nearest(df, F.col("id") % 20 == 0).collect(), brute(usable, [0, 20, 80]))
    same(nearest.nearest(df, F.col("id") % 20 == 0, limit=2).collect(), brute(usable, [0, 20, 80], 2))
    assert nearest.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []
    assert nearest.nearest(df.filter("vec_id = 0"), F.col("id") % 20 == 0).collect() == []


def test_copies_ties_and_sizes(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.integers(-3, 4, 5).tolist() for i in range(300)} | {i: [3.0, 1.0, 0.0, 0.0, 2.0] for i in range(300, 700)} | {700: [1e8, 0.0, 0.0, 0.0, 1.0]}
    vectors = {i: [float(x) for x in v] for i, v in vectors.items() if any(v)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    same(nearest.nearest(df, F.col("id") % 20 == 0).collect(), brute(vectors, [i for i in vectors if i % 20 == 0]))


def test_lists_grow_with_the_logarithm():
    assert nearest.sizes(1) == nearest.sizes(1 << 16) == {"listed": 48, "degree": 64, "beam": 112}
    assert [nearest.sizes(n)["listed"] for n in ((1 << 16) + 1, 1 << 17, 1 << 26)] == [54, 54, 108]


def test_hub_is_told_of_few(spark):
    nodes = spark.createDataFrame([(i, bytes(5), [0], [float(i)]) for i in range(1, 400)] + [(0, bytes(5), [], [])], "id bigint, code binary, ids array<bigint>, scores array<float>")
    told = nearest._told(nodes, 48, 64).groupBy("at").count().collect()
    assert {r["at"]: r["count"] for r in told}[0] == 65


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_query_recall(spark):
    found = queries.op11_nearest(spark, DATA).collect()
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchnumpy()
    ids, x = table["vec_id"], np.stack(table["embedding"]).astype(np.float64)
    got = {}
    for r in sorted(map(tuple, found)):
        got.setdefault(r[0], []).append(r[1:])
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[at]
        mine = got[ids[at]]
        assert [m[0] for m in mine] == list(range(1, 21)) and ids[at] not in [m[1] for m in mine]
        assert all(abs(scores[np.searchsorted(ids, m[1])] - m[2]) < 1e-9 for m in mine) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        scores[at] = -np.inf
        hits += len(set(ids[np.argsort(-scores)[:20]]) & {m[1] for m in mine})
        total += 20
    assert hits / total >= 0.95
