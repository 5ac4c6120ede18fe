"""The registered queries against the same as SQL."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sketchloom.operators import counts
from sketchloom.plans import proxies, roundtrips

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


SQL = proxies.oracle_sql() | roundtrips.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    found = db.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, map(tuple, df.collect())) == _rows(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_spread_keys_of_any_size(spark, tmp_path):
    """Keys whose product doesn't fit into 64 bits; the SQL ends at key 9223."""
    keys = [0, 3, 9223, 9224, 19_999, 1_199_999, 9224, (1 << 63) - 1, -(1 << 63), -5]
    parts, suppliers = [3, 9224, 1_199_999], [-5, 77]
    spark.createDataFrame([(k,) for k in keys], "l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 1) for k in parts], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in suppliers], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    wide = {k: (k * proxies.SPREAD - (1 << 62) + (1 << 63)) % (1 << 64) - (1 << 63) for k in keys}
    got = lambda name: sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    inside = lambda h, fraction: (h >> 2) % (1 << 20) < round(fraction * (1 << 20))
    assert got("bit_sample_hashes") == sorted((wide[k],) for k in keys if inside(wide[k], 0.3))
    assert got("left_minus_rights_sampled") == sorted((wide[k], wide[k] & 3) for k in keys if k not in parts + suppliers and inside(wide[k], 0.25))
    assert got("top_bit_shards") == sorted(Counter((wide[k] % (1 << 64)) >> 56 for k in keys).items())
    assert got("index_top_bits_probe") == sorted((k, k in parts) for k in set(keys))


def test_match_files_grow_in_number(spark, monkeypatch):
    """No file of matches, and so no task that writes or reads it, holds more of a larger table."""
    monkeypatch.setattr(roundtrips, "FILE_ROWS", 500)
    for folder in roundtrips._match_folders(spark, DATA).values():
        sizes = [r[0] for r in spark.read.option("header", "true").csv(folder).groupBy(F.input_file_name()).count().select("count").collect()]
        assert len(sizes) == 12 and max(sizes) <= 600


def test_flagship_deals_pairs_by_their_number(spark, monkeypatch):
    """Each task makes distinct about TASK_ROWS pairs, whatever the size of the table."""
    monkeypatch.setattr(counts, "TASK_ROWS", 500)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    df = proxies.flagship(spark, DATA)
    assert re.search(rf"hashpartitioning\(sample_id#\d+, min_hash#\d+L, {n}\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())
    found = duckdb.sql(SQL["flagship"].replace("FROM lineitem", f"FROM '{DATA}/lineitem.parquet'").replace("FROM part", f"FROM '{DATA}/part.parquet'").replace("FROM supplier", f"FROM '{DATA}/supplier.parquet'"))
    assert list(map(tuple, df.select(*found.columns).collect())) == found.fetchall()
