"""Hash tables that stay where they are: bucketed, sorted Parquet, which joins by its key read in place.

A bucket is the rows of equal hash of the key modulo their number, as exchanges
by that key have it, in one sorted file. A join with such a table moves the
other side only. Row groups carry Bloom filters of the key, so that a look-up of
a few values skips those that hold none of them. The files need no catalog: each
session enters them into its own under a name made from their path.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.sources.files import read_json, replacing, write_json
from sketchloom.sources.sinks import parquet

#: Rows of a row group: 8 MB of hashes, whose Bloom filter takes 1.9 MB.
ROW_GROUP_ROWS = 1_000_000
#: Part of absent values that a Bloom filter lets pass.
PASSES = 0.001
#: Values up to which a look-up is a filter of the scan instead of a join.
FEW = 1000

_DATA, _NOTE = "buckets", "buckets.json"


def filtered(df: DataFrame, key: str, row_group_rows: int = ROW_GROUP_ROWS):
    """A writer of Parquet with a Bloom filter of ``key`` in every row group."""
    return parquet(df, row_group_rows).option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", row_group_rows).option(f"parquet.bloom.filter.fpp#{key}", PASSES)


def write_buckets(df: DataFrame, path: str, key: str, buckets: int, *, note: dict | None = None, overwrite: bool = False, row_group_rows: int = ROW_GROUP_ROWS) -> dict:
    """Write ``df`` in buckets by ``key``, with a sidecar of what is needed to read it and of ``note``; returns the sidecar."""
    spark = df.sparkSession
    kept = {"key": key, "buckets": buckets, "schema": ", ".join(f"`{n}` {t}" for n, t in df.dtypes), **(note or {})}
    with replacing(spark, path, overwrite) as at:
        # dealt out as the buckets are, so each is one task and one file
        dealt = df.repartition(buckets, key).sortWithinPartitions(key)
        name = _name(at)
        filtered(dealt, key, row_group_rows).bucketBy(buckets, key).sortBy(key).option("path", f"{at}/{_DATA}").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
        write_json(spark, f"{at}/{_NOTE}", kept)
    return kept


def _name(path: str) -> str:
    return f"sketchloom_{hashlib.md5(path.encode()).hexdigest()}"


def note_of(spark: SparkSession, path: str) -> dict:
    return read_json(spark, f"{path}/{_NOTE}")


def open_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was written."""
    kept = note_of(spark, path)
    name, place = _name(path), f"{path}/{_DATA}".replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({kept['schema']}) USING parquet CLUSTERED BY ({kept['key']}) SORTED BY ({kept['key']}) INTO {kept['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def among(table: DataFrame, key: str, values: list[int]) -> DataFrame:
    """The rows with one of a few values; row groups without any are skipped."""
    if len(values) > FEW:
        raise ValueError(f"{len(values)} values are too many for a filter; join them")
    return table.filter(F.col(key).isin(values)) if values else table.limit(0)
