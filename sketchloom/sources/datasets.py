"""Readers of signature relations and hash datasets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.sources.files import exists, files_below
from sketchloom.sources.streams import open_address


def named(column: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def read_signatures(spark: SparkSession, path: str, *, ksize: int | None = None, file_limit: int | None = None, sample_fraction: float | None = None, seed: int = 1337, sample_column: str = "sample_id", hash_column: str = "min_hash", ksize_column: str = "ksize") -> DataFrame:
    """(sample_id, min_hash[, ksize]) without nulls in the keys; ``file_limit`` reads the first files by name, keeping partition columns."""
    if file_limit:
        files = files_below(spark, path)[:file_limit]
        if not files:
            raise FileNotFoundError(f"no Parquet files below {path}")
        df = spark.read.option("basePath", path).parquet(*files)
    else:
        df = spark.read.parquet(path)
    missing = {sample_column, hash_column} - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    columns = [named(sample_column).cast("string").alias("sample_id"), named(hash_column).cast("bigint").alias("min_hash")]
    if ksize_column in df.columns:
        columns.append(named(ksize_column).cast("int").alias("ksize"))
    elif ksize is not None:
        raise ValueError(f"{path} has no {ksize_column} to filter by")
    df = df.select(*columns)
    if ksize is not None:
        df = df.filter(F.col("ksize") == ksize)
    df = df.dropna(subset=["sample_id", "min_hash"])
    if sample_fraction is not None:
        if not 0 < sample_fraction <= 1:
            raise ValueError("the fraction must be over 0 and at most 1")
        if sample_fraction < 1:
            df = df.sample(False, sample_fraction, seed)
    return df


def read_hive_hashes(spark: SparkSession, root: str, pattern: str = "bucket=*", *, column: str = "hash", name: str = "min_hash") -> DataFrame:
    """One hash column of a Hive-partitioned dataset; the partition columns don't come along."""
    return spark.read.option("basePath", root).parquet(f"{root}/{pattern}").select(named(column).cast("bigint").alias(name))


def read_plain(spark: SparkSession, *globs: str) -> DataFrame:
    """Parquet files by path or pattern, without partition discovery."""
    return spark.read.option("recursiveFileLookup", "true").parquet(*globs)


def footer_statistics(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row: n_rows and the least and the largest value (``<column>_min``, ``<column>_max``) of columns, from the footers alone.

    The aggregates are pushed into the scan, so no column is read. That takes settings of its own, hence a session of its
    own beside ``spark``.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    ends = [f(named(c)).alias(f"{c}_{end}") for c in columns for end, f in (("min", F.min), ("max", F.max))]
    return own.read.parquet(path).agg(F.count("*").alias("n_rows"), *ends)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, n_rows) as the footers of all Parquet files below ``path`` have them; each task opens some of the files."""
    files = files_below(spark, path)
    if not files:
        return spark.createDataFrame([], "file string, row_group int, n_rows bigint")
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 256)).mapInArrow(_footers, "file string, row_group int, n_rows bigint")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("file").to_pylist():
            with open_address(file) as source:
                meta = parquet.read_metadata(source)
            n = meta.num_row_groups
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([meta.row_group(i).num_rows for i in range(n)], pa.int64())], ["file", "row_group", "n_rows"])


def read_counts(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"no counts in {path}")
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def union_all(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    """All rows of the frames; ``empty`` gives the columns if there are none."""
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else empty
