"""Writers of the jobs' datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.sources.files import children, copy, remove, rename, replacing, run_id, single_part

#: Rows of a row group where nothing else is asked.
ROW_GROUP_ROWS = 1_000_000


def parquet(df: DataFrame, row_group_rows: int | None = None):
    """A writer of compressed Parquet; every row group but a file's last has exactly so many rows."""
    writer = df.write.option("compression", "zstd")
    if row_group_rows is None:
        return writer
    if row_group_rows < 1:
        raise ValueError("a row group has a row at least")
    # the limit in rows decides, so the one in bytes and the next check of it are put out of reach
    return writer.option("parquet.block.row.count.limit", row_group_rows).option("parquet.block.size", (1 << 31) - 1)


def write_partitioned(df: DataFrame, path: str, by: str, *, overwrite: bool = False, sort: list[str] | None = None, files: int | None = None, values: int | None = None, spread: Column | None = None, row_group_rows: int | None = None) -> str:
    """Parquet partitioned by a column.

    Each value is written by one task, so it has one file, but for large ones, which adaptive execution splits into several.
    ``values``: the column holds remainders by that number; each is then a task of its own instead of what hashing of the
    numbers makes of them. ``files``: so many files for each such value, among which rows are dealt by ``spread`` (a hash
    of them), for values too large for one task.
    """
    if files and (values is None or spread is None):
        raise ValueError("several files for a value need the number of values and what rows are dealt by")
    if values is None:
        df = df.hint("rebalance", by)
    else:
        number, each = F.pmod(F.col(by), F.lit(values)).cast("int"), files or 1
        df = df.repartitionById(values * each, number * each + F.pmod(spread, F.lit(each)).cast("int") if each > 1 else number)
    with replacing(df.sparkSession, path, overwrite) as at:
        parquet(df.sortWithinPartitions(by, *(sort or ())), row_group_rows).partitionBy(by).parquet(at)
    return path


def write_plain(df: DataFrame, path: str, *, overwrite: bool = False) -> str:
    """Parquet as the plan deals it out."""
    with replacing(df.sparkSession, path, overwrite) as at:
        parquet(df).parquet(at)
    return path


def write_single(df: DataFrame, path: str, *, overwrite: bool = False, row_group_rows: int = ROW_GROUP_ROWS, sort: list[str] | None = None) -> str:
    """One Parquet part, sorted if asked. One task sorts and writes it: for results of one file's size; others have :func:`write_sorted`."""
    df = df.repartition(1).sortWithinPartitions(*sort) if sort else df.repartition(1)
    with replacing(df.sparkSession, path, overwrite) as at:
        parquet(df, row_group_rows).parquet(at)
    return path


def write_sorted(df: DataFrame, path: str, *keys: str, overwrite: bool = False, parts: int | None = None, row_group_rows: int | None = None) -> str:
    """Globally sorted Parquet: range-partitioned parts whose names are in order."""
    df = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    with replacing(df.sparkSession, path, overwrite) as at:
        parquet(df.sortWithinPartitions(*keys), row_group_rows).parquet(at)
    return path


def write_shards(df: DataFrame, path: str, shards: int, key: str, *, overwrite: bool = False, row_group_rows: int = ROW_GROUP_ROWS, prefix: str | None = None) -> str:
    """A fixed number of shards in one pass, by the key's hash (integers: by remainder), a task and a file each: folders shard=0 to shard=N-1.

    With ``prefix`` the files are ``<prefix>0000.parquet`` and so on in ``path`` itself, one for each shard, also for empty ones.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    number = F.pmod(F.col(key) if kind in ("bigint", "int") else F.xxhash64(key), F.lit(shards)).cast("int")
    out = df.withColumn("shard", number).repartitionById(shards, F.col("shard"))
    with replacing(spark, path, overwrite) as at:
        where = at if prefix is None else f"{at}/_shards"
        parquet(out, row_group_rows).partitionBy("shard").parquet(where)
        if prefix is None:
            return path
        parquet(spark.createDataFrame([], df.schema).coalesce(1)).parquet(f"{at}/_empty")
        empty = next(p for p in children(spark, f"{at}/_empty") if p.rsplit("/", 1)[-1].startswith("part-"))
        folders = {int(p.rsplit("=", 1)[1]): p for p in children(spark, where) if "/shard=" in p}
        for i in range(shards):
            named = f"{at}/{prefix}{i:04d}.parquet"
            if i in folders:
                (part,) = [p for p in children(spark, folders[i]) if p.rsplit("/", 1)[-1].startswith("part-")]
                rename(spark, part, named)
            else:
                copy(spark, empty, named)
        for folder in (where, f"{at}/_empty"):
            remove(spark, folder)
    return path


def write_table(df: DataFrame, name: str, *keys: str, overwrite: bool = False) -> str:
    """A managed table in key order."""
    df.orderBy(*keys).write.mode("overwrite" if overwrite else "errorifexists").saveAsTable(name)
    return name


def write_json_lines(df: DataFrame, path: str, *, overwrite: bool = False, compress: bool = False, parts: int = 1, name: str | None = None, keep_markers: bool = False) -> str:
    """NDJSON; a single part can be given a name."""
    spark, named = df.sparkSession, None
    writer = df.coalesce(parts).write
    with replacing(spark, path, overwrite) as at:
        (writer.option("compression", "gzip") if compress else writer).json(at)
        if name and parts == 1:
            named = single_part(spark, at, name, keep_markers).rsplit("/", 1)[-1]
    return f"{path}/{named}" if named else path


def write_csv(df: DataFrame, path: str, *, overwrite: bool = False) -> str:
    with replacing(df.sparkSession, path, overwrite) as at:
        df.coalesce(1).write.option("header", "true").csv(at)
    return path


def write_preview(df: DataFrame, path: str, rows: int = 10, *, overwrite: bool = False) -> str:
    with replacing(df.sparkSession, path, overwrite) as at:
        df.limit(rows).coalesce(1).write.parquet(at)
    return path


def run_folder(root: str, tag: str | None = None) -> str:
    """A versioned folder below ``root``."""
    return f"{root}/run={run_id(tag)}"
