"""Indexes of hashes, in shards or in buckets, and membership probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.hashing import high_bits, low_bits
from sketchloom.schemas import SHARD_BITS
from sketchloom.sources import bucketed
from sketchloom.sources.files import guard, read_json, replacing, write_json

LOW_BITS, TOP_BITS = "low_bits", "top_bits"
#: Folders of one sorted file each, by bits of the hash; or a bucketed table, which joins read in place.
SHARDS, BUCKETS = "shards", "buckets"
VERSION = 1


def shard_column(h, bits: int, strategy: str = LOW_BITS):
    """Low bits spread sketch hashes evenly; top bits are what indexes without a strategy in their metadata have."""
    if strategy not in (LOW_BITS, TOP_BITS):
        raise ValueError(f"unknown shard strategy {strategy}")
    return low_bits(h, 1 << bits) if strategy == LOW_BITS else high_bits(h, bits)


def build_index(hashes: DataFrame, path: str, *, column: str = "min_hash", bits: int = SHARD_BITS, strategy: str = LOW_BITS, layout: str = SHARDS, distinct: bool = False, overwrite: bool = False, source: str = "", row_group_rows: int = bucketed.ROW_GROUP_ROWS) -> dict:
    """Write an index of 2^bits sorted shards or buckets, a file each. Returns what meta.json says.

    In shards repeats stay unless ``distinct``; in buckets each hash is kept once, with the number of its repeats.
    """
    spark = hashes.sparkSession
    if layout not in (SHARDS, BUCKETS):
        raise ValueError(f"unknown layout {layout}")
    guard(spark, path, overwrite)
    rows = hashes.select(F.col(column).cast("bigint").alias("min_hash")).filter("min_hash IS NOT NULL")
    meta = {"parquet_path": source, "shard_bits": bits, "shards": 1 << bits, "dtype": "int64", "version": VERSION, "layout": layout}
    with replacing(spark, path, overwrite) as at:
        if layout == BUCKETS:
            counted = rows.groupBy("min_hash").agg((F.lit(1) if distinct else F.count("*")).cast("bigint").alias("repeats"))
            bucketed.write_buckets(counted, f"{at}/table", "min_hash", 1 << bits, row_group_rows=row_group_rows)
            total = spark.read.parquet(f"{at}/table/buckets").agg(F.coalesce(F.sum("repeats"), F.lit(0))).first()[0]
            meta |= {"shard_strategy": "hash", "distinct": True}
        else:
            if distinct:
                rows = rows.distinct()
            # a shard is a partition: every task has one
            rows = rows.withColumn("shard", shard_column(F.col("min_hash"), bits, strategy)).repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("shard", "min_hash")
            bucketed.filtered(rows, "min_hash", row_group_rows).partitionBy("shard").parquet(f"{at}/shards")
            total = spark.read.schema("min_hash bigint, shard int").parquet(f"{at}/shards").count()
            meta |= {"shard_strategy": strategy, "distinct": distinct}
        meta["total_rows"] = total
        write_json(spark, f"{at}/meta.json", meta)
    return meta


class Index:
    """An index that was built; ``rows`` has its hashes (``min_hash``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.meta = read_json(spark, f"{path}/meta.json")
        self.bits = int(self.meta["shard_bits"])
        self.strategy = self.meta.get("shard_strategy", TOP_BITS)
        self.layout = self.meta.get("layout", SHARDS)
        self.distinct = bool(self.meta.get("distinct", False))
        self.rows = bucketed.open_buckets(spark, f"{path}/table") if self.layout == BUCKETS else spark.read.schema("min_hash bigint, shard int").parquet(f"{path}/shards")

    def probe(self, queries: DataFrame, column: str = "min_hash") -> DataFrame:
        """All query rows with ``hit``. The rows of a bucketed index stay where they are."""
        return probe(queries, self, column)

    def lookup(self, values: list[int]) -> DataFrame:
        """(min_hash, hit) of a few values: the scan skips shards by their bits, and row groups by what their Bloom filters and ends say."""
        asked = sorted(set(values))
        rows = self.rows
        if self.layout == SHARDS and asked:
            spark = rows.sparkSession
            numbers = spark.createDataFrame([(v,) for v in asked], "h bigint").select(shard_column(F.col("h"), self.bits, self.strategy)).distinct().collect()
            rows = rows.filter(F.col("shard").isin([r[0] for r in numbers]))
        found = bucketed.among(rows.select("min_hash"), "min_hash", asked).distinct().select(F.col("min_hash").alias("__k"))
        queries = rows.sparkSession.createDataFrame([(v,) for v in asked], "min_hash bigint")
        return queries.join(found, F.col("min_hash") == F.col("__k"), "left").select("min_hash", F.col("__k").isNotNull().alias("hit"))


def known_hashes(index: DataFrame | Index) -> DataFrame:
    """The hashes of an index, or of a DataFrame's first column, each once (``__k``)."""
    rows = index.rows if isinstance(index, Index) else index
    rows = rows.select(F.col(f"`{'min_hash' if isinstance(index, Index) else rows.columns[0]}`").alias("__k"))
    return rows if isinstance(index, Index) and index.distinct else rows.distinct()


def probe(queries: DataFrame, hashes: DataFrame | Index, column: str = "min_hash") -> DataFrame:
    """``queries`` with a boolean ``hit``: whether the hash is in the index; null hashes are not.

    One outer join, so that queries are computed once. Null hashes get a key of their own beside the real ones, a hash of
    the row, and so aren't sent to one task.
    """
    spare = F.xxhash64(*[F.col(f"`{c}`") for c in queries.columns if not dict(queries.dtypes)[c].startswith(("map", "variant"))])
    asked = F.col(f"`{column}`")
    keyed = queries.select(*[F.col(f"`{c}`") for c in queries.columns], F.coalesce(asked.cast("bigint"), spare).alias("__h"))
    rows = keyed.join(known_hashes(hashes), F.col("__h") == F.col("__k"), "left")
    return rows.select(*[F.col(f"`{c}`") for c in queries.columns], (asked.isNotNull() & F.col("__k").isNotNull()).alias("hit"))


def shard_statistics(hashes: DataFrame, *, column: str = "min_hash", bits: int = SHARD_BITS, strategy: str = LOW_BITS) -> DataFrame:
    """One row: total, mean over all shards, smallest non-empty and largest shard, and the five heaviest as shard:rows."""
    sizes = hashes.filter(F.col(column).isNotNull()).groupBy(shard_column(F.col(column), bits, strategy).alias("shard")).agg(F.count("*").alias("n"))
    heavy = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "shard"))), 1, 5)
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        (F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(1 << bits))).alias("mean_rows"),
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
        F.array_join(F.transform(heavy, lambda x: F.concat_ws(":", x["shard"], -x["n"])), ",").alias("heaviest"),
    )
