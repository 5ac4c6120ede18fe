"""An extension: distinct pairs and counts kept up to date while signature batches arrive.

Each micro-batch adds the pairs that aren't known yet, and counts are taken from
the pairs; a batch that is run again after a failure adds nothing twice, since
its folder is written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sketchloom import schemas
from sketchloom.operators.counts import counts_from_pairs
from sketchloom.sources.files import children, exists


def known_pairs(spark: SparkSession, pairs: str, before: int | None = None) -> DataFrame | None:
    """Pairs of all batches, or of those before one."""
    folders = [p for p in children(spark, pairs) if p.rsplit("/", 1)[-1].startswith("batch=") and (before is None or int(p.rsplit("=", 1)[1]) < before)]
    return spark.read.schema("sample_id string, min_hash bigint").parquet(*folders) if folders else None


def follow_signatures(spark: SparkSession, source: str, pairs: str, checkpoint: str, *, ksize: int = schemas.KSIZE) -> StreamingQuery:
    """Add the new pairs of arriving files to ``pairs``; stops when all files that are there have been read."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.filter(batch.ksize == ksize).dropna(subset=["sample_id", "min_hash"]).select("sample_id", "min_hash").distinct()
        known = known_pairs(batch.sparkSession, pairs, number)
        if known is not None:
            rows = rows.join(known, ["sample_id", "min_hash"], "left_anti")
        rows.write.mode("overwrite").parquet(f"{pairs}/batch={number}")

    stream = spark.readStream.schema(schemas.SIGNATURES).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, pairs: str) -> tuple[DataFrame, DataFrame]:
    """Counts by hash and by sample of all pairs so far."""
    found = known_pairs(spark, pairs) if exists(spark, pairs) else None
    return counts_from_pairs(found if found is not None else spark.createDataFrame([], "sample_id string, min_hash bigint"))
