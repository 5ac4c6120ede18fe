"""Written intermediate tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.sources.files import remove, shared_dir


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet into the shared folder and read again; and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table by the file system of its path."""
    remove(spark, path)


def components(edges: DataFrame, most: int = 100) -> tuple[DataFrame, str]:
    """Connected components of ``edges`` (a, b) as a written table (a, b): each node but the smallest of its component, and that one.

    Alternating large and small stars: every round all nodes point to the
    smallest of their neighbours, so the rounds grow as the logarithm of the
    longest chain. Minima are pre-aggregated before each exchange; the joins are
    plain equi-joins, whose large partitions adaptive execution can split.
    Nothing but one count and one sum a round reaches the driver.
    """
    spark = edges.sparkSession
    now, path = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = state(now)
    for _ in range(most):
        if not was[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new, new_path = written(small, "edges")
        drop(spark, path)
        now, path = new, new_path
        if (state_now := state(now)) == was:
            return now, path
        was = state_now
    else:
        raise RuntimeError("components did not converge")
    return now, path
