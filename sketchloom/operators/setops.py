"""Algebra of hash sets: union, difference, exclusion, and the three parts of a Venn diagram."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.hashing import bit_sample, low_bits, power_of_two


def union_distinct(sets: list[DataFrame], column: str = "hash") -> DataFrame:
    """Each hash of any of the sets once."""
    return reduce(lambda a, b: a.unionByName(b), [s.select(column) for s in sets]).distinct()


def sampled(df: DataFrame, fraction: float, buckets: int, column: str = "hash") -> DataFrame:
    """A sample by hash bits, the same on all sides."""
    return df if fraction >= 1 else df.filter(bit_sample(F.col(column), fraction, power_of_two(buckets).bit_length() - 1))


def difference(left: DataFrame, rights: list[DataFrame], *, distinct_left: bool = False, fraction: float = 1.0, buckets: int = 256, negatives: DataFrame | None = None) -> DataFrame:
    """(hash, bucket) of LEFT that no RIGHT has. Nulls of LEFT go; its repeats stay unless ``distinct_left``; no RIGHT at all gives LEFT.

    ``negatives``, if given, takes the place of RIGHTs: all their hashes once, sampled alike, as :mod:`sketchloom.operators.negatives` keeps them.
    """
    left = sampled(left.select("hash").filter("hash IS NOT NULL"), fraction, buckets)
    if distinct_left:
        left = left.distinct()
    if negatives is not None:
        left = left.join(negatives.select("hash"), "hash", "left_anti")
    elif rights:
        # an anti join needs no distinct right side, but a repeated hash would be shuffled as often as it occurs
        left = left.join(union_distinct([sampled(r, fraction, buckets) for r in rights]), "hash", "left_anti")
    return left.select("hash", low_bits(F.col("hash"), buckets).alias("bucket"))


def exclude(rows: DataFrame, hashes: DataFrame, column: str = "min_hash", hash_column: str = "hash") -> DataFrame:
    """Rows whose hash isn't in a set; null keys stay."""
    return rows.join(hashes.select(F.col(hash_column).alias(column)).filter(F.col(column).isNotNull()).distinct(), column, "left_anti").select(*rows.columns)


def venn(target: DataFrame, others: list[DataFrame], *, fraction: float = 1.0, buckets: int = 256) -> DataFrame:
    """One row: target_only, intersection, others_only, target_total, others_total and whether the parts add up.

    One union and one aggregation by hash, so each side is shuffled once. The
    target counts with its repeats, as its totals do; a target with repeats
    fails ``sanity_others``.
    """
    t = sampled(target.select("hash").filter("hash IS NOT NULL"), fraction, buckets).select("hash", F.lit(1).alias("t"), F.lit(0).alias("o"))
    if others:
        o = union_distinct([sampled(x.filter("hash IS NOT NULL"), fraction, buckets) for x in others]).select("hash", F.lit(0).alias("t"), F.lit(1).alias("o"))
        t = t.unionByName(o)
    parts = t.groupBy("hash").agg(F.sum("t").alias("t"), F.max("o").alias("o"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = parts.agg(
        total(F.when(F.col("o") == 0, F.col("t"))).alias("target_only"),
        total(F.when(F.col("o") == 1, F.col("t"))).alias("intersection"),
        total(F.when((F.col("o") == 1) & (F.col("t") == 0), 1)).alias("others_only"),
        total(F.col("t")).alias("target_total"),
        total(F.col("o")).alias("others_total"),
    )
    return out.withColumn("sanity_target", F.expr("target_total = target_only + intersection")).withColumn("sanity_others", F.expr("others_total = others_only + intersection"))


def is_subset(a: DataFrame, b: DataFrame, column: str = "hash") -> bool:
    return a.join(b, column, "left_anti").isEmpty()


def same_set(a: DataFrame, b: DataFrame, column: str = "hash") -> bool:
    """Whether two sets have the same hashes."""
    return is_subset(a, b, column) and is_subset(b, a, column)
