"""Counts of samples by hash and of hashes by sample, top lists, and hash-to-samples lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.hashing import modulo, remainder
from sketchloom.sources.files import materialised

#: Rows of a top list up to which tasks keep heaps of it; one task merges what all of these hold.
HEAP_ROWS = 10_000
#: Rows up to which selected keys are small enough to be sent to every task (16 MB).
BROADCAST_KEYS = 1_000_000
#: Pairs that a task makes distinct in memory, where their number is known.
TASK_ROWS = 500_000


def select_hashes(signatures: DataFrame, hashes: DataFrame, column: str = "min_hash") -> DataFrame:
    """Signature rows whose hash is in a set."""
    return signatures.join(hashes.select(F.col(column).alias("min_hash")), "min_hash", "left_semi")


def tasks_for(signatures: DataFrame) -> int:
    """How many tasks pairs of signatures are dealt to, so that none holds more of a larger table; their rows are counted, which costs next to nothing for a file that isn't filtered."""
    return max(signatures.sparkSession.sparkContext.defaultParallelism, -(-signatures.count() // TASK_ROWS))


def distinct_pairs(signatures: DataFrame, hashes: DataFrame | None = None, *, ksize: int | None = None, parts: int = 1024, tasks: int | None = None) -> DataFrame:
    """(sample_id, min_hash, part): each pair once; part is the truncating remainder of the hash.

    ``tasks``: the pairs are made distinct by so many tasks (see :func:`tasks_for`); else adaptive execution decides by
    shuffled bytes, of which 64 MB are about 1.4 GB in memory.
    """
    if ksize is not None:
        signatures = signatures.filter(F.col("ksize") == ksize)
    if hashes is not None:
        signatures = select_hashes(signatures, hashes)
    pairs = signatures.select("sample_id", "min_hash")
    if tasks:
        pairs = pairs.repartition(tasks, "sample_id", "min_hash")
    return pairs.distinct().withColumn("part", remainder(F.col("min_hash"), parts))


def hash_counts(signatures: DataFrame, hashes: DataFrame | None = None, *, ksize: int | None = None, tasks: int | None = None) -> DataFrame:
    """(min_hash, sample_count): in how many samples each hash occurs; ``tasks`` as in :func:`distinct_pairs`."""
    return distinct_pairs(signatures, hashes, ksize=ksize, tasks=tasks).groupBy("min_hash").agg(F.count("sample_id").alias("sample_count"))


def sample_counts(signatures: DataFrame, hashes: DataFrame | None = None, *, ksize: int | None = None) -> DataFrame:
    """(sample_id, matched_hash_count): how many of the hashes each sample has."""
    return distinct_pairs(signatures, hashes, ksize=ksize).groupBy("sample_id").agg(F.count("min_hash").alias("matched_hash_count"))


def counts_from_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both counts from materialised distinct pairs."""
    return pairs.groupBy("min_hash").agg(F.count("*").alias("sample_count")), pairs.groupBy("sample_id").agg(F.count("*").alias("matched_hash_count"))


def bucket_counts(signatures: DataFrame, buckets: int = 512) -> DataFrame:
    """(min_hash, n_samples, bucket) over distinct pairs."""
    pairs = signatures.select("min_hash", "sample_id").distinct()
    return pairs.groupBy("min_hash").agg(F.count("*").alias("n_samples")).withColumn("bucket", modulo(F.col("min_hash"), buckets))


def _smallest(hashes: DataFrame, k: int) -> int:
    """The k-th smallest of distinct hashes, 16 bits at a time: each round counts at most 65536 values."""
    plain = F.col("min_hash").bitwiseXOR(F.lit(-(1 << 63)))  # in order as an unsigned number
    prefix = 0
    for shift in (48, 32, 16, 0):
        part = F.shiftrightunsigned(plain, shift).bitwiseAND(F.lit(0xFFFF))
        rows = hashes if shift == 48 else hashes.filter(F.shiftrightunsigned(plain, shift + 16) == F.lit(prefix))
        for value, n in sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect()):
            if k <= n:
                break
            k -= n
        prefix = prefix << 16 | value
    return prefix - (1 << 63)


def top(counts: DataFrame, n: int = 100, *, heap: int = HEAP_ROWS) -> DataFrame:
    """The hashes in most samples, in order; of equal ones the smaller hash first. Hashes are distinct, as counts have them.

    Up to ``heap`` rows are kept in heaps. More are cut off where the n-th row is, which is found from the frequencies of
    the counts and, among ties, 16 bits of the hash at a time. The counts are made once for that, in the shared folder.
    What is left is sorted in ranges, so that no task holds it all.
    """
    rows = counts.select("min_hash", "n_samples")
    order = F.desc("n_samples"), F.asc("min_hash")
    if n <= heap:
        return rows.orderBy(*order).limit(n)
    rows, _ = materialised(rows, "counts")
    above = 0
    for value, size in sorted((tuple(r) for r in rows.groupBy("n_samples").count().collect()), reverse=True):
        if above + size > n:
            ties = rows.filter(F.col("n_samples") == value)
            last = F.lit(False) if above == n else F.col("min_hash") <= F.lit(_smallest(ties, n - above))
            rows = rows.filter((F.col("n_samples") > value) | (F.col("n_samples") == value) & last)
            break
        above += size
    return rows.orderBy(*order)


def sample_lists_of(signatures: DataFrame, selected: DataFrame, *, distinct: bool = True, n_keys: int | None = None) -> DataFrame:
    """(min_hash, n_samples, sample_ids, n_samples_exact) of selected hashes, in order of the counts.

    The keys are only broadcast if their number is known and small.
    """
    keys = selected.select("min_hash")
    if n_keys is not None and n_keys <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    rows = signatures.select("min_hash", "sample_id").join(keys, "min_hash")
    if distinct:
        rows = rows.distinct()
    lists = rows.groupBy("min_hash").agg(F.sort_array(F.collect_set("sample_id")).alias("sample_ids")).withColumn("n_samples_exact", F.size("sample_ids").cast("bigint"))
    return lists.join(selected, "min_hash", "left").select("min_hash", "n_samples", "sample_ids", "n_samples_exact").orderBy(F.desc("n_samples"), F.asc("min_hash"))


def sample_lists(signatures: DataFrame, selected: DataFrame, *, ksize: int | None = None, distinct: bool = True, sort: bool = True) -> DataFrame:
    """(min_hash, sample_count, sample_ids). ``distinct=False`` counts repeated pairs as often as they occur."""
    if ksize is not None:
        signatures = signatures.filter(F.col("ksize") == ksize)
    rows = select_hashes(signatures, selected).select("min_hash", "sample_id").filter("sample_id IS NOT NULL")
    if distinct:
        rows = rows.distinct()
    ids = F.collect_list("sample_id")
    return rows.groupBy("min_hash").agg(F.count("*").alias("sample_count"), (F.sort_array(ids) if sort else ids).alias("sample_ids"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def distinct_count(df: DataFrame, column: str = "hash") -> DataFrame:
    """Exact number of distinct hashes."""
    return df.agg(F.countDistinct(column).alias("n_distinct"))
