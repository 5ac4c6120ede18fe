"""Registered queries of the engine on the provided tables, and the same as SQL.

``lineitem`` stands for signatures (order: sample, part: hash, line number:
k-size), filters of ``part`` and ``supplier`` for known hash sets, ``documents``
for contigs, and k-mers of ``benchmark`` for the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions import report
from sketchloom.functions.hashing import bit_sample, modulo
from sketchloom.functions.kmers import md5_hashes, md5_sketch
from sketchloom.operators import annotate, counts, histogram, index, selection, setops

SIG_SQL = "SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_partkey AS min_hash, l_linenumber AS ksize FROM lineitem"
TARGET_SQL = "SELECT p_partkey AS min_hash FROM part WHERE p_size <= 10"
RIGHT_SQL = "SELECT p_partkey AS hash FROM part WHERE p_size <= 10 UNION SELECT s_suppkey AS hash FROM supplier"
COUNT_SQL = f"SELECT min_hash, count(DISTINCT sample_id) AS sample_count FROM ({SIG_SQL}) GROUP BY min_hash"
K = 31
#: An odd factor that carries small keys over the bits of a hash.
SPREAD = 1_000_000_007_000_003


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_partkey").alias("min_hash"), F.col("l_linenumber").alias("ksize"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("min_hash"))


def left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hash"))


def rights(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [target(spark, sf_dir).select(F.col("min_hash").alias("hash")), _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hash"))]


def all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = signatures(spark, sf_dir)
    return counts.hash_counts(sig, tasks=counts.tasks_for(sig))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that no known set has, in 5 to 10000 samples, the most frequent first."""
    sig = signatures(spark, sf_dir)
    novel = setops.difference(left(spark, sf_dir), rights(spark, sf_dir), distinct_left=True).select(F.col("hash").alias("min_hash"))
    kept = selection.between(counts.hash_counts(sig, novel, tasks=counts.tasks_for(sig)), 5, 10000, "sample_count")
    return kept.orderBy(F.desc("sample_count"), F.asc("min_hash")).limit(100)


def scan_project_filter(spark, d):
    return signatures(spark, d).filter("ksize = 3").dropna(subset=["sample_id", "min_hash"])


def hash_sample_counts(spark, d):
    return counts.hash_counts(signatures(spark, d), target(spark, d))


def sample_hash_counts(spark, d):
    return counts.sample_counts(signatures(spark, d), target(spark, d))


def distinct_pairs(spark, d):
    return counts.distinct_pairs(signatures(spark, d), target(spark, d))


def pairs_hash_counts(spark, d):
    return counts.counts_from_pairs(distinct_pairs(spark, d))[0]


def pairs_sample_counts(spark, d):
    return counts.counts_from_pairs(distinct_pairs(spark, d))[1]


def left_minus_rights(spark, d):
    return setops.difference(left(spark, d), rights(spark, d))


def left_minus_rights_distinct(spark, d):
    return setops.difference(left(spark, d), rights(spark, d), distinct_left=True)


def spread(h: Column) -> Column:
    """A hash over all 64 bits, negative ones included, of which samples by bits keep about what they should.

    The product is cut to 64 bits, as a hash's is, and so stays one to one for keys of any size; checked 64-bit arithmetic,
    which its SQL has, ends at key 9223.
    """
    shifted = h.cast("decimal(19,0)") * F.lit(SPREAD).cast("decimal(16,0)") + F.lit(1 << 62).cast("decimal(19,0)")
    # 2^63 is in it already, so that the remainder, less 2^63, is the signed number
    return (F.pmod(shifted, F.lit(str(1 << 64)).cast("decimal(20,0)")) - F.lit(str(1 << 63)).cast("decimal(19,0)")).cast("bigint")


def left_minus_rights_sampled(spark, d):
    wide = lambda df: df.select(spread(F.col("hash")).alias("hash"))
    return setops.difference(wide(left(spark, d)), [wide(r) for r in rights(spark, d)], fraction=0.25, buckets=4)


def union_distinct(spark, d):
    return setops.union_distinct(rights(spark, d))


def _joined(lists: DataFrame) -> DataFrame:
    return lists.withColumn("sample_ids", F.array_join("sample_ids", ","))


def anti_exclude_lists(spark, d):
    lists = counts.sample_lists(signatures(spark, d), all_counts(spark, d), ksize=1)
    return _joined(setops.exclude(lists, rights(spark, d)[0]))


def venn_counts(spark, d):
    return setops.venn(rights(spark, d)[0], [left(spark, d), rights(spark, d)[1]])


def bit_sample_hashes(spark, d):
    return left(spark, d).select(spread(F.col("hash")).alias("hash")).filter(bit_sample(F.col("hash"), 0.3, 2))


def bucket_hash_counts(spark, d):
    return counts.bucket_counts(signatures(spark, d), 512)


def topn_hashes(spark, d):
    return counts.top(bucket_hash_counts(spark, d), 100)


def topn_sample_lists(spark, d):
    best = counts.top(bucket_hash_counts(spark, d), 20)
    return _joined(counts.sample_lists_of(signatures(spark, d), best, n_keys=20))


def quantile_cutpoints(spark, d):
    return selection.cutpoint_row(all_counts(spark, d), 0.75, 0.9, "sample_count")


def hashes_in_percentile(spark, d):
    return selection.between_percentiles(all_counts(spark, d), 0.75, 0.9, "sample_count")


def hashes_in_cutoff(spark, d):
    return selection.between(all_counts(spark, d), 25, 10000, "sample_count")


def samples_in_range(spark, d):
    return selection.between(counts.sample_counts(signatures(spark, d)), 2, 4, "matched_hash_count").select("sample_id")


def hash_sample_lists_sharded(spark, d):
    picked = selection.between(all_counts(spark, d), 25, 10000, "sample_count")
    lists = counts.sample_lists(signatures(spark, d), picked, ksize=2)
    return _joined(lists).withColumn("shard", modulo(F.col("min_hash"), 128))


def sample_pairs_flat(spark, d):
    picked = selection.between(all_counts(spark, d), 25, 30, "sample_count")
    return counts.distinct_pairs(signatures(spark, d), picked, ksize=2).select("min_hash", "sample_id")


def count_rows(spark, d):
    return counts.row_count(left_minus_rights(spark, d))


def count_distinct_hashes(spark, d):
    return counts.distinct_count(left_minus_rights(spark, d))


def histogram_counts(spark, d):
    return histogram.histogram(all_counts(spark, d), bins=20, max_value=40).select("bin", "n")


def histogram_stats(spark, d):
    stats = histogram.bin_statistics(all_counts(spark, d), bins=20, max_value=40)
    kinds = {"total": "bigint", "in_range": "bigint", "overflow": "bigint", "median_bin": "int", "modal_bin": "int"}
    shown = spark.createDataFrame([tuple(stats[k] for k in stats)], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in stats))
    # sums of products of doubles depend on their order
    return shown.select(*[F.round(c, 9).alias(c) if kinds.get(c) is None else F.col(c) for c in shown.columns])


def topn_sample_lists_repeated(spark, d):
    """Lists of the top hashes from pairs that occur several times, without making them distinct first."""
    sig = signatures(spark, d)
    best = counts.top(bucket_hash_counts(spark, d), 20)
    return _joined(counts.sample_lists_of(sig.unionByName(sig), best, distinct=False, n_keys=20))


def shown_figures(spark, d):
    """Sizes of the known sets' buckets in words: rows, bytes at a thousand a row, and seconds at a second a row."""
    n = left(spark, d).groupBy(modulo(F.col("hash"), 16).alias("bucket")).agg(F.count("*").alias("n"))
    some = n.select("bucket", F.explode(F.array(F.lit(1), F.lit(7), F.lit(1000))).alias("times"), "n").withColumn("n", F.col("n") * F.col("times"))
    return some.select("bucket", "times", report.number_column(F.col("n")).alias("rows"), report.size_column(F.col("n") * 1024).alias("bytes"), report.duration_column(F.col("n").cast("double")).alias("time"))


def bucket_sorted_table(spark, d):
    rows = left(spark, d).distinct().select("hash", modulo(F.col("hash"), 16).alias("bucket"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "hash")


def index_shard_stats(spark, d):
    return index.shard_statistics(left(spark, d), column="hash", bits=4)


def index_probe(spark, d):
    return index.probe(left(spark, d).distinct().select(F.col("hash").alias("min_hash")), target(spark, d))


def kmer_sketch(spark, d):
    return md5_sketch(_table(spark, d, "documents"), "doc_id", "text", K)


def contig_annotation(spark, d):
    docs = _table(spark, d, "documents").select(F.lit("all").alias("accession"), F.col("doc_id").cast("string").alias("contig"), F.length("text").alias("contig_length"), md5_hashes(F.col("text"), K).alias("hashes"))
    known = md5_sketch(_table(spark, d, "benchmark"), "item_id", "text", K).select("hash")
    return annotate.annotate_sketched(docs, known)


def dna(text: Column) -> Column:
    """A sequence of a text's letters."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")


def murmur_kmers(spark, d):
    """K-mers of texts, with the letters that aren't DNA taken as A, C, G or T by their code, so that the native hash has work."""
    contigs = _table(spark, d, "documents").select(F.lit("all").alias("accession"), F.col("doc_id").cast("string").alias("contig"), dna(F.col("text")).alias("sequence"))
    return annotate.contig_hashes(contigs)


def queries() -> dict:
    names = [
        flagship, scan_project_filter, hash_sample_counts, sample_hash_counts, distinct_pairs, pairs_hash_counts, pairs_sample_counts, left_minus_rights, left_minus_rights_distinct, left_minus_rights_sampled, union_distinct,
        anti_exclude_lists, venn_counts, bit_sample_hashes, bucket_hash_counts, topn_hashes, topn_sample_lists, quantile_cutpoints, hashes_in_percentile, hashes_in_cutoff, samples_in_range, hash_sample_lists_sharded,
        sample_pairs_flat, count_rows, count_distinct_hashes, histogram_counts, histogram_stats, topn_sample_lists_repeated, shown_figures, bucket_sorted_table, index_shard_stats, index_probe, kmer_sketch, contig_annotation, murmur_kmers,
    ]
    return {f.__name__: f for f in names}


def _md5(table: str, key: str) -> str:
    return (
        f"SELECT {key} AS id, h FROM (SELECT {key}, CAST('0x' || substr(md5(kmer), 1, 15) AS BIGINT) AS h FROM (SELECT {key}, substr(text, i, {K}) AS kmer "
        f"FROM (SELECT {key}, text, unnest(range(1, length(text) - {K - 2})) AS i FROM {table} WHERE length(text) >= {K}))) WHERE h < {(1 << 60) // 100}"
    )


#: ``spread`` as SQL.
WIDE = f"(CAST(%s AS BIGINT) * {SPREAD} - {1 << 62})"


def oracle_sql() -> dict[str, str]:
    sig, lists = SIG_SQL, "count(*) AS sample_count, array_to_string(list_sort(list(sample_id)), ',') AS sample_ids"
    diff = f"SELECT l_partkey AS hash, CAST(l_partkey & 255 AS INTEGER) AS bucket FROM lineitem LEFT JOIN (SELECT hash AS known FROM ({RIGHT_SQL})) ON l_partkey = known WHERE known IS NULL AND l_partkey IS NOT NULL"
    threshold = round(0.3 * (1 << 20))
    quarter = round(0.25 * (1 << 20))
    low, high = f"(SELECT quantile_cont(sample_count, 0.75) FROM ({COUNT_SQL}))", f"(SELECT quantile_cont(sample_count, 0.9) FROM ({COUNT_SQL}))"
    edges = f"SELECT min(sample_count) AS lo, least(max(sample_count), 40) AS hi FROM ({COUNT_SQL})"
    binned = f"SELECT CASE WHEN sample_count >= 40 THEN -1 WHEN lo = hi THEN 19 ELSE CAST(least(19, floor((sample_count - lo) * 20.0 / (hi - lo))) AS INTEGER) END AS bin FROM ({COUNT_SQL}), ({edges})"
    bars = f"SELECT CAST(b.bin AS INTEGER) AS bin, count(x.bin) AS n FROM (SELECT unnest(range(-1, 20)) AS bin) b LEFT JOIN ({binned}) x ON b.bin = x.bin GROUP BY b.bin"
    top = f"SELECT min_hash, count(DISTINCT sample_id) AS n_samples FROM ({sig}) GROUP BY min_hash ORDER BY n_samples DESC, min_hash"
    t, o = "SELECT p_partkey AS hash FROM part WHERE p_size <= 10", "SELECT l_partkey AS hash FROM lineitem UNION SELECT s_suppkey AS hash FROM supplier"
    return {
        "flagship": f"SELECT min_hash, count(DISTINCT sample_id) AS sample_count FROM ({sig}) WHERE min_hash NOT IN (SELECT hash FROM ({RIGHT_SQL})) GROUP BY min_hash HAVING count(DISTINCT sample_id) BETWEEN 5 AND 10000 ORDER BY sample_count DESC, min_hash LIMIT 100",
        "scan_project_filter": f"SELECT * FROM ({sig}) WHERE ksize = 3 AND sample_id IS NOT NULL AND min_hash IS NOT NULL",
        "hash_sample_counts": f"SELECT min_hash, count(DISTINCT sample_id) AS sample_count FROM ({sig}) JOIN ({TARGET_SQL}) USING (min_hash) GROUP BY min_hash",
        "sample_hash_counts": f"SELECT sample_id, count(DISTINCT min_hash) AS matched_hash_count FROM ({sig}) JOIN ({TARGET_SQL}) USING (min_hash) GROUP BY sample_id",
        "distinct_pairs": f"SELECT DISTINCT sample_id, min_hash, CAST(min_hash % 1024 AS INTEGER) AS part FROM ({sig}) JOIN ({TARGET_SQL}) USING (min_hash)",
        "pairs_hash_counts": f"SELECT min_hash, count(*) AS sample_count FROM (SELECT DISTINCT sample_id, min_hash FROM ({sig}) JOIN ({TARGET_SQL}) USING (min_hash)) GROUP BY min_hash",
        "pairs_sample_counts": f"SELECT sample_id, count(*) AS matched_hash_count FROM (SELECT DISTINCT sample_id, min_hash FROM ({sig}) JOIN ({TARGET_SQL}) USING (min_hash)) GROUP BY sample_id",
        "left_minus_rights": diff,
        "left_minus_rights_distinct": f"SELECT DISTINCT hash, bucket FROM ({diff})",
        "left_minus_rights_sampled": f"SELECT hash, CAST(hash & 3 AS INTEGER) AS bucket FROM (SELECT {WIDE % 'hash'} AS hash FROM ({diff})) WHERE ((hash >> 2) & 1048575) < {quarter}",
        "union_distinct": RIGHT_SQL,
        "anti_exclude_lists": f"SELECT min_hash, {lists} FROM (SELECT DISTINCT min_hash, sample_id FROM ({sig}) WHERE ksize = 1) ANTI JOIN ({t}) r ON min_hash = r.hash GROUP BY min_hash",
        "venn_counts": f"SELECT only_t AS target_only, both_ AS intersection, only_o AS others_only, nt AS target_total, no_ AS others_total, nt = only_t + both_ AS sanity_target, no_ = only_o + both_ AS sanity_others FROM (SELECT (SELECT count(*) FROM ({t}) a ANTI JOIN ({o}) b ON a.hash = b.hash) AS only_t, (SELECT count(*) FROM ({t}) a JOIN ({o}) b ON a.hash = b.hash) AS both_, (SELECT count(*) FROM ({o}) a ANTI JOIN ({t}) b ON a.hash = b.hash) AS only_o, (SELECT count(*) FROM ({t})) AS nt, (SELECT count(*) FROM ({o})) AS no_)",
        "bit_sample_hashes": f"SELECT hash FROM (SELECT {WIDE % 'l_partkey'} AS hash FROM lineitem) WHERE ((hash >> 2) & 1048575) < {threshold}",
        "bucket_hash_counts": f"SELECT min_hash, count(DISTINCT sample_id) AS n_samples, CAST(min_hash % 512 AS INTEGER) AS bucket FROM ({sig}) GROUP BY min_hash",
        "topn_hashes": f"{top} LIMIT 100",
        "topn_sample_lists": f"SELECT min_hash, any_value(n_samples) AS n_samples, array_to_string(list_sort(list(DISTINCT sample_id)), ',') AS sample_ids, count(DISTINCT sample_id) AS n_samples_exact FROM ({top} LIMIT 20) JOIN ({sig}) USING (min_hash) GROUP BY min_hash",
        "quantile_cutpoints": f"SELECT {low} AS low_cut, {high} AS high_cut",
        "hashes_in_percentile": f"SELECT min_hash, sample_count FROM ({COUNT_SQL}) WHERE sample_count BETWEEN {low} AND {high}",
        "hashes_in_cutoff": f"SELECT min_hash, sample_count FROM ({COUNT_SQL}) WHERE sample_count BETWEEN 25 AND 10000",
        "samples_in_range": f"SELECT sample_id FROM ({sig}) GROUP BY sample_id HAVING count(DISTINCT min_hash) BETWEEN 2 AND 4",
        "hash_sample_lists_sharded": f"SELECT min_hash, {lists}, CAST(min_hash % 128 AS INTEGER) AS shard FROM (SELECT DISTINCT min_hash, sample_id FROM ({sig}) WHERE ksize = 2 AND min_hash IN (SELECT min_hash FROM ({COUNT_SQL}) WHERE sample_count BETWEEN 25 AND 10000)) GROUP BY min_hash",
        "sample_pairs_flat": f"SELECT DISTINCT min_hash, sample_id FROM ({sig}) WHERE ksize = 2 AND min_hash IN (SELECT min_hash FROM ({COUNT_SQL}) WHERE sample_count BETWEEN 25 AND 30)",
        "count_rows": f"SELECT count(*) AS n_rows FROM ({diff})",
        "count_distinct_hashes": f"SELECT count(DISTINCT hash) AS n_distinct FROM ({diff})",
        "histogram_counts": bars,
        "histogram_stats": f"WITH bars AS ({bars}), e AS ({edges}), acc AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS so_far, lo + (bin + 0.5) * (hi - lo) / 20.0 AS middle FROM bars, e WHERE bin >= 0), t AS (SELECT CAST((SELECT sum(n) FROM bars) AS BIGINT) AS total, CAST((SELECT sum(n) FROM acc) AS BIGINT) AS in_range, CAST((SELECT n FROM bars WHERE bin = -1) AS BIGINT) AS overflow, CAST(least(19, (SELECT count(*) FROM acc WHERE so_far < (SELECT sum(n) FROM bars) / 2.0)) AS INTEGER) AS median_bin, (SELECT bin FROM acc ORDER BY n DESC, bin LIMIT 1) AS modal_bin, CAST((SELECT sum(n * middle) FROM acc) AS DOUBLE) AS weighted) SELECT total, in_range, overflow, round(CAST(in_range AS DOUBLE) / total, 9) AS in_range_share, round(CAST(overflow AS DOUBLE) / total, 9) AS overflow_share, (SELECT CAST(lo AS DOUBLE) FROM e) AS min_edge, (SELECT CAST(hi AS DOUBLE) FROM e) AS max_edge, round(weighted / in_range, 9) AS approx_mean, round(weighted / total, 9) AS approx_mean_ref, median_bin, modal_bin FROM t",
        "topn_sample_lists_repeated": f"SELECT min_hash, any_value(n_samples) AS n_samples, array_to_string(list_sort(list(DISTINCT sample_id)), ',') AS sample_ids, count(DISTINCT sample_id) AS n_samples_exact FROM ({top} LIMIT 20) JOIN ({sig}) USING (min_hash) GROUP BY min_hash",
        "shown_figures": "WITH s AS (SELECT bucket, CAST(times AS INTEGER) AS times, n * times AS n FROM (SELECT CAST(l_partkey % 16 AS INTEGER) AS bucket, count(*) AS n FROM lineitem GROUP BY 1), (VALUES (1), (7), (1000)) AS v(times)) SELECT bucket, times, format('{:,}', n) AS rows, CASE WHEN n < 1024 THEN printf('%.1f KiB', CAST(n AS DOUBLE)) WHEN n < 1048576 THEN printf('%.1f MiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f GiB', n / 1048576.0) ELSE printf('%.1f TiB', n / 1073741824.0) END AS bytes, CASE WHEN n < 60 THEN printf('%.1f s', CAST(n AS DOUBLE)) WHEN n < 3600 THEN printf('%d min %d s', n // 60, n % 60) ELSE printf('%d h %d min %d s', n // 3600, n % 3600 // 60, n % 60) END AS time FROM s",
        "bucket_sorted_table": "SELECT DISTINCT l_partkey AS hash, CAST(l_partkey % 16 AS INTEGER) AS bucket FROM lineitem",
        "index_shard_stats": "WITH s AS (SELECT l_partkey & 15 AS shard, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total_rows, sum(n) / 16.0 AS mean_rows, min(n) AS min_rows, max(n) AS max_rows, (SELECT string_agg(shard || ':' || n, ',' ORDER BY n DESC, shard) FROM (SELECT * FROM s ORDER BY n DESC, shard LIMIT 5)) AS heaviest FROM s",
        "index_probe": f"SELECT DISTINCT l_partkey AS min_hash, l_partkey IN ({TARGET_SQL}) AS hit FROM lineitem",
        "kmer_sketch": f"SELECT id AS doc_id, h AS hash FROM ({_md5('documents', 'doc_id')})",
        "contig_annotation": f"WITH k AS ({_md5('documents', 'doc_id')}), b AS (SELECT DISTINCT h AS known FROM ({_md5('benchmark', 'item_id')})), c AS (SELECT id, count(*) AS cand, count(known) AS hits FROM k LEFT JOIN b ON h = known GROUP BY id) SELECT 'all' AS accession, CAST(doc_id AS VARCHAR) AS contig, CAST(length(text) AS INTEGER) AS contig_length, coalesce(cand, 0) AS candidate_hashes, coalesce(hits, 0) AS novel_hashes, CASE WHEN coalesce(cand, 0) > 0 THEN hits / cand ELSE 0.0 END AS frac_novel FROM documents LEFT JOIN c ON doc_id = id",
    }
