"""Registered queries of sources, sinks and whole jobs: each writes to the shared folder, reads that back and returns what it read."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.functions.hashing import high_bits
from sketchloom.operators import annotate, counts, selection, setops
from sketchloom.operators.index import BUCKETS, SHARDS, TOP_BITS, Index, build_index, shard_statistics
from sketchloom.plans import jobs, proxies
from sketchloom.schemas import CONTIG_COUNTS, MAX_HASH
from sketchloom.sources import contigs, sinks, streams
from sketchloom.sources.datasets import footer_statistics, read_hive_hashes, read_plain, read_signatures, row_groups
from sketchloom.sources.files import shared_dir, write_bytes, write_json
from sketchloom.sources.manifest import load_manifest, register
from sketchloom.streaming.increments import current_counts, follow_signatures

K = proxies.K


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


def hive_dataset(spark, d):
    """A difference written by bucket and read as a Hive-partitioned dataset."""
    return read_hive_hashes(spark, sinks.write_partitioned(proxies.left_minus_rights(spark, d), _folder(spark), "bucket", sort=["hash"]))


def sorted_single_file(spark, d):
    """Hashes and their places in one sorted file."""
    path = sinks.write_single(proxies.union_distinct(spark, d), _folder(spark), sort=["hash"], row_group_rows=1000)
    return spark.read.parquet(path).coalesce(1).select("hash", F.monotonically_increasing_id().alias("place"))


def sorted_parts(spark, d):
    """Rows of globally sorted parts, and how many of these begin before the one before them ends."""
    path = sinks.write_sorted(proxies.left(spark, d), _folder(spark), "hash", parts=8)
    ends = read_plain(spark, path).groupBy(F.input_file_name().alias("file")).agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.count("*").alias("n"))
    # a part for each file: a handful of rows
    return ends.agg(F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(F.struct("file", "low", "high"))).alias("parts")).select("n_rows", F.size(F.filter(F.transform("parts", lambda p, i: (i > 0) & (p["low"] < F.get(F.col("parts"), i - 1)["high"])), lambda x: x)).cast("bigint").alias("n_overlaps"))


def shard_files(spark, d):
    """Lists in 128 files with a prefix and a number, the number read from the file's name."""
    lists = proxies.hash_sample_lists_sharded(spark, d).drop("shard")
    path = sinks.write_shards(lists, _folder(spark), 128, "min_hash", prefix="lists_")
    return read_plain(spark, f"{path}/lists_*.parquet").withColumn("shard", F.regexp_extract(F.input_file_name(), r"lists_(\d+)", 1).cast("int"))


def sample_shards(spark, d):
    """Pairs sharded by sample, with the number of shards that each sample is in."""
    path = sinks.write_shards(proxies.sample_pairs_flat(spark, d), _folder(spark), 16, "sample_id")
    rows = spark.read.parquet(path)
    return rows.groupBy("sample_id").agg(F.count("*").alias("n_pairs"), F.countDistinct("shard").alias("n_shards"))


def pair_parts(spark, d):
    """Distinct pairs written in parts and read with their part."""
    return spark.read.parquet(sinks.write_partitioned(proxies.distinct_pairs(spark, d), _folder(spark), "part")).select("sample_id", "min_hash", "part")


def _manifest(spark, d) -> dict:
    at = _folder(spark)
    sig = proxies.signatures(spark, d).select(F.col("min_hash").alias("h`x"), "ksize")
    sig.write.parquet(f"{at}/query")
    proxies.target(spark, d).select("min_hash", F.lit(31).alias("k")).union(spark.createDataFrame([(1, 21), (2, 21)], "min_hash bigint, k int")).write.parquet(f"{at}/known/main/parts")
    proxies.rights(spark, d)[1].write.parquet(f"{at}/more")
    entries = [("query", f"{at}/query", "sig.hashes", "h`x", "left", "ksize"), ("parts", f"{at}/known", "db.main.parts", "min_hash", "right", "k"), ("suppliers", f"{at}/more", "hashes", "hash", "right", None)]
    return {"databases": [dict(zip(("alias", "path", "table", "column", "set_id", "ksize"), e)) for e in entries]}


def manifest_difference(spark, d):
    """The difference by a manifest file; the left side isn't filtered by k-size."""
    at = _folder(spark)
    write_json(spark, f"{at}/manifest.json", _manifest(spark, d))
    return spark.read.parquet(jobs.left_minus_rights(spark, f"{at}/manifest.json", f"{at}/out")).select("hash", "bucket")


def manifest_views(spark, d):
    """Rows of the views that stand for the manifest's sets."""
    sets = load_manifest(spark, _manifest(spark, d))
    register(spark, sets)
    return spark.sql(" UNION ALL ".join(f"SELECT '{s.alias}' AS alias, count(*) AS n_rows FROM {s.alias}" for s in sets))


def venn_csv(spark, d):
    """One named set against the others, as the job's CSV has it."""
    at = _folder(spark)
    jobs.alias_vs_others(spark, _manifest(spark, d), "parts", out=at)
    return spark.read.option("header", "true").csv(at, schema="target_only bigint, intersection bigint, others_only bigint, target_total bigint, others_total bigint, sanity_target boolean, sanity_others boolean")


def _signature_files(spark, d) -> str:
    path = _folder(spark)
    proxies.signatures(spark, d).write.partitionBy("ksize").parquet(path)
    return path


def limited_scan(spark, d):
    """The first files by name, with their partition column."""
    at = _folder(spark)
    proxies.signatures(spark, d).repartition("ksize").write.partitionBy("ksize").parquet(at)
    return read_signatures(spark, at, file_limit=2)


def bernoulli_sample(spark, d):
    """Of a sample without replacement: rows that are in no table, and whether its size is near the fraction's."""
    at = _signature_files(spark, d)
    sample, whole = read_signatures(spark, at, sample_fraction=0.25), read_signatures(spark, at)
    strangers = sample.join(whole, ["sample_id", "min_hash"], "left_anti").agg(F.count("*").alias("strangers"))
    n = whole.agg(F.count("*").alias("n"))
    return strangers.select("strangers", (F.abs(sample.agg(F.count("*").alias("m")).scalar() / n.scalar() - 0.25) < 0.02).alias("near"))


def _top(spark, d) -> dict[str, str]:
    return jobs.top_minhashes(spark, _signature_files(spark, d), _folder(spark), n=50, buckets=16, ksize=3, compress=True, tag="first")


def topn_json(spark, d):
    """The top list as compressed JSON lines of a run's folder."""
    return spark.read.schema("min_hash bigint, n_samples bigint").json(_top(spark, d)["topn_json"])


def topn_ids_json(spark, d):
    """The top list's samples as JSON lines, by a later stage that looks up the latest run."""
    at, source = _folder(spark), _signature_files(spark, d)
    for tag in ("a", "b"):
        jobs.top_minhashes(spark, source, at, stages=("counts", "topn"), n=10 if tag == "a" else 20, buckets=16, tag=tag, overwrite=True)
    made = jobs.top_minhashes(spark, source, at, stages=("ids",), n=20, buckets=16, json_parts=2)
    return spark.read.schema("min_hash bigint, n_samples bigint, sample_ids array<string>").json(made["ids"]).withColumn("sample_ids", F.array_join("sample_ids", ","))


def top_in_ranges(spark, d):
    """The top list beyond what heaps hold."""
    return counts.top(proxies.bucket_hash_counts(spark, d), 333, heap=0)


def percentile_job(spark, d):
    """Lists between percentiles by the whole job, with the cutpoints that its sidecar has."""
    at = _folder(spark)
    proxies.hash_sample_counts(spark, d).write.parquet(f"{at}/hash_counts.parquet")
    jobs.percentiles(spark, "hash", at, percentiles=(0.5, 0.9), signatures=_signature_files(spark, d), map_out=f"{at}/lists", ksize=2, shards=8, prefix="part_")
    cuts = spark.read.json(f"{at}/hash_percentiles.json", multiLine=True).select("low_cut", "high_cut")
    return read_plain(spark, f"{at}/lists").withColumn("sample_ids", F.array_join("sample_ids", ",")).withColumns({c: cuts.select(c).scalar() for c in cuts.columns})


def sample_list(spark, d):
    """Samples in a range of counts, by the whole job."""
    at = _folder(spark)
    jobs.compute_counts(spark, _prepared(spark, d), _signature_files(spark, d), 2, at)
    jobs.percentiles(spark, "sample", at, cuts=(2, 4), sample_list_out=f"{at}/samples")
    return spark.read.parquet(f"{at}/samples")


def _prepared(spark, d) -> str:
    at = _folder(spark)
    proxies.target(spark, d).select(F.col("min_hash").alias("hash"), F.pmod("min_hash", F.lit(4)).alias("bucket")).write.partitionBy("bucket").parquet(f"{at}/hive")
    return jobs.prepare_hashes(spark, f"{at}/hive", f"{at}/hashes", deduplicate=True, preview=f"{at}/preview")


def remove_set_job(spark, d):
    """List shards without the hashes of one more set, by the whole job."""
    at = _folder(spark)
    sinks.write_shards(proxies.hash_sample_lists_sharded(spark, d).drop("shard"), f"{at}/lists", 8, "min_hash")
    proxies.rights(spark, d)[0].withColumn("ksize", F.lit(31)).write.parquet(f"{at}/set/unique_hashes")
    jobs.remove_set(spark, f"{at}/lists", f"{at}/set", f"{at}/out")
    return spark.read.parquet(f"{at}/out").select("min_hash", "sample_count", "sample_ids")


def histogram_csv(spark, d):
    """The bins as the job's CSV has them."""
    at = _folder(spark)
    proxies.all_counts(spark, d).write.parquet(f"{at}/counts")
    jobs.histogram_job(spark, f"{at}/counts", f"{at}/out", bins=20, max_value=40)
    return spark.read.option("header", "true").csv(f"{at}/out/bins", schema="bin int, low_edge double, high_edge double, n bigint").select("bin", "n")


def histogram_picture(spark, d):
    """The bars of the job's two pictures, as their titles say: bins and what overflows."""
    at = _folder(spark)
    proxies.all_counts(spark, d).write.parquet(f"{at}/counts")
    jobs.histogram_job(spark, f"{at}/counts", f"{at}/out", bins=20, max_value=40, picture=f"{at}/bars")
    found = [spark.read.text(f"{at}/{name}.svg").select(F.lit(name).alias("picture"), F.regexp_extract("value", r'fill="(\w+)"><title>(>=)? ?(\d+)[^:]*: (\d+)', 4).alias("n"), F.regexp_extract("value", r'fill="(\w+)"><title>', 1).alias("color")) for name in ("bars", "bars_log")]
    return found[0].union(found[1]).filter("n <> ''").groupBy("picture", "color").agg(F.count("*").alias("n_bars"), F.sum(F.col("n").cast("bigint")).alias("n_values"))


def sorted_table(spark, d):
    """A managed table in key order."""
    name = f"sorted_{uuid.uuid4().hex}"
    sinks.write_table(proxies.left_minus_rights_distinct(spark, d), name, "hash")
    return spark.table(name)


def preview(spark, d):
    """Rows of a preview, and those of them that the table doesn't have."""
    at, rows = _folder(spark), proxies.union_distinct(spark, d)
    seen = spark.read.parquet(sinks.write_preview(rows, at))
    return seen.agg(F.count("*").alias("n_rows")).withColumn("strangers", seen.join(rows, "hash", "left_anti").agg(F.count("*")).scalar())


def set_comparisons(spark, d):
    """Whether the one set is part of the other, and whether a set is the same as itself with repeats."""
    a, b = proxies.rights(spark, d)
    whole = setops.union_distinct([a, b])
    return spark.createDataFrame([(setops.is_subset(a, whole), setops.is_subset(whole, a), setops.same_set(whole, a.unionByName(b)))], "part boolean, whole boolean, same boolean")


def index_built_probe(spark, d):
    """An index that was written, asked for all hashes."""
    path = _folder(spark)
    build_index(proxies.target(spark, d).union(proxies.target(spark, d)), path, bits=4, distinct=True)
    return Index(spark, path).probe(proxies.left(spark, d).distinct().select(F.col("hash").alias("min_hash")))


def index_bucketed_probe(spark, d):
    """An index in buckets, which stays where it is, asked for all hashes and some that are null."""
    path = _folder(spark)
    build_index(proxies.target(spark, d).union(proxies.target(spark, d)), path, bits=3, layout=BUCKETS)
    asked = proxies.left(spark, d).distinct().select(F.col("hash").alias("min_hash")).union(spark.createDataFrame([(None,), (None,)], "min_hash bigint"))
    return Index(spark, path).probe(asked)


def index_lookup(spark, d):
    """A few hashes, those of the nations' keys, looked up by the scan's filters in both layouts."""
    asked = [r[0] for r in proxies._table(spark, d, "nation").select("n_nationkey").collect()]  # a fixed number of rows at every size
    found = []
    for layout in (SHARDS, BUCKETS):
        path = _folder(spark)
        build_index(proxies.target(spark, d), path, bits=3, layout=layout, row_group_rows=50)
        found.append(Index(spark, path).lookup(asked).select(F.lit(layout).alias("layout"), "min_hash", "hit"))
    return found[0].union(found[1])


def difference_reused(spark, d):
    """A second difference with the negative set that the first one has kept."""
    at = _folder(spark)
    manifest = _manifest(spark, d)
    jobs.left_minus_rights(spark, manifest, f"{at}/first", negatives=f"{at}/negatives", buckets=16)
    return spark.read.parquet(jobs.left_minus_rights(spark, manifest, f"{at}/second", negatives=f"{at}/negatives", skip_build=True, distinct_left=True, buckets=16)).select("hash", "bucket")


def catalog_difference(spark, d):
    """A difference between a view, and tables of databases of the catalog by their names."""
    mark = uuid.uuid4().hex
    proxies.signatures(spark, d).createOrReplaceTempView(f"signatures_{mark}")
    spark.sql(f"CREATE DATABASE known_{mark}")
    proxies.target(spark, d).write.saveAsTable(f"known_{mark}.parts")
    proxies.rights(spark, d)[1].write.saveAsTable(f"known_{mark}.suppliers")
    entries = [("query", "catalog", f"signatures_{mark}", "min_hash", "left"), ("parts", "catalog", f"spark_catalog.known_{mark}.parts", "min_hash", "right"), ("suppliers", f"catalog:known_{mark}", "suppliers", "hash", "right")]
    manifest = {"databases": [dict(zip(("alias", "path", "table", "column", "set_id"), e)) for e in entries]}
    return spark.read.parquet(jobs.left_minus_rights(spark, manifest, _folder(spark), buckets=256)).select("hash", "bucket")


def footer_counts(spark, d):
    """Rows and ends of a dataset by its footers alone."""
    return footer_statistics(spark, sinks.write_partitioned(proxies.left_minus_rights(spark, d), _folder(spark), "bucket", values=256), "hash")


def row_group_sizes(spark, d):
    """Rows of each row group of shards with 100 rows a row group."""
    path = sinks.write_shards(proxies.distinct_pairs(spark, d).select("min_hash", "sample_id"), _folder(spark), 16, "min_hash", row_group_rows=100)
    return row_groups(spark, path).select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("int").alias("shard"), "row_group", "n_rows")


def split_buckets(spark, d):
    """A difference in four files a bucket, with the number of files of each."""
    path = sinks.write_partitioned(proxies.left_minus_rights(spark, d).withColumn("bucket", F.col("hash").bitwiseAND(F.lit(3)).cast("int")), _folder(spark), "bucket", values=4, files=4, spread=F.xxhash64("hash"))
    rows = spark.read.parquet(path)
    return rows.groupBy("bucket").agg(F.count("*").alias("n_rows"), (F.countDistinct("_metadata.file_path") > 1).alias("several"))


def replaced_output(spark, d):
    """What stands at an output's place after a job that replaces it has failed, and after one that hasn't."""
    at = _folder(spark)
    rows = proxies.target(spark, d)
    sinks.write_plain(rows, at)
    broken = rows.withColumn("min_hash", F.when(F.col("min_hash") > 0, F.raise_error(F.lit("broken on purpose")).cast("bigint")))
    try:
        sinks.write_plain(broken, at, overwrite=True)
    except PySparkException:
        kept = spark.read.parquet(at).agg(F.count("*").alias("n"), F.sum("min_hash").alias("total")).select(F.lit("failed").alias("after"), "n", "total").collect()  # one row
    # an output can be made from the one that it replaces
    sinks.write_plain(spark.read.parquet(at).select(F.col("min_hash") + 1), at, overwrite=True)
    new = spark.read.parquet(at).toDF("min_hash").agg(F.count("*").alias("n"), F.sum("min_hash").alias("total")).select(F.lit("replaced").alias("after"), "n", "total")
    return spark.createDataFrame(kept, new.schema).union(new)


def index_top_bits_probe(spark, d):
    """As old indexes have it: shards by the top bits, and no strategy in the metadata."""
    path = _folder(spark)
    meta = build_index(proxies.target(spark, d).select(proxies.spread(F.col("min_hash")).alias("min_hash")), path, bits=6, strategy=TOP_BITS)
    write_json(spark, f"{path}/meta.json", {k: v for k, v in meta.items() if k != "shard_strategy"})
    return Index(spark, path).probe(proxies.left(spark, d).distinct().select("hash", proxies.spread(F.col("hash")).alias("asked")), "asked").select("hash", "hit")


def index_file_stats(spark, d):
    """Sizes of the shards that were written."""
    path = _folder(spark)
    build_index(proxies.left(spark, d), path, column="hash", bits=4)
    return shard_statistics(Index(spark, path).rows, bits=4)


def top_bit_shards(spark, d):
    """Rows by the top bits of the unsigned hash."""
    return proxies.left(spark, d).groupBy(high_bits(proxies.spread(F.col("hash")), 8).alias("shard")).agg(F.count("*").alias("n"))


def _items(spark, d) -> DataFrame:
    """The benchmark's items as sequences."""
    return proxies._table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("contig"), proxies.dna(F.coalesce("text", F.lit(""))).alias("sequence"))


def _fasta(rows: DataFrame, width: int) -> DataFrame:
    """Records with lines of a width."""
    body = F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n")
    return rows.select(F.concat(F.lit(">"), "contig", F.lit(" item\n"), body).alias("value"))


def _packed(path: str):
    """Each partition's text as a zstd file of a shared folder."""

    def run(batches):
        import os

        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        folder = streams.local(path)
        os.makedirs(folder, exist_ok=True)
        text = "\n".join(t for b in batches for t in b.column(0).to_pylist())
        if text:
            with open(f"{folder}/{TaskContext.get().partitionId()}.contigs.fa.zst", "wb") as f:
                f.write(zstandard.compress(text.lower().encode()))
        yield pa.RecordBatch.from_arrays([pa.array([len(text)])], ["n"])

    return run


def _contig_folders(spark, d) -> dict[str, str]:
    """Folders of FASTA by accession, in some files each: plain, in gzip and in zstd."""
    at, rows = _folder(spark), _items(spark, d).repartition(4, "contig")
    _fasta(rows, 70).write.text(f"{at}/plain")
    _fasta(rows, 80).write.option("compression", "gzip").text(f"{at}/zipped")
    _fasta(rows, 60).mapInArrow(_packed(f"{at}/packed"), "n bigint").agg(F.sum("n")).collect()
    return {"plain": f"{at}/plain", "zipped": f"{at}/zipped", "packed": f"{at}/packed"}


def fasta_contigs(spark, d):
    """Contigs of plain and compressed files."""
    return contigs.checked(contigs.read_contigs(contigs.addresses(spark, _contig_folders(spark, d))))


#: Rows of a file of matches, about: the number of files grows with the table, so that no task writes or reads more the larger it is.
FILE_ROWS = 200_000


def _match_folders(spark, d) -> dict[str, str]:
    """K-mer matches of another tool in many files, two kinds of header, some rows without a number, a name, or within the gate."""
    at = _folder(spark)
    rows = proxies.signatures(spark, d).select(F.concat(F.lit("c"), F.pmod("min_hash", F.lit(7))).alias("name"), F.when(F.col("ksize") == 7, F.lit("none")).when(F.col("ksize") == 6, F.lit("-5")).otherwise(F.col("min_hash").cast("string")).alias("hashval"))
    files = -(-rows.count() // FILE_ROWS)  # by the footers
    rows.repartition(max(5, files)).write.option("header", "true").csv(f"{at}/first")
    rows.select(F.col("hashval").alias("HASH"), F.lit("x,y").alias("note"), F.col("name").alias("sequence")).filter("name <> 'c0'").repartition(max(3, files)).write.option("header", "true").csv(f"{at}/second")
    return {"first": f"{at}/first", "second": f"{at}/second"}


def kmer_matches(spark, d):
    """Matches by accession and contig of two folders whose files have headers of their own."""
    return contigs.usable(contigs.read_match_rows(contigs.addresses(spark, _match_folders(spark, d))))


def matches_left_out(spark, d):
    """Rows of the match files that have no number, by accession."""
    return contigs.left_out(contigs.read_match_rows(contigs.addresses(spark, _match_folders(spark, d))))


def annotation_of_matches(spark, d):
    """Contigs annotated from matches against a written index."""
    at = _folder(spark)
    build_index(proxies.target(spark, d), at, bits=4, layout=BUCKETS)
    found = contigs.usable(contigs.read_match_rows(contigs.addresses(spark, _match_folders(spark, d))))
    return annotate.annotate(found.withColumn("accession", F.lit("all")), Index(spark, at))


def _item_index(spark, d, at: str) -> str:
    """An index of every third hash of the items."""
    hashes = annotate.contig_hashes(_items(spark, d).withColumn("accession", F.lit("")), k=K, most=1 << 62).select("hash").distinct()
    third = hashes.withColumn("r", F.row_number().over(Window.orderBy("hash"))).filter("r % 3 = 1")  # of the benchmark alone, which is small
    third.select(F.col("hash").alias("min_hash")).write.parquet(f"{at}/hashes")
    jobs.build_index_job(spark, f"{at}/hashes", f"{at}/index", bits=3)
    return f"{at}/index"


def annotation_job(spark, d):
    """Three accessions' folders annotated by the whole job: the index holds every third hash."""
    at = _folder(spark)
    return jobs.annotate(spark, _item_index(spark, d, at), f"{at}/out", contigs=_contig_folders(spark, d), most=1 << 62)


def _accessions(spark, d) -> str:
    """The whole job over accessions whose files share a name, whose names have dots, that are given by matches, broken, or missing; a table of accessions with a template of addresses."""
    at, rows = _folder(spark), _items(spark, d).repartition(1)
    few = rows.filter("pmod(cast(contig AS bigint), 2) = 0")
    for name, part in (("A1", rows), ("B2", few), ("S1.v2", few)):
        _fasta(part, 70).write.text(f"{at}/in/{name}/contigs.fa")
    write_bytes(spark, f"{at}/in/broken/contigs.fa.gz", b"\x1f\x8b\x08 and no more")
    write_bytes(spark, f"{at}/in/odd.csv", b"a,b\n1,2\n")
    asked = spark.createDataFrame([("A1",), ("B2",), ("S1.v2",), ("gone",), ("A1",)], "accession string")
    matches = {**_match_folders(spark, d), "odd": f"{at}/in/odd.csv"}
    jobs.annotate(spark, _item_index(spark, d, at), f"{at}/out", asked, url=f"{at}/in/{{acc}}/contigs.fa", contigs={"broken": f"{at}/in/broken/contigs.fa.gz"}, matches=matches, most=1 << 62)
    return f"{at}/out"


def annotation_accessions(spark, d):
    """Figures by accession: contigs, their lengths and hashes."""
    rows = spark.read.schema(CONTIG_COUNTS).parquet(f"{_accessions(spark, d)}/counts")
    return rows.groupBy("accession").agg(F.count("*").alias("n_contigs"), F.sum("contig_length").alias("length"), F.sum("candidate_hashes").alias("candidates"), F.sum("novel_hashes").alias("novel"))


def annotation_status(spark, d):
    """What each accession came to, up to the first colon or the address."""
    rows = spark.read.parquet(f"{_accessions(spark, d)}/status")
    return rows.select("accession", F.regexp_replace("status", "^(no file|not readable).*", "$1").alias("status"))


def murmur_items(spark, d):
    """MurmurHash3 of all canonical k-mers of the benchmark's items that the gate keeps."""
    items = proxies._table(spark, d, "benchmark").select(F.lit("all").alias("accession"), F.col("item_id").cast("string").alias("contig"), proxies.dna(F.col("text")).alias("sequence"))
    return annotate.contig_hashes(items, k=K, most=1 << 62).select("contig", "hash")


def streamed_counts(spark, d):
    """Counts by hash after signatures have arrived in two batches that overlap."""
    at = _folder(spark)
    sig = proxies.signatures(spark, d).filter("ksize = 2")
    for part in (sig.filter("min_hash % 3 < 2"), sig.filter("min_hash % 3 > 0")):
        part.write.mode("append").parquet(f"{at}/in")
        follow_signatures(spark, f"{at}/in", f"{at}/pairs", f"{at}/state", ksize=2).awaitTermination()
    return current_counts(spark, f"{at}/pairs")[0]


def flat_lists(spark, d):
    """Lists that count repeated pairs as often as they occur."""
    picked = selection.between(proxies.all_counts(spark, d), 25, 10000, "sample_count")
    sig = proxies.signatures(spark, d)
    return counts.sample_lists(sig.unionByName(sig), picked, ksize=2, distinct=False).withColumn("sample_ids", F.array_join("sample_ids", ","))


def queries() -> dict:
    found = [
        hive_dataset, sorted_single_file, sorted_parts, shard_files, sample_shards, pair_parts, manifest_difference, manifest_views, venn_csv, limited_scan, bernoulli_sample, topn_json, topn_ids_json, top_in_ranges, percentile_job, sample_list, remove_set_job,
        histogram_csv, histogram_picture, sorted_table, preview, set_comparisons, index_built_probe, index_top_bits_probe, index_file_stats, top_bit_shards, fasta_contigs, kmer_matches, matches_left_out, annotation_of_matches, annotation_job, annotation_accessions, annotation_status, murmur_items,
        index_bucketed_probe, index_lookup, difference_reused, catalog_difference, footer_counts, row_group_sizes, split_buckets, replaced_output, streamed_counts, flat_lists,
    ]
    return {f.__name__: f for f in found}


_DNA = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC')"


def _murmur_sql(kmers: str) -> str:
    """SQL for MurmurHash3 x64-128 (first word, seed 42) of column ``kmer``, 31 letters long, as column h; 128-bit products, cut to 64 bits."""
    c1, c2, mask = 0x87C37B91114253D5, 0x4CF5AD432745937F, (1 << 64) - 1
    low = lambda x: f"(({x}) & {mask}::UHUGEINT)"
    times = lambda x, c: low(f"({x}) * {c}::UHUGEINT")
    turn = lambda x, r: low(f"(({x}) << {r}) | (({x}) >> {64 - r})")
    word = lambda at, n: " + ".join(f"(ascii(substr(kmer, {at + i + 1}, 1))::UHUGEINT << {8 * i})" for i in range(n))
    steps = [
        {"a": word(0, 8), "b": word(8, 8), "c": word(16, 8), "e": word(24, 7)},
        {"a": times("a", c1), "b": times("b", c2), "c": times("c", c1), "e": times("e", c2)},
        {"a": times(turn("a", 31), c2), "b": times(turn("b", 33), c1), "c": times(turn("c", 31), c2), "e": times(turn("e", 33), c1)},
        {"p": turn("xor(42::UHUGEINT, a)", 27)},
        {"p": low(f"({low('p + 42')}) * 5 + {0x52DCE729}")},
        {"q": turn("xor(42::UHUGEINT, b)", 31)},
        {"q": low(f"({low('q + p')}) * 5 + {0x38495AB5}")},
        {"p": "xor(xor(p, c), 31::UHUGEINT)", "q": "xor(xor(q, e), 31::UHUGEINT)"},
        {"p": low("p + q")},
        {"q": low("q + p")},
        *({v: (times(f"xor({v}, {v} >> 33)", k) if k else f"xor({v}, {v} >> 33)") for v in ("p", "q")} for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0)),
    ]
    sql, have = kmers, ["contig", "kmer"]
    for step in steps:
        have += [c for c in step if c not in have]
        sql = f"SELECT {', '.join(f'{step[c]} AS {c}' if c in step else c for c in have)} FROM ({sql})"
    return f"SELECT contig, {low('p + q')} AS h FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    base = proxies.oracle_sql()
    sig, diff, target = proxies.SIG_SQL, base["left_minus_rights"], proxies.TARGET_SQL
    lists = base["hash_sample_lists_sharded"]
    sampled = f"SELECT min_hash, count(DISTINCT sample_id) AS n_samples FROM ({sig}) %s GROUP BY min_hash ORDER BY n_samples DESC, min_hash LIMIT "
    counted = base["hash_sample_counts"]
    low, high = (f"(SELECT quantile_cont(sample_count, {p}) FROM ({counted}))" for p in (0.5, 0.9))
    spread = proxies.WIDE
    items = f"SELECT CAST(item_id AS VARCHAR) AS contig, {_DNA} AS sequence FROM benchmark"
    all_matches = "SELECT 'c' || (min_hash % 7) AS contig, min_hash AS hash, ksize FROM (" + sig + ")"
    matches = f"SELECT contig, hash FROM ({all_matches}) WHERE ksize NOT IN (6, 7)"
    both = f"SELECT 'first' AS accession, contig, hash FROM ({matches}) UNION ALL SELECT 'second', contig, hash FROM ({matches}) WHERE contig <> 'c0'"
    third = "SELECT hash FROM (SELECT hash, row_number() OVER (ORDER BY hash) AS r FROM (SELECT DISTINCT hash FROM m)) WHERE r % 3 = 1"
    pairs = base["distinct_pairs"]
    of = lambda rows: f"SELECT contig, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT contig, substr(sequence, i, {K}) AS kmer FROM (SELECT contig, sequence, unnest(range(1, length(sequence) - {K - 2})) AS i FROM ({rows}) WHERE length(sequence) >= {K}))"
    kmers = of(items)
    murmur = f"SELECT contig, CAST(h AS BIGINT) AS hash FROM ({_murmur_sql(kmers)}) WHERE h < {1 << 62}::UHUGEINT"
    return {
        "hive_dataset": f"SELECT hash AS min_hash FROM ({diff})",
        "sorted_single_file": f"SELECT hash, row_number() OVER (ORDER BY hash) - 1 AS place FROM ({proxies.RIGHT_SQL})",
        "sorted_parts": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_overlaps FROM lineitem",
        "shard_files": lists,
        "sample_shards": f"SELECT sample_id, count(*) AS n_pairs, CAST(1 AS BIGINT) AS n_shards FROM ({base['sample_pairs_flat']}) GROUP BY sample_id",
        "pair_parts": base["distinct_pairs"],
        "manifest_difference": diff,
        "manifest_views": f"SELECT 'query' AS alias, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'parts', count(*) + 2 FROM ({target}) UNION ALL SELECT 'suppliers', count(*) FROM supplier",
        "venn_csv": f"WITH t AS ({target}), o AS (SELECT l_partkey AS hash FROM lineitem WHERE l_linenumber = 31 UNION SELECT s_suppkey FROM supplier), c AS (SELECT (SELECT count(*) FROM t WHERE min_hash NOT IN (SELECT hash FROM o)) AS a, (SELECT count(*) FROM t WHERE min_hash IN (SELECT hash FROM o)) AS b, (SELECT count(*) FROM o WHERE hash NOT IN (SELECT min_hash FROM t)) AS c, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM o) AS no_) SELECT a AS target_only, b AS intersection, c AS others_only, nt AS target_total, no_ AS others_total, nt = a + b AS sanity_target, no_ = b + c AS sanity_others FROM c",
        "limited_scan": f"SELECT sample_id, min_hash, CAST(ksize AS INTEGER) AS ksize FROM ({sig}) WHERE ksize IN (1, 2)",
        "bernoulli_sample": "SELECT CAST(0 AS BIGINT) AS strangers, true AS near",
        "topn_json": sampled % "WHERE ksize = 3" + "50",
        "topn_ids_json": f"SELECT min_hash, any_value(n_samples) AS n_samples, array_to_string(list_sort(list(DISTINCT sample_id)), ',') AS sample_ids FROM ({sampled % ''} 20) JOIN ({sig}) USING (min_hash) GROUP BY min_hash",
        "top_in_ranges": sampled % "" + "333",
        "percentile_job": f"SELECT min_hash, count(*) AS sample_count, array_to_string(list_sort(list(sample_id)), ',') AS sample_ids, {low} AS low_cut, {high} AS high_cut FROM (SELECT DISTINCT min_hash, sample_id FROM ({sig}) WHERE ksize = 2 AND min_hash IN (SELECT min_hash FROM ({counted}) WHERE sample_count BETWEEN {low} AND {high})) GROUP BY min_hash",
        "sample_list": f"SELECT sample_id FROM ({sig}) JOIN (SELECT DISTINCT min_hash FROM ({target})) USING (min_hash) WHERE ksize = 2 GROUP BY sample_id HAVING count(DISTINCT min_hash) BETWEEN 2 AND 4",
        "remove_set_job": f"SELECT min_hash, sample_count, sample_ids FROM ({lists}) WHERE min_hash NOT IN (SELECT min_hash FROM ({target}))",
        "histogram_csv": base["histogram_counts"],
        "histogram_picture": f"SELECT picture, CASE WHEN bin < 0 THEN 'firebrick' ELSE 'steelblue' END AS color, count(*) AS n_bars, CAST(sum(n) AS BIGINT) AS n_values FROM ({base['histogram_counts']}), (VALUES ('bars'), ('bars_log')) AS v(picture) GROUP BY 1, 2",
        "sorted_table": f"SELECT DISTINCT hash, bucket FROM ({diff})",
        "preview": "SELECT CAST(10 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS strangers",
        "set_comparisons": f"SELECT true AS part, NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey NOT IN (SELECT min_hash FROM ({target}))) AS whole, true AS same",
        "index_built_probe": base["index_probe"],
        "index_top_bits_probe": f"SELECT min_hash AS hash, hit FROM ({base['index_probe']})",
        "index_file_stats": base["index_shard_stats"],
        "top_bit_shards": f"SELECT CAST(floor(h / 72057594037927936.0) + CASE WHEN h < 0 THEN 256 ELSE 0 END AS INTEGER) AS shard, count(*) AS n FROM (SELECT {spread % 'l_partkey'} AS h FROM lineitem) GROUP BY 1",
        "fasta_contigs": f"SELECT accession, contig, sequence, CAST(length(sequence) AS INTEGER) AS contig_length FROM ({items}), (VALUES ('plain'), ('packed'), ('zipped')) AS v(accession)",
        "kmer_matches": both,
        "matches_left_out": f"SELECT 'first' AS accession, count(*) AS n_left_out FROM ({all_matches}) WHERE ksize = 7 UNION ALL SELECT 'second', count(*) FROM ({all_matches}) WHERE ksize = 7 AND contig <> 'c0'",
        "index_bucketed_probe": f"SELECT min_hash, hit FROM ({base['index_probe']}) UNION ALL SELECT NULL, false FROM range(2)",
        "index_lookup": f"SELECT layout, CAST(n_nationkey AS BIGINT) AS min_hash, n_nationkey IN (SELECT min_hash FROM ({target})) AS hit FROM nation, (VALUES ('shards'), ('buckets')) AS v(layout)",
        "difference_reused": f"SELECT DISTINCT hash, CAST(hash & 15 AS INTEGER) AS bucket FROM ({diff})",
        "catalog_difference": diff,
        "footer_counts": f"SELECT count(*) AS n_rows, min(hash) AS hash_min, max(hash) AS hash_max FROM ({diff})",
        "row_group_sizes": f"WITH s AS (SELECT CAST(min_hash % 16 AS INTEGER) AS shard, count(*) AS n FROM ({pairs}) GROUP BY 1) SELECT shard, CAST(g AS INTEGER) AS row_group, least(100, n - 100 * g) AS n_rows FROM (SELECT shard, n, unnest(range(0, (n + 99) // 100)) AS g FROM s)",
        "split_buckets": f"SELECT CAST(hash & 3 AS INTEGER) AS bucket, count(*) AS n_rows, true AS several FROM ({diff}) GROUP BY 1",
        "replaced_output": f"SELECT 'failed' AS after, count(*) AS n, CAST(sum(min_hash) AS BIGINT) AS total FROM ({target}) UNION ALL SELECT 'replaced', count(*), CAST(sum(min_hash + 1) AS BIGINT) FROM ({target})",
        "annotation_accessions": f"WITH m AS ({murmur}), x AS ({third}), c AS (SELECT contig, count(*) AS cand, count(*) FILTER (WHERE hash IN (SELECT hash FROM x)) AS hits FROM m GROUP BY contig), i AS (SELECT contig, length(sequence) AS n, coalesce(cand, 0) AS cand, coalesce(hits, 0) AS hits FROM ({items}) LEFT JOIN c USING (contig)) SELECT accession, count(*) AS n_contigs, CAST(sum(n) AS BIGINT) AS length, CAST(sum(cand) AS BIGINT) AS candidates, CAST(sum(hits) AS BIGINT) AS novel FROM i, (VALUES ('A1', 1), ('B2', 2), ('S1.v2', 2)) AS v(accession, step) WHERE CAST(contig AS BIGINT) % step = 0 GROUP BY accession UNION ALL SELECT accession, count(DISTINCT contig), CAST(-count(DISTINCT contig) AS BIGINT), count(*), count(*) FILTER (WHERE hash IN (SELECT hash FROM x)) FROM ({both}) GROUP BY accession",
        "annotation_status": f"SELECT * FROM (VALUES ('A1', 'done'), ('B2', 'done'), ('S1.v2', 'done'), ('gone', 'no file'), ('broken', 'not readable'), ('odd', 'not readable')) AS v(accession, status) UNION ALL SELECT 'first', 'done, ' || count(*) || ' rows left out' FROM ({all_matches}) WHERE ksize = 7 UNION ALL SELECT 'second', 'done, ' || count(*) || ' rows left out' FROM ({all_matches}) WHERE ksize = 7 AND contig <> 'c0'",
        "annotation_of_matches": f"SELECT 'all' AS accession, contig, CAST(-1 AS INTEGER) AS contig_length, count(*) AS candidate_hashes, count(*) FILTER (WHERE hash IN (SELECT min_hash FROM ({target}))) AS novel_hashes, count(*) FILTER (WHERE hash IN (SELECT min_hash FROM ({target}))) / count(*) AS frac_novel FROM ({both}) GROUP BY contig",
        "annotation_job": f"WITH m AS ({murmur}), x AS ({third}), c AS (SELECT contig, count(*) AS cand, count(*) FILTER (WHERE hash IN (SELECT hash FROM x)) AS hits FROM m GROUP BY contig) SELECT accession, contig, CAST(length(sequence) AS INTEGER) AS contig_length, coalesce(cand, 0) AS candidate_hashes, coalesce(hits, 0) AS novel_hashes, CASE WHEN coalesce(cand, 0) > 0 THEN hits / cand ELSE 0.0 END AS frac_novel FROM ({items}) LEFT JOIN c USING (contig), (VALUES ('plain'), ('packed'), ('zipped')) AS v(accession)",
        "murmur_items": murmur,
        "murmur_kmers": f"SELECT 'all' AS accession, contig, CAST(h AS BIGINT) AS hash FROM ({_murmur_sql(of(f'SELECT CAST(doc_id AS VARCHAR) AS contig, {_DNA} AS sequence FROM documents'))}) WHERE h < {MAX_HASH}::UHUGEINT",
        "streamed_counts": f"SELECT min_hash, count(DISTINCT sample_id) AS sample_count FROM ({sig}) WHERE ksize = 2 GROUP BY min_hash",
        "flat_lists": f"SELECT min_hash, count(*) AS sample_count, array_to_string(list_sort(list(sample_id)), ',') AS sample_ids FROM (SELECT * FROM ({sig}) WHERE ksize = 2 UNION ALL SELECT * FROM ({sig}) WHERE ksize = 2) WHERE min_hash IN (SELECT min_hash FROM ({proxies.COUNT_SQL}) WHERE sample_count BETWEEN 25 AND 10000) GROUP BY min_hash",
    }
