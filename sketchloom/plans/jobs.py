"""The engine's jobs: sources, operators and sinks put together, each with its options."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom import schemas
from sketchloom.functions.kmers import murmur_sketch
from sketchloom.operators import annotate as annotation
from sketchloom.operators import counts, histogram, selection, setops
from sketchloom.operators import negatives as negative_sets
from sketchloom.operators.index import BUCKETS, Index, build_index
from sketchloom.sources import contigs as contig_sources
from sketchloom.sources import sinks
from sketchloom.sources.datasets import footer_statistics, read_counts, read_hive_hashes, read_plain, read_signatures, union_all
from sketchloom.sources.files import exists, guard, latest_run, materialised, read_json, remove, replacing, run_id, write_bytes, write_json
from sketchloom.sources.manifest import HashSet, ManifestError, load_manifest


def _sides(spark: SparkSession, manifest, one_left: bool) -> list[HashSet]:
    return load_manifest(spark, manifest, one_left=one_left)


def left_minus_rights(
    spark: SparkSession, manifest: str | dict, out: str, *, ksize: int = schemas.KSIZE, filter_left: bool = False, distinct_left: bool = False, fraction: float = 1.0, buckets: int = 256, single_file: bool = False, files: int | None = None,
    negatives: str | None = None, skip_build: bool = False, overwrite: bool = False,
) -> str:
    """Write LEFT without all RIGHTs: by bucket, in one file each or in ``files``, or as one sorted file. LEFT is only filtered by k-size if asked.

    ``negatives`` keeps the hashes of all RIGHTs in a table there; with ``skip_build`` the one that is there is used, which
    must have been built from the same sets, as they are now, and with the same parameters.
    """
    if skip_build and not negatives:
        raise ValueError("there is no negative set to use")
    sets = _sides(spark, manifest, True)
    for item in sets:
        item.check(spark)
    left, rights = next(s for s in sets if s.set_id == "left"), [s for s in sets if s.set_id == "right"]
    guard(spark, out, overwrite)
    kept = None
    if negatives:
        same = {"ksize": ksize, "fraction": fraction, "buckets": buckets}
        kept = negative_sets.reuse(spark, rights, negatives, **same) if skip_build else negative_sets.build(spark, rights, negatives, **same, overwrite=True)
    frames = [] if negatives else [s.read(spark, ksize) for s in rights]
    found = setops.difference(left.read(spark, ksize if filter_left else None), frames, distinct_left=distinct_left, fraction=fraction, buckets=buckets, negatives=kept)
    if single_file:
        return sinks.write_single(found.select("hash"), out, overwrite=overwrite, sort=["hash"])
    return sinks.write_partitioned(found, out, "bucket", overwrite=overwrite, sort=["hash"], values=buckets, files=files, spread=F.xxhash64("hash"))


def alias_vs_others(spark: SparkSession, manifest: str | dict, alias: str, *, out: str | None = None, ksize: int = schemas.KSIZE, fraction: float = 1.0, buckets: int = 256, overwrite: bool = False) -> dict:
    """The Venn counts of one named set against all others; also as CSV if ``out`` is given."""
    sets = _sides(spark, manifest, False)
    target = next((s for s in sets if s.alias == alias), None)
    if target is None:
        raise ManifestError(f"no entry {alias}; there are {[s.alias for s in sets]}")
    row = setops.venn(target.read(spark, ksize), [s.read(spark, ksize) for s in sets if s is not target], fraction=fraction, buckets=buckets)
    found = row.first().asDict()
    if out:
        sinks.write_csv(spark.createDataFrame([found], row.schema), out, overwrite=overwrite)
    return found | {"target": alias, "others": [s.alias for s in sets if s is not target], "ksize": ksize, "sample_fraction": fraction, "buckets": buckets}


def prepare_hashes(spark: SparkSession, root: str, out: str, *, pattern: str = "bucket=*", column: str = "hash", deduplicate: bool = False, preview: str | None = None, overwrite: bool = False) -> str:
    """Hashes of a Hive-partitioned dataset as a table of their own, (min_hash), clustered by hash so that later joins find them in order."""
    rows = read_hive_hashes(spark, root, pattern, column=column)
    if deduplicate:
        rows = rows.distinct()
    sinks.write_sorted(rows, out, "min_hash", overwrite=overwrite)
    if preview:
        sinks.write_preview(spark.read.parquet(out), preview, overwrite=overwrite)
    return out


def compute_counts(spark: SparkSession, hashes: str, signatures: str, ksize: int, out: str, *, materialize_pairs: bool = False, pairs_out: str | None = None, overwrite: bool = False) -> dict[str, str]:
    """hash_counts and sample_counts over distinct pairs; the pairs can be kept, in 1024 parts."""
    known = spark.read.parquet(hashes).select("min_hash").distinct()
    pairs = counts.distinct_pairs(read_signatures(spark, signatures, ksize=ksize), known)
    paths = {"hash": f"{out}/hash_counts.parquet", "sample": f"{out}/sample_counts.parquet"}
    for path in paths.values():
        guard(spark, path, overwrite)
    stored = None
    if materialize_pairs:
        paths["pairs"] = pairs_out or f"{out}/pairs"
        sinks.write_partitioned(pairs, paths["pairs"], "part", overwrite=overwrite, values=1024)
        pairs = spark.read.parquet(paths["pairs"])
    else:
        pairs, stored = materialised(pairs.select("sample_id", "min_hash"), "pairs")
    for df, name in zip(counts.counts_from_pairs(pairs), ("hash", "sample")):
        sinks.write_plain(df, paths[name], overwrite=overwrite)
    if stored:
        remove(spark, stored)
    return paths


def percentiles(
    spark: SparkSession, source: str, out: str, *, counts_path: str | None = None, percentiles: tuple[float, float] | None = None, cuts: tuple[float, float] | None = None,
    signatures: str | None = None, map_out: str | None = None, ksize: int = schemas.KSIZE, shards: int = 128, shard_key: str = "hash", row_group_rows: int = 1_000_000, as_lists: bool = True, sort_lists: bool = True, distinct_pairs: bool = True, sample_list_out: str | None = None, prefix: str | None = None, overwrite: bool = False,
) -> dict:
    """Cutpoints of counts as JSON; and for what lies between them hash-to-sample lists or pairs, in shards, or the list of samples."""
    if map_out and (source != "hash" or not signatures):
        raise ValueError("lists need counts of hashes and signatures")
    if sample_list_out and source != "sample":
        raise ValueError("a list of samples needs counts of samples")
    if shard_key == "sample" and as_lists:
        raise ValueError("lists hold all samples of a hash; they can only be sharded by hash")
    column = selection.COUNT_COLUMN[source]
    found = read_counts(spark, counts_path or f"{out}/{source}_counts.parquet")
    cut = selection.cutpoints(found, source, percentiles=percentiles, cuts=cuts)
    sidecar = f"{out}/{source}_percentiles.json"
    guard(spark, sidecar, overwrite)
    write_json(spark, sidecar, cut.to_dict())
    kept = selection.between(found, cut.low_cut, cut.high_cut, column)
    if map_out:
        rows = read_signatures(spark, signatures, ksize=ksize)
        if as_lists:
            made = counts.sample_lists(rows, kept, distinct=distinct_pairs, sort=sort_lists)
        else:
            made = counts.select_hashes(rows, kept).select("min_hash", "sample_id").distinct()
        sinks.write_shards(made, map_out, shards, "min_hash" if shard_key == "hash" else "sample_id", overwrite=overwrite, row_group_rows=row_group_rows, prefix=prefix)
    if sample_list_out:
        sinks.write_single(kept.select("sample_id"), sample_list_out, overwrite=overwrite)
    return cut.to_dict()


def inspect(spark: SparkSession, hashes: str, signatures: str, ksize: int) -> dict:
    """Counts and first rows of both inputs; what can't be read is reported, not raised."""
    found: dict = {}
    for name, read in (("hashes", lambda: spark.read.parquet(hashes)), ("signatures", lambda: read_signatures(spark, signatures, ksize=ksize))):
        try:
            df = read()
            found[name] = {"rows": df.count(), "head": [r.asDict() for r in df.limit(5).collect()]}
        except (PySparkException, Py4JJavaError, ValueError, OSError) as e:  # a reader's error is the answer here
            found[name] = {"error": str(e).splitlines()[0][:300]}
    return found


def remove_set(spark: SparkSession, lists: str, exclude: str, out: str, *, table: str = "unique_hashes", ksize: int = schemas.KSIZE, hash_column: str = "hash", ksize_column: str = "ksize", overwrite: bool = False) -> dict:
    """List shards without the hashes of one more set, as one dataset; warns if that set is empty."""
    known = HashSet("exclude", exclude, table, hash_column, "right").relation(spark)
    if ksize_column in known.columns:
        known = known.filter(F.col(ksize_column) == ksize)
    n = known.count()
    guard(spark, out, overwrite)
    rows = read_plain(spark, lists)
    sinks.write_plain(setops.exclude(rows, known, "min_hash", hash_column), out, overwrite=overwrite)
    return {"excluded_set": n, "rows": spark.read.parquet(out).count(), "warning": "" if n else "the set to exclude is empty"}


def row_counts(spark: SparkSession, path: str, column: str = "hash", distinct: bool = False) -> int:
    """Rows, as the footers have them, or distinct hashes, of a dataset."""
    return counts.distinct_count(spark.read.parquet(path), column).first()[0] if distinct else footer_statistics(spark, path).first()["n_rows"]


def sorted_copy(spark: SparkSession, root: str, out: str, *, column: str = "hash", table: str | None = None, overwrite: bool = False) -> str:
    """A hash dataset in global order: as Parquet, or as a managed table."""
    rows = read_hive_hashes(spark, root, column=column, name=column)
    return sinks.write_table(rows, table, column, overwrite=overwrite) if table else sinks.write_sorted(rows, out, column, overwrite=overwrite)


def histogram_job(spark: SparkSession, path: str, out: str, *, column: str = "sample_count", bins: int = 100, max_value: float | None = None, picture: str | None = None, overwrite: bool = False) -> dict:
    """The histogram as CSV and its figures as JSON; if asked pictures, linear and logarithmic: ``picture``.svg and ``picture``_log.svg."""
    made = histogram.histogram(read_counts(spark, path, column), column=column, bins=bins, max_value=max_value)
    rows = made.collect()  # a row for each bin: the counts are read once for all that follows
    sinks.write_csv(spark.createDataFrame(rows, made.schema), f"{out}/bins", overwrite=overwrite)
    stats = histogram.figures(rows)
    write_json(spark, f"{out}/statistics.json", stats)
    if picture:
        for log in (False, True):
            place = f"{picture.removesuffix('.svg')}{'_log' if log else ''}.svg"
            guard(spark, place, overwrite)
            write_bytes(spark, place, histogram.picture(rows, column=column, log=log).encode())
    return stats


def top_minhashes(
    spark: SparkSession, source: str, out: str, *, stages: tuple[str, ...] = ("counts", "topn", "ids"), n: int = 100, buckets: int = 512, ksize: int | None = None, fraction: float | None = None, file_limit: int | None = None,
    seed: int = 1337, compress: bool = False, json_parts: int = 1, tag: str | None = None, skip_distinct: bool = False, rename: bool = True, keep_markers: bool = False, overwrite: bool = False,
) -> dict[str, str]:
    """Counts by hash, the top N, and the samples of those, each stage from what the one before wrote.

    The parameters of the counts are kept beside them; other parameters don't
    reuse them.
    """
    made: dict[str, str] = {}
    raw = lambda: read_signatures(spark, source, ksize=ksize, file_limit=file_limit, sample_fraction=fraction, seed=seed)
    path, note = f"{out}/counts_parquet", f"{out}/counts_parameters.json"
    used = {"input": source, "ksize": ksize, "fraction": fraction, "file_limit": file_limit, "seed": seed, "buckets": buckets}
    if "counts" in stages:
        made["counts"] = sinks.write_partitioned(counts.bucket_counts(raw(), buckets), path, "bucket", overwrite=overwrite, values=buckets)
        write_json(spark, note, used)
    elif exists(spark, note) and (have := read_json(spark, note)) != used:
        raise ValueError(f"{path} was made with {have}, not {used}")
    run = run_id(tag)
    top_root = f"{out}/topn_parquet/topN={n}"
    if "topn" in stages:
        best = counts.top(read_counts(spark, path), n)
        made["topn"] = f"{top_root}/run={run}"
        sinks.write_plain(best, made["topn"], overwrite=overwrite)
        ordered = spark.read.parquet(made["topn"]).orderBy(F.desc("n_samples"), "min_hash")
        made["topn_json"] = sinks.write_json_lines(ordered, f"{out}/topn_json/topN={n}/run={run}", overwrite=overwrite, compress=compress, name=f"top{n}" if rename else None, keep_markers=keep_markers)
    if "ids" in stages:
        chosen = made.get("topn") or (f"{top_root}/run={tag}" if tag else latest_run(spark, top_root))
        best = spark.read.parquet(chosen)
        lists = counts.sample_lists_of(raw(), best, distinct=not skip_distinct, n_keys=best.count())
        made["ids"] = sinks.write_json_lines(lists, f"{out}/topn_ids_json/topN={n}/run={run}", overwrite=overwrite, compress=compress, parts=json_parts, name=f"top{n}_ids" if rename and json_parts == 1 else None, keep_markers=keep_markers)
    return made


def build_index_job(spark: SparkSession, source: str, path: str, *, bits: int = schemas.SHARD_BITS, column: str = "min_hash", layout: str = BUCKETS, distinct: bool = False, overwrite: bool = False) -> dict:
    return build_index(spark.read.parquet(source), path, column=column, bits=bits, layout=layout, distinct=distinct, overwrite=overwrite, source=source)


def annotate(
    spark: SparkSession, index: str, out: str, accessions: list[str] | DataFrame = (), *, url: str | None = None, opener: Callable[[str], object] | None = None, contigs: list[str] | dict[str, str] | DataFrame | None = None,
    matches: list[str] | dict[str, str] | DataFrame | None = None, k: int = schemas.KSIZE, most: int = schemas.MAX_HASH, overwrite: bool = False,
) -> DataFrame:
    """Annotate contigs of accessions; what an accession came to is in ``status`` beside the result.

    Accessions, contigs and matches (k-mer CSVs of another tool) are lists, or
    tables of accessions or of (accession, address), of any length; paths
    without an accession are named by it. Contigs of accessions that have none
    are fetched from ``url`` with {acc} in it. Each accession has its own way:
    where it has matches, these take the place of hashing, and contigs only give
    lengths. Files are opened and read by the tasks. An accession that can't be
    fetched, found, unpacked or read has that as its status and no result, and
    doesn't stop the others. The number of Spark jobs doesn't depend on that of
    the accessions.
    """
    guard(spark, out, overwrite)
    table = lambda given: given if isinstance(given, DataFrame) else contig_sources.addresses(spark, given or [])
    asked = accessions if isinstance(accessions, DataFrame) else spark.createDataFrame([(a,) for a in accessions], "accession string")
    asked = asked.select("accession").distinct()
    fasta, csvs = table(contigs), table(matches)
    missing = asked.join(fasta, "accession", "left_anti")
    if url:
        fasta = fasta.unionByName(contig_sources.templated(missing, url))
        missing = missing.limit(0)
    missing = missing.join(csvs, "accession", "left_anti").select("accession", F.lit("no contigs and no address to fetch them from").alias("problem"))
    everyone = asked.union(fasta.select("accession")).union(csvs.select("accession")).distinct()
    idx = Index(spark, index)
    with replacing(spark, out, overwrite) as at:
        # read once, so that what went wrong is known before anything is counted
        contig_sources.read_contigs(fasta, opener=opener).join(csvs.select("accession").distinct().withColumn("matched", F.lit(True)), "accession", "left").withColumn(
            "hashes", F.when(F.col("matched").isNull(), murmur_sketch(k, most)(F.when(F.col("matched").isNull(), F.col("sequence"))))
        ).drop("sequence").write.parquet(f"{at}/_contigs")
        contig_sources.read_match_rows(csvs, opener=opener).write.parquet(f"{at}/_matches")
        texts, hits = (spark.read.parquet(f"{at}/{name}") for name in ("_contigs", "_matches"))
        problems = texts.select("accession", "problem").union(hits.filter(F.col("problem") != contig_sources.LEFT_OUT).select("accession", "problem")).filter("problem IS NOT NULL").union(missing)
        problems = problems.groupBy("accession").agg(F.min("problem").alias("problem"))
        status = everyone.join(problems, "accession", "left").join(contig_sources.left_out(hits), "accession", "left")
        noted = F.when(F.col("n_left_out") > 0, F.concat(F.lit("done, "), F.col("n_left_out"), F.lit(" rows left out"))).otherwise(F.lit("done"))
        status.select("accession", F.coalesce("problem", noted).alias("status")).coalesce(1).write.parquet(f"{at}/status")
        failed = problems.select("accession")
        texts, hits = texts.join(failed, "accession", "left_anti"), contig_sources.usable(hits, most).join(failed, "accession", "left_anti")
        with_contigs = texts.filter("matched").select("accession").distinct()
        made = [
            annotation.annotate_sketched(texts.filter("matched IS NULL"), idx),
            annotation.annotate(hits.join(with_contigs, "accession", "left_semi"), idx, texts.filter("matched")),
            annotation.annotate(hits.join(with_contigs, "accession", "left_anti"), idx),
        ]
        sinks.write_partitioned(union_all(made, made[0]), f"{at}/counts", "accession")
        for name in ("_contigs", "_matches"):
            remove(spark, f"{at}/{name}")
    return spark.read.schema(schemas.CONTIG_COUNTS).parquet(f"{out}/counts")
