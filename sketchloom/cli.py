"""Command line: one command for each job."""

from __future__ import annotations

import argparse
import json
import sys
import time

from sketchloom import schemas
from sketchloom.functions import report
from sketchloom.plans import jobs
from sketchloom.session import build_session
from sketchloom.sources.contigs import accession_of
from sketchloom.sources.files import run_id, write_json


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sketchloom")
    top.add_argument("--master")
    top.add_argument("--shuffle-partitions", type=int)
    top.add_argument("--max-partition-bytes")
    top.add_argument("--driver-memory")
    top.add_argument("--executor-memory")
    top.add_argument("--summary", action="store_true", help="also say in words, on standard error, what came out")
    top.add_argument("--log-dir", help="folder that gets a JSON file about each run")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *required: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        p.add_argument("--overwrite", action="store_true")
        return p

    p = command("top-minhashes", "counts by hash, top N, and their samples", "input", "out")
    p.add_argument("--stage", nargs="+", choices=["all", "counts", "topn", "ids"], default=["all"], help="one or more stages, which run in that order")
    p.add_argument("--topN", type=int, default=100)
    p.add_argument("--num-buckets", type=int, default=512)
    p.add_argument("--ksize", type=int)
    p.add_argument("--sample-fraction", type=float)
    p.add_argument("--file-limit", type=int)
    p.add_argument("--seed", type=int, default=1337)
    p.add_argument("--compress-json", action="store_true")
    p.add_argument("--coalesce-json", type=int, default=1)
    p.add_argument("--run-tag")
    p.add_argument("--keep-success", action="store_true", help="keep marker files beside renamed JSON")
    p.add_argument("--no-cleanup", action="store_true", help="leave JSON parts as they were written")
    p.add_argument("--skip-distinct-pairs-in-ids", action="store_true")

    p = command("left-minus-rights", "hashes of one set that no other has", "manifest", "out-dir")
    p.add_argument("--ksize", type=int, default=schemas.KSIZE)
    p.add_argument("--filter-left", action="store_true")
    p.add_argument("--buckets", type=int, default=256)
    p.add_argument("--single-file", action="store_true")
    p.add_argument("--distinct-left", action="store_true")
    p.add_argument("--negatives", help="where the hashes of all right sets are kept")
    p.add_argument("--skip-build-neg", action="store_true", help="use the negative set that is there, if it was built from the same sets alike")
    p.add_argument("--files-per-bucket", type=int, help="several files for a bucket that is too large for one task")
    p.add_argument("--sample-fraction", type=float, default=1.0)

    p = command("alias-vs-others", "Venn counts of one set against the others", "manifest", "target-alias")
    p.add_argument("--out")
    p.add_argument("--ksize", type=int, default=schemas.KSIZE)
    p.add_argument("--buckets", type=int, default=256)
    p.add_argument("--sample-fraction", type=float, default=1.0)

    p = command("prepare-hashes", "a table of hashes from a Hive-partitioned dataset", "hash-parquet-root", "out")
    p.add_argument("--hash-glob", default="bucket=*")
    p.add_argument("--column", default="hash")
    p.add_argument("--deduplicate-hashes", action="store_true")
    p.add_argument("--preview-out")

    p = command("compute-counts", "samples by hash and hashes by sample", "hashes", "signatures", "out-dir")
    p.add_argument("--ksize", type=int, required=True)
    p.add_argument("--materialize-pairs", action="store_true")
    p.add_argument("--pairs-out")

    p = command("percentiles", "cutpoints and what lies between them", "out-dir")
    p.add_argument("--counts-source", choices=["hash", "sample"], required=True)
    p.add_argument("--counts-path")
    p.add_argument("--percentiles", type=float, nargs=2, metavar=("LO", "HI"))
    p.add_argument("--low-cut", type=float)
    p.add_argument("--high-cut", type=float)
    p.add_argument("--signatures")
    p.add_argument("--map-out")
    p.add_argument("--ksize", type=int, default=schemas.KSIZE)
    p.add_argument("--pairs-shards", type=int, default=128)
    p.add_argument("--pairs-file-prefix", help="name shards <prefix>0000.parquet and so on; otherwise they are folders shard=N")
    p.add_argument("--pairs-row-group-size", type=int, default=1_000_000)
    p.add_argument("--pairs-shard-key", choices=["hash", "sample"], default="hash")
    p.add_argument("--pairs-as-lists", action="store_true")
    p.add_argument("--pairs-sort-lists", action="store_true")
    p.add_argument("--repeated-pairs", action="store_true", help="count repeated pairs as often as they occur")
    p.add_argument("--sample-list-out")

    p = command("inspect", "counts and first rows of the inputs", "hashes", "signatures")
    p.add_argument("--ksize", type=int, required=True)

    p = command("remove-set", "lists without the hashes of one more set", "input-dir", "exclude", "output-parquet")
    p.add_argument("--ksize", type=int, default=schemas.KSIZE)
    p.add_argument("--table", default="unique_hashes")
    p.add_argument("--hash-column", default="hash")

    p = command("count", "rows or distinct hashes", "input")
    p.add_argument("--column", default="hash")
    p.add_argument("--distinct", action="store_true")

    p = command("sort", "a dataset in order of its hashes", "input", "out")
    p.add_argument("--column", default="hash")
    p.add_argument("--table")

    p = command("histogram", "histogram of counts", "input", "output")
    p.add_argument("-b", "--bins", type=int, default=100)
    p.add_argument("-m", "--max-value", type=float)
    p.add_argument("--column", default="sample_count")
    p.add_argument("--picture", help="also draw it, as <picture>.svg and <picture>_log.svg")

    p = command("build-index", "a sharded index of hashes", "parquet", "index-root")
    p.add_argument("--shard-bits", type=int, default=schemas.SHARD_BITS)
    p.add_argument("--column", default="min_hash")
    p.add_argument("--distinct", action="store_true", help="each hash once")
    p.add_argument("--layout", choices=["buckets", "shards"], default="buckets", help="a bucketed table, which look-ups read in place, or folders by bits of the hash")

    p = command("annotate", "novel k-mers of contigs", "index-root", "out")
    p.add_argument("--contigs-url", help="address of an accession's contigs, with {acc}")
    p.add_argument("--contigs", nargs="*", metavar="[ACC=]PATH", help="FASTA by accession, which is else taken from the file's name")
    p.add_argument("--matches", nargs="*", metavar="[ACC=]PATH", help="k-mer CSVs by accession")
    p.add_argument("--accession-table", help="Parquet with a column accession, beside those given here")
    p.add_argument("accessions", nargs="*")
    return top


def by_accession(given: list[str] | None) -> dict[str, list[str]]:
    """Paths by accession, which stands before an equals sign or is part of the path."""
    found: dict[str, list[str]] = {}
    for item in given or []:
        name, sign, path = item.partition("=")
        if not sign or "/" in name:
            name, path = accession_of(item), item
        found.setdefault(name, []).append(path)
    return found


def check(args: argparse.Namespace, fail) -> None:
    """Rules between options."""
    if args.command == "left-minus-rights" and args.skip_build_neg and not args.negatives:
        fail("--skip-build-neg needs --negatives")
    if args.command == "percentiles":
        manual = args.low_cut is not None or args.high_cut is not None
        if manual == bool(args.percentiles):
            fail("give either --percentiles or --low-cut and --high-cut")
        if manual and (args.low_cut is None or args.high_cut is None):
            fail("--low-cut and --high-cut go together")
        if args.map_out and not args.signatures:
            fail("--map-out needs --signatures")


def run(spark, a: argparse.Namespace):
    c = a.command
    if c == "top-minhashes":
        stages = tuple(s for s in ("counts", "topn", "ids") if "all" in a.stage or s in a.stage)
        return jobs.top_minhashes(spark, a.input, a.out, stages=stages, n=a.topN, buckets=a.num_buckets, ksize=a.ksize, fraction=a.sample_fraction, file_limit=a.file_limit, seed=a.seed, compress=a.compress_json, json_parts=a.coalesce_json, tag=a.run_tag, skip_distinct=a.skip_distinct_pairs_in_ids, rename=not a.no_cleanup, keep_markers=a.keep_success, overwrite=a.overwrite)
    if c == "left-minus-rights":
        return jobs.left_minus_rights(spark, a.manifest, a.out_dir, ksize=a.ksize, filter_left=a.filter_left, distinct_left=a.distinct_left, fraction=a.sample_fraction, buckets=a.buckets, single_file=a.single_file, files=a.files_per_bucket, negatives=a.negatives, skip_build=a.skip_build_neg, overwrite=a.overwrite)
    if c == "alias-vs-others":
        return jobs.alias_vs_others(spark, a.manifest, a.target_alias, out=a.out, ksize=a.ksize, fraction=a.sample_fraction, buckets=a.buckets, overwrite=a.overwrite)
    if c == "prepare-hashes":
        return jobs.prepare_hashes(spark, a.hash_parquet_root, a.out, pattern=a.hash_glob, column=a.column, deduplicate=a.deduplicate_hashes, preview=a.preview_out, overwrite=a.overwrite)
    if c == "compute-counts":
        return jobs.compute_counts(spark, a.hashes, a.signatures, a.ksize, a.out_dir, materialize_pairs=a.materialize_pairs, pairs_out=a.pairs_out, overwrite=a.overwrite)
    if c == "percentiles":
        cuts = None if a.percentiles else (a.low_cut, a.high_cut)
        return jobs.percentiles(spark, a.counts_source, a.out_dir, counts_path=a.counts_path, percentiles=tuple(a.percentiles) if a.percentiles else None, cuts=cuts, signatures=a.signatures, map_out=a.map_out, ksize=a.ksize, shards=a.pairs_shards, shard_key=a.pairs_shard_key, row_group_rows=a.pairs_row_group_size, prefix=a.pairs_file_prefix, as_lists=a.pairs_as_lists, sort_lists=a.pairs_sort_lists, distinct_pairs=not a.repeated_pairs, sample_list_out=a.sample_list_out, overwrite=a.overwrite)
    if c == "inspect":
        return jobs.inspect(spark, a.hashes, a.signatures, a.ksize)
    if c == "remove-set":
        return jobs.remove_set(spark, a.input_dir, a.exclude, a.output_parquet, table=a.table, ksize=a.ksize, hash_column=a.hash_column, overwrite=a.overwrite)
    if c == "count":
        return jobs.row_counts(spark, a.input, a.column, a.distinct)
    if c == "sort":
        return jobs.sorted_copy(spark, a.input, a.out, column=a.column, table=a.table, overwrite=a.overwrite)
    if c == "histogram":
        return jobs.histogram_job(spark, a.input, a.output, column=a.column, bins=a.bins, max_value=a.max_value, picture=a.picture, overwrite=a.overwrite)
    if c == "build-index":
        return jobs.build_index_job(spark, a.parquet, a.index_root, bits=a.shard_bits, column=a.column, layout=a.layout, distinct=a.distinct, overwrite=a.overwrite)
    asked = a.accessions
    if a.accession_table:
        asked = spark.read.parquet(a.accession_table).select("accession").union(spark.createDataFrame([(x,) for x in a.accessions], "accession string"))
    jobs.annotate(spark, a.index_root, a.out, asked, url=a.contigs_url, contigs=by_accession(a.contigs), matches=by_accession(a.matches), overwrite=a.overwrite)
    return {"out": a.out}


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    check(args, top.error)
    spark = build_session(master=args.master, shuffle_partitions=args.shuffle_partitions, max_partition_bytes=args.max_partition_bytes, driver_memory=args.driver_memory, executor_memory=args.executor_memory)
    began, error, result = time.time(), None, None
    try:
        result = run(spark, args)
        print(json.dumps(result, default=str))
    except (ValueError, OSError) as e:
        error = str(e)
        print(f"{args.command}: {e}", file=sys.stderr)
    seconds = time.time() - began
    if args.summary and error is None:
        print("\n".join(report.summary(args.command, result, seconds)), file=sys.stderr)
    if args.log_dir:
        at = run_id()
        write_json(spark, f"{args.log_dir}/{args.command}-{at}.json", {"command": args.command, "options": {k: v for k, v in vars(args).items() if k != "command"}, "ended": at, "seconds": round(seconds, 3), "result": json.loads(json.dumps(result, default=str)), "error": error})
    return 0 if error is None else 2


if __name__ == "__main__":
    sys.exit(main())
