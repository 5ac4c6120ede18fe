"""Sources, sinks and whole jobs on files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom import cli
from sketchloom.functions import report
from sketchloom.plans import jobs
from sketchloom.sources import contigs, files, manifest, sinks
from sketchloom.sources.datasets import read_hive_hashes, read_signatures
from sketchloom.streaming.increments import current_counts, follow_signatures


@pytest.fixture()
def at(tmp_path):
    return f"file://{tmp_path}"


@pytest.fixture()
def sets(spark, at):
    spark.createDataFrame([(1, 31), (2, 31), (3, 31), (3, 31)], "hash bigint, ksize int").write.parquet(f"{at}/q")
    spark.createDataFrame([(2, 31), (3, 21)], "hash bigint, ksize int").write.parquet(f"{at}/k1")
    spark.createDataFrame([(9,)], "h bigint").write.parquet(f"{at}/k2/main/others")
    return {"databases": [
        {"alias": "query", "path": f"{at}/q", "table": "sigs.hashes", "column": "hash", "set_id": "left"},
        {"alias": "known1", "path": f"{at}/k1", "table": "hashes", "column": "hash", "set_id": "right", "ksize": "ksize"},
        {"alias": "known2", "path": f"{at}/k2", "table": "db.main.others", "column": "h", "set_id": "right"},
    ]}


def test_left_minus_rights(spark, at, sets):
    out = jobs.left_minus_rights(spark, sets, f"{at}/out")
    assert sorted(r["min_hash"] for r in read_hive_hashes(spark, out).collect()) == [1, 3, 3]
    with pytest.raises(files.OutputExists):
        jobs.left_minus_rights(spark, sets, f"{at}/out")
    jobs.left_minus_rights(spark, sets, f"{at}/out", overwrite=True, single_file=True, distinct_left=True)
    assert [r[0] for r in spark.read.parquet(f"{at}/out").collect()] == [1, 3]
    assert jobs.row_counts(spark, f"{at}/out") == jobs.row_counts(spark, f"{at}/out", distinct=True) == 2


def test_alias_vs_others(spark, at, sets):
    got = jobs.alias_vs_others(spark, sets, "known1", out=f"{at}/csv")
    assert (got["target_only"], got["intersection"], got["others_only"], got["target_total"]) == (0, 1, 3, 1)
    assert spark.read.option("header", True).csv(f"{at}/csv").first()["others_only"] == "3"
    with pytest.raises(manifest.ManifestError):
        jobs.alias_vs_others(spark, sets, "nobody")


def test_manifest_of_other_things(spark):
    for bad in ({"databases": ["x"]}, {"databases": []}, {"databases": {}}, {}, []):
        with pytest.raises(manifest.ManifestError):
            manifest.load_manifest(spark, bad)


def test_stages_of_the_command_line():
    args = cli.parser().parse_args(["top-minhashes", "--input", "a", "--out", "b", "--stage", "topn", "ids"])
    assert args.stage == ["topn", "ids"]


@pytest.mark.parametrize("change", [{"alias": ""}, {"set_id": "middle"}, {"path": "file:///nowhere"}, {"alias": "known1"}, {"set_id": "right"}])
def test_bad_manifest(spark, sets, change):
    sets["databases"][0] |= change
    with pytest.raises(manifest.ManifestError):
        manifest.load_manifest(spark, sets)


def test_manifest_file(spark, at, sets, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(sets))
    got = manifest.load_manifest(spark, f"{at}/m.json")
    assert [s.alias for s in got] == ["query", "known1", "known2"] and manifest.split_table("a.b.c") == ("b", "c") and manifest.split_table("t") == ("main", "t")
    manifest.register(spark, got)
    assert spark.table("known2").count() == 1


@pytest.fixture()
def signatures(spark, at):
    rows = [("s1", 7, 31), ("s1", 7, 31), ("s2", 7, 31), ("s3", 8, 31), ("s1", 9, 21), (None, 7, 31), ("s1", None, 31)]
    spark.createDataFrame(rows, "sample_id string, min_hash bigint, ksize int").repartition(3).write.partitionBy("ksize").parquet(f"{at}/sig")
    return f"{at}/sig"


def test_read_signatures(spark, signatures):
    assert read_signatures(spark, signatures, ksize=31).count() == 4
    assert "ksize" in read_signatures(spark, signatures, file_limit=1).columns
    with pytest.raises(ValueError):
        read_signatures(spark, f"{signatures}/ksize=31", ksize=31)
    with pytest.raises(ValueError):
        read_signatures(spark, signatures, sample_fraction=2)


def test_top_minhashes(spark, at, signatures):
    made = jobs.top_minhashes(spark, signatures, f"{at}/top", n=1, ksize=31, tag="a")
    assert made["topn_json"].endswith("/top1.json")
    row = json.loads(spark.read.text(made["ids"]).first()[0])
    assert row == {"min_hash": 7, "n_samples": 2, "sample_ids": ["s1", "s2"], "n_samples_exact": 2}
    again = jobs.top_minhashes(spark, signatures, f"{at}/top", n=1, ksize=31, tag="b", stages=("topn",), compress=True)
    assert again["topn_json"].endswith(".json.gz")
    with pytest.raises(ValueError):
        jobs.top_minhashes(spark, signatures, f"{at}/top", n=1, ksize=21, stages=("topn",))
    plain = jobs.top_minhashes(spark, signatures, f"{at}/top", n=1, ksize=31, tag="c", stages=("topn",), rename=False)
    assert plain["topn_json"].endswith("run=c") and any(p.endswith("_SUCCESS") for p in files.children(spark, plain["topn_json"]))
    later = jobs.top_minhashes(spark, signatures, f"{at}/top", n=1, ksize=31, stages=("ids",), json_parts=2)
    assert spark.read.json(later["ids"]).count() == 1


def test_counts_and_percentiles(spark, at, signatures):
    spark.createDataFrame([(7, 1), (8, 0), (7, 1)], "hash bigint, bucket int").write.partitionBy("bucket").parquet(f"{at}/h")
    hashes = jobs.prepare_hashes(spark, f"{at}/h", f"{at}/table", deduplicate=True, preview=f"{at}/preview")
    assert [r[0] for r in spark.read.parquet(hashes).orderBy("min_hash").collect()] == [7, 8]
    paths = jobs.compute_counts(spark, hashes, signatures, 31, f"{at}/c", materialize_pairs=True)
    assert {tuple(r) for r in spark.read.parquet(paths["hash"]).collect()} == {(7, 2), (8, 1)}
    assert spark.read.parquet(paths["pairs"]).count() == 3
    cut = jobs.percentiles(spark, "hash", f"{at}/c", cuts=(2, 10), signatures=signatures, map_out=f"{at}/lists", shards=4)
    assert cut["low_cut"] == 2.0 and files.read_json(spark, f"{at}/c/hash_percentiles.json") == cut
    assert [(r["min_hash"], r["sample_ids"], r["shard"]) for r in spark.read.parquet(f"{at}/lists").collect()] == [(7, ["s1", "s2"], 3)]
    jobs.percentiles(spark, "hash", f"{at}/c", percentiles=(0, 1), signatures=signatures, map_out=f"{at}/flat", shards=2, shard_key="sample", as_lists=False, overwrite=True)
    assert spark.read.parquet(f"{at}/flat").count() == 3
    jobs.percentiles(spark, "sample", f"{at}/c", cuts=(1, 1), sample_list_out=f"{at}/samples")
    assert sorted(r[0] for r in spark.read.parquet(f"{at}/samples").collect()) == ["s1", "s2", "s3"]
    spark.createDataFrame([(7, 31), (8, 21)], "hash bigint, ksize int").write.parquet(f"{at}/db/unique_hashes")
    assert jobs.remove_set(spark, f"{at}/lists", f"{at}/db", f"{at}/rest") == {"excluded_set": 1, "rows": 0, "warning": ""}
    stats = jobs.histogram_job(spark, paths["hash"], f"{at}/hist", bins=2)
    assert stats["total"] == 2
    seen = jobs.inspect(spark, hashes, f"{at}/nowhere", 31)
    assert seen["hashes"]["rows"] == 2 and "error" in seen["signatures"]


def test_single_part_refuses_more(spark, at):
    spark.range(10).repartition(2).write.json(f"{at}/two")
    with pytest.raises(ValueError):
        files.single_part(spark, f"{at}/two", "x")
    assert len([p for p in files.children(spark, f"{at}/two") if "part-" in p]) == 2


def test_sorted_copy(spark, at):
    sinks.write_partitioned(spark.createDataFrame([(i * 37 % 101, i % 2) for i in range(100)], "hash bigint, bucket int"), f"{at}/b", "bucket")
    rows = [r[0] for r in spark.read.parquet(jobs.sorted_copy(spark, f"{at}/b", f"{at}/s")).collect()]
    assert sorted(rows) == sorted(i * 37 % 101 for i in range(100))
    jobs.sorted_copy(spark, f"{at}/b", "", table="sorted_hashes", overwrite=True)
    assert spark.table("sorted_hashes").count() == 100


FASTA = ">c1 first\nacgtACGTacgtACGTacgtACGTacgt\nACGTacgtAAACCC\n>c2\nACG\n>c3 x\nNNNN\n"


def test_fasta_and_annotation(spark, at, tmp_path):
    import zstandard

    (tmp_path / "acc1.fa").write_text(FASTA)
    (tmp_path / "acc2.contigs.fa.zst").write_bytes(zstandard.compress(FASTA.encode()))
    got = contigs.read_fasta(spark, f"{at}/acc1.fa", f"{at}/acc2.contigs.fa.zst")
    rows = {(r["accession"], r["contig"]): (r["sequence"], r["contig_length"]) for r in got.collect()}
    assert len(rows) == 6 and rows["acc1", "c1"] == rows["acc2", "c1"] == ("ACGT" * 9 + "AAACCC", 42) and rows["acc1", "c2"] == ("ACG", 3)
    most = (1 << 63) - 1
    from sketchloom.functions.kmers import sketch_bytes

    h = sketch_bytes("ACGT" * 9 + "AAACCC", 31, most)
    spark.createDataFrame([(int(x),) for x in set(h.tolist())][:3], "min_hash bigint").write.parquet(f"{at}/novel")
    known = {r[0] for r in spark.read.parquet(f"{at}/novel").collect()}
    for layout in ("buckets", "shards"):
        jobs.build_index_job(spark, f"{at}/novel", f"{at}/index", bits=2, layout=layout, overwrite=True)
        made = jobs.annotate(spark, f"{at}/index", f"{at}/ann", ["acc1", "acc2", "gone"], contigs=[f"{at}/acc1.fa"], url=f"{at}/{{acc}}.contigs.fa.zst", most=most, overwrite=True)
        counted = {(r["accession"], r["contig"]): (r["contig_length"], r["candidate_hashes"], r["novel_hashes"]) for r in made.collect()}
        assert counted["acc1", "c1"] == counted["acc2", "c1"] == (42, len(h), sum(int(x) in known for x in h.tolist())) and counted["acc1", "c2"] == (3, 0, 0)
        status = {r["accession"]: r["status"] for r in spark.read.parquet(f"{at}/ann/status").collect()}
        assert status["acc1"] == status["acc2"] == "done" and status["gone"].startswith("no file")


def test_accessions_stay_apart(spark, at, tmp_path):
    for name, text in (("A1", ">c1\nACGT\n"), ("B2", ">c1\nAC\n>c2\nA\n"), ("S1.v2", ">c1\nACGTA\n")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "contigs.fa").write_text(text)
    (tmp_path / "S1.v3.contigs.fa").write_text(">c9\nA\n")
    (tmp_path / "S1.v4.contigs.fa.gz").write_bytes(b"junk")
    spark.createDataFrame([("c7", 5), ("c7", 6)], "name string, hashval bigint").repartition(2).write.option("header", True).csv(f"{at}/M1.kmer-matches.csv")
    spark.createDataFrame([(5,)], "min_hash bigint").write.parquet(f"{at}/five")
    jobs.build_index_job(spark, f"{at}/five", f"{at}/index", bits=1)
    asked = spark.createDataFrame([("A1",), ("B2",), ("S1.v2",), ("A1",)], "accession string")
    made = jobs.annotate(spark, f"{at}/index", f"{at}/out", asked, url=f"{at}/in/{{acc}}/contigs.fa", contigs=[f"{at}/S1.v3.contigs.fa", f"{at}/S1.v4.contigs.fa.gz"], matches=[f"{at}/M1.kmer-matches.csv"])
    got = sorted(tuple(r)[:5] for r in made.select("accession", "contig", "contig_length", "candidate_hashes", "novel_hashes").collect())
    assert got == [("A1", "c1", 4, 0, 0), ("B2", "c1", 2, 0, 0), ("B2", "c2", 1, 0, 0), ("M1", "c7", -1, 2, 1), ("S1.v2", "c1", 5, 0, 0), ("S1.v3", "c9", 1, 0, 0)]
    status = {r["accession"]: r["status"].split(":")[0] for r in spark.read.parquet(f"{at}/out/status").collect()}
    assert status == {"A1": "done", "B2": "done", "S1.v2": "done", "S1.v3": "done", "S1.v4": "not readable", "M1": "done"}


def test_names_of_accessions():
    for path, name in {"/x/acc1.fa": "acc1", "s3://b/acc2.contigs.fa.zst": "acc2", "S1.v2.contigs.fa": "S1.v2", "a.b.csv": "a.b", "M.kmer-matches.csv/": "M", "plain": "plain", "q.fasta.gz": "q", ".fa": ".fa"}.items():
        assert contigs.accession_of(path) == name
    assert cli.by_accession(["A=/x/y.fa", "A=/x/z.fa", "/d=1/B.fa"]) == {"A": ["/x/y.fa", "/x/z.fa"], "B": ["/d=1/B.fa"]}


def test_jobs_do_not_grow_with_files(spark, at):
    counts = []
    for n in (2, 12):
        for i in range(n):
            spark.createDataFrame([(f"c{i}", 5)], "name string, hashval bigint").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{at}/m{n}/a{i}")
        group = f"files-{n}"
        spark.sparkContext.setJobGroup(group, group)
        rows = contigs.read_match_rows(contigs.addresses(spark, [f"{at}/m{n}/a{i}" for i in range(n)])).collect()
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        assert {(r["accession"], r["contig"], r["hash"]) for r in rows} == {(f"a{i}", f"c{i}", 5) for i in range(n)}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_one_bad_file_does_not_stop_the_others(spark, at, tmp_path):
    import gzip

    import zstandard

    packed, rng = zstandard.compress(FASTA.encode() * 50), "".join(np.random.default_rng(0).choice(list("ACGT"), 3000))
    (tmp_path / "good.contigs.fa.zst").write_bytes(packed + packed)
    (tmp_path / "cut.contigs.fa.zst").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "junk.contigs.fa.zst").write_bytes(b"junk" * 30)
    (tmp_path / "zip.fa.gz").write_bytes(gzip.compress(f">z\n{rng}\n".encode()))
    (tmp_path / "badzip.fa.gz").write_bytes(gzip.compress(f">z\n{rng}\n".encode())[:200])
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    (tmp_path / "both.csv").write_text("name,hashval\nc1,5\nc1,x\n,4\nc9,7\n")
    (tmp_path / "both.fa").write_text(">c1\nACGT\n>c2\nAC\n")
    (tmp_path / "alone.csv").write_text("sequence,hash\nc1,5\nc1,6\n")
    spark.createDataFrame([(5,), (5,)], "min_hash bigint").write.parquet(f"{at}/five")
    jobs.build_index_job(spark, f"{at}/five", f"{at}/index5", bits=2, distinct=True)

    def opener(address, tried=str(tmp_path / "tried")):
        with open(tried, "a") as f:
            f.write(f"{address}\n")
        if "far" in address:
            raise OSError("no network")
        return open(address.removeprefix("file://"), "rb")

    made = jobs.annotate(
        spark, f"{at}/index5", f"{at}/ann5", ["good", "cut", "junk", "far", "nothing"], url=f"{at}/{{acc}}.contigs.fa.zst", opener=opener,
        contigs=[f"{at}/zip.fa.gz", f"{at}/badzip.fa.gz", f"{at}/both.fa"], matches=[f"{at}/both.csv", f"{at}/alone.csv", f"{at}/bad.csv"],
    )
    got = {(r["accession"], r["contig"]): (r["contig_length"], r["candidate_hashes"], r["novel_hashes"]) for r in made.collect()}
    assert {a for a, _ in got} == {"good", "zip", "both", "alone"}
    assert got["both", "c1"] == (4, 1, 1) and got["both", "c2"] == (2, 0, 0) and got["alone", "c1"] == (-1, 2, 1) and got["good", "c1"][0] == 42 * 100 and got["zip", "z"][0] == 3000
    status = {r["accession"]: r["status"] for r in spark.read.parquet(f"{at}/ann5/status").collect()}
    assert [status[a] for a in ("good", "zip", "both", "alone")] == ["done", "done", "done, 2 rows left out", "done"]
    assert all(status[a].startswith("not readable") for a in ("cut", "junk", "badzip", "bad")) and status["far"].startswith("fetch failed") and status["nothing"].startswith("no file")
    assert sum("far" in line for line in (tmp_path / "tried").read_text().splitlines()) == 3
    none = jobs.annotate(spark, f"{at}/index5", f"{at}/ann6", ["nowhere"])
    assert none.count() == 0 and spark.read.parquet(f"{at}/ann6/status").first()["status"].startswith("no contigs")
    with pytest.raises(Exception, match="frame|Zstd|zstd"):
        contigs.read_fasta(spark, f"{at}/cut.contigs.fa.zst").count()


def test_stream_that_breaks_off_goes_on(tmp_path):
    import io

    import pyarrow as pa

    whole, opened = FASTA.encode() * 40_000, []

    class Breaking(io.BytesIO):
        def read(self, n=-1):
            if len(opened) == 1 and self.tell() > 2 << 20:
                raise OSError("reset")
            return super().read(n)

    def opener(address):
        opened.append(address)
        return Breaking(whole)

    kinds = [("accession", pa.string()), ("contig", pa.string()), ("sequence", pa.string()), ("problem", pa.string())]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["x.fa"])], ["accession", "address"])
    rows = pa.Table.from_batches(contigs._read(contigs._contigs, kinds, opener, 3)(iter([batch])))
    assert len(opened) == 2 and rows.num_rows == 120_000 and rows["problem"].null_count == 120_000


def test_large_files_in_bounded_memory(tmp_path):
    """A file that unpacks to over 2 GB is read in batches of a few MB."""
    import subprocess
    import sys
    import textwrap
    from pathlib import Path

    import zstandard

    path = tmp_path / "large.contigs.fa.zst"
    unit = b"".join(b">c%d\n" % i + b"ACGT" * 262_144 + b"\n" for i in range(64))
    with open(path, "wb") as f:
        for _ in range(34):
            f.write(zstandard.compress(unit, 1))
    assert len(unit) * 34 > 1 << 31
    code = f"""
        import resource
        import pyarrow as pa
        from sketchloom.sources import contigs, streams
        kinds = [(n, pa.string()) for n in ("accession", "contig", "sequence", "problem")]
        batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([{str(path)!r}])], ["accession", "address"])
        n = sum(b.num_rows - b["problem"].is_valid().sum().as_py() for b in contigs._read(contigs._contigs, kinds, streams.open_address, 1)(iter([batch])))
        print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], check=True).stdout.split()
    assert int(out[-2]) == 34 * 64 and int(out[-1]) < 700


def test_named_shards(spark, at):
    df = spark.createDataFrame([(1, "a"), (9, "b"), (2, "c")], "min_hash bigint, sample_id string")
    sinks.write_shards(df, f"{at}/named", 4, "min_hash", prefix="lists_")
    assert [p.rsplit("/", 1)[-1] for p in files.children(spark, f"{at}/named") if not p.endswith("_SUCCESS")] == [f"lists_{i:04d}.parquet" for i in range(4)]
    got = {(r[0], r[1].rsplit("_", 1)[1][:4]) for r in spark.read.parquet(f"{at}/named/lists_*.parquet").selectExpr("min_hash", "input_file_name()").collect()}
    assert got == {(1, "0001"), (9, "0001"), (2, "0002")} and spark.read.parquet(f"{at}/named/lists_0003.parquet").columns == df.columns


def test_report_columns(spark):
    numbers = [0, 5, 59, 60, 61, 1023, 1024, 1536, 3599, 3600, 3725, 1234567, 1 << 33, 1 << 45, 1 << 52]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", report.number_column(F.col("n")), report.size_column(F.col("n")), report.duration_column(F.col("n").cast("double"))).collect()
    for n, *shown in rows:
        assert shown[:2] == [report.number(n), report.size(n)] and shown[2].replace(",", "") == report.duration(n)


def test_reports():
    assert [report.number(1234567), report.number(0.25), report.duration(3.25), report.duration(75), report.duration(3725.4), report.size(10), report.size(1536), report.size(1 << 60)] == ["1,234,567", "0.25", "3.2 s", "1 min 15 s", "1 h 2 min 5 s", "10 B", "1.5 KiB", "1024.0 PiB"]
    assert report.summary("count", {"rows_read": 2000, "warning": ""}, 1) == ["rows read: 2,000", "count took 1.0 s"]


def test_matches(spark, at, tmp_path):
    (tmp_path / "acc1.csv").write_text("name,hash,more\nc1,5,x\nc1,bad,x\nc2,-1,x\n,7,x\nc2,6,x\n")
    got = contigs.read_matches(spark, f"{at}/acc1.csv")
    assert {tuple(r) for r in got.collect()} == {("acc1", "c1", 5), ("acc1", "c2", 6)}
    rows = contigs.read_match_rows(contigs.addresses(spark, [f"{at}/acc1.csv"]))
    assert [tuple(r) for r in contigs.left_out(rows).collect()] == [("acc1", 2)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="no sequence or hash column"):
        contigs.read_matches(spark, f"{at}/bad.csv").collect()
    (tmp_path / "wide.csv").write_text(f"name,hash\n\"a,\"\"b\",{(1 << 64) - 1}\nc,{1 << 64}\n")
    wide = contigs.read_match_rows(contigs.addresses(spark, {"w": f"{at}/wide.csv"})).collect()
    assert [(r["contig"], r["hash"], r["problem"]) for r in wide] == [('a,"b', -1, None), (None, None, contigs.LEFT_OUT)]


def test_increments(spark, at, signatures):
    spark.read.parquet(signatures).select("sample_id", "min_hash", "ksize").write.parquet(f"{at}/in")
    for _ in range(2):
        query = follow_signatures(spark, f"{at}/in", f"{at}/pairs", f"{at}/state")
        query.awaitTermination()
        spark.createDataFrame([("s9", 7, 31), ("s1", 7, 31)], "sample_id string, min_hash bigint, ksize int").write.mode("append").parquet(f"{at}/in")
    assert {tuple(r) for r in current_counts(spark, f"{at}/pairs")[0].collect()} == {(7, 3), (8, 1)}


def test_cli(spark, at, sets, tmp_path, capsys):
    (tmp_path / "m.json").write_text(json.dumps(sets))
    assert cli.main(["left-minus-rights", "--manifest", f"{at}/m.json", "--out-dir", f"{at}/cli"]) == 0
    assert cli.main(["left-minus-rights", "--manifest", f"{at}/m.json", "--out-dir", f"{at}/cli"]) == 2
    assert cli.main(["--log-dir", f"{at}/logs", "--summary", "count", "--input", f"{at}/cli"]) == 0
    (log,) = [p for p in files.children(spark, f"{at}/logs") if p.endswith(".json")]
    assert files.read_json(spark, log)["result"] == 3
    assert capsys.readouterr().out.strip().splitlines()[-1] == "3"
    for bad in (["--percentiles", "0.1", "0.2", "--low-cut", "1"], [], ["--low-cut", "1"]):
        with pytest.raises(SystemExit):
            cli.main(["percentiles", "--out-dir", at, "--counts-source", "hash", *bad])
