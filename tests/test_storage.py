"""What stays where it is, what isn't read, and what is put in place only when it is complete."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sketchloom import cli
from sketchloom.functions.kmers import md5_hashes
from sketchloom.operators import annotate, counts, index, negatives
from sketchloom.plans import jobs
from sketchloom.sources import bucketed, files, manifest, sinks
from sketchloom.sources.datasets import footer_statistics, read_hive_hashes, row_groups


@pytest.fixture()
def at(tmp_path):
    return f"file://{tmp_path}"


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that came out of the scans below, when the plan is run."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            rows.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def values(spark, n):
    return spark.range(n).select((F.col("id") * 7919 % 1_000_003).alias("min_hash"))


def test_bucketed_index_stays_in_place(spark, at, no_broadcast):
    meta = index.build_index(values(spark, 5000).union(values(spark, 100)), f"{at}/i", bits=3, layout=index.BUCKETS)
    assert (meta["total_rows"], meta["shards"], meta["shard_strategy"]) == (5100, 8, "hash")
    found = index.Index(spark, f"{at}/i")
    asked = spark.range(3000).select((F.col("id") * 3).alias("min_hash")).union(spark.createDataFrame([(None,)] * 3, "min_hash bigint"))
    got = found.probe(asked)
    text = plan(got)
    # the one exchange is that of the asked side, which stands first
    assert text.count("Exchange") == 1 and text.index("Exchange") < text.index("Bucketed: true") and "SelectedBucketsCount: 8 out of 8" in text
    known = {r[0] for r in values(spark, 5000).collect()}
    rows = got.collect()
    assert len(rows) == 3003 and all(r["hit"] == (r["min_hash"] in known) for r in rows)
    # joins by the key of two such tables move nothing
    index.build_index(values(spark, 700), f"{at}/j", bits=3, layout=index.BUCKETS)
    both = found.rows.select("min_hash").join(index.Index(spark, f"{at}/j").rows.select("min_hash"), "min_hash")
    assert "Exchange" not in plan(both) and both.count() == 700


def test_bucketed_index_by_another_session(spark, at):
    index.build_index(values(spark, 1000), f"{at}/i", bits=2, layout=index.BUCKETS)
    other = spark.newSession()
    asked = other.createDataFrame([(7919,), (1,)], "min_hash bigint")
    assert {tuple(r) for r in index.Index(other, f"{at}/i").probe(asked).collect()} == {(7919, True), (1, False)}
    index.build_index(values(spark, 10), f"{at}/i", bits=1, layout=index.BUCKETS, overwrite=True)
    assert index.Index(spark, f"{at}/i").rows.count() == 10
    with pytest.raises(ValueError):
        index.build_index(values(spark, 1), f"{at}/k", layout="heap")


@pytest.mark.parametrize("layout", [index.SHARDS, index.BUCKETS])
def test_look_ups_skip_row_groups(spark, at, layout):
    hashes = spark.range(40_000).select((F.col("id") * 1000).alias("min_hash"))
    index.build_index(hashes, f"{at}/i", bits=1, layout=layout, row_group_rows=1000)
    found = index.Index(spark, f"{at}/i")
    there, absent = [5000, 20_000_000, 39_999_000], [5001, 20_000_001, 31_234_567]
    assert {tuple(r) for r in found.lookup(there + absent).collect()} == {(v, True) for v in there} | {(v, False) for v in absent}
    # of 40 row groups those that hold one of the values are read, and of absent values none, though they lie between a group's ends
    assert 0 < sum(scanned(bucketed.among(found.rows.select("min_hash"), "min_hash", there))) <= 3000
    assert sum(scanned(bucketed.among(found.rows.select("min_hash"), "min_hash", absent))) == 0
    assert found.lookup([]).count() == 0
    with pytest.raises(ValueError):
        bucketed.among(found.rows, "min_hash", list(range(bucketed.FEW + 1)))


def test_annotation_reads_and_hashes_once(spark, at, no_broadcast):
    rows = [("a", f"c{i}", "ACGTTGCATGCCATGACTGACTGAAACCTTGG" * (i % 3) + "ACG"[: i % 4]) for i in range(40)] + [("a", "c1", "ACGTTGCATGCCATGACTGACTGAAACCTTGG")]
    spark.createDataFrame(rows, "accession string, contig string, sequence string").withColumn("contig_length", F.length("sequence")).write.parquet(f"{at}/contigs")
    contigs = spark.read.parquet(f"{at}/contigs")
    most = (1 << 63) - 1
    known = annotate.contig_hashes(contigs.filter("contig = 'c1'"), most=most).select(F.col("hash").alias("min_hash")).distinct()
    known.write.parquet(f"{at}/known")
    index.build_index(spark.read.parquet(f"{at}/known"), f"{at}/i", bits=2, layout=index.BUCKETS)
    found = index.Index(spark, f"{at}/i")
    got = annotate.annotate_contigs(contigs, found, most=most)
    text = plan(got)
    assert text.count("ArrowEvalPython") == 1 and text.count("FileScan parquet [") == 1 and text.count("Bucketed: true") == 1
    want = annotate.annotate(annotate.contig_hashes(contigs, most=most), found, contigs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 40
    docs = contigs.select("accession", "contig", "contig_length", md5_hashes(F.col("sequence"), 5).alias("hashes"))
    assert plan(annotate.annotate_sketched(docs, found)).count("FileScan parquet [") == 1


def test_footers_alone_are_read(spark, at, tmp_path):
    values(spark, 5000).withColumn("bucket", F.col("min_hash") % 3).repartition(2).write.partitionBy("bucket").parquet(f"{at}/t")
    df = footer_statistics(spark, f"{at}/t", "min_hash")
    assert "PushedAggregation: [COUNT(*), MIN(min_hash), MAX(min_hash)]" in plan(df).replace("\n", " ") or "PushedAggregation" in df._jdf.queryExecution().toString()
    # with all column chunks spoilt, counts and ends are still there
    for path in (tmp_path / "t").rglob("*.parquet"):
        meta = pq.read_metadata(path)
        end = max(meta.row_group(g).column(0).data_page_offset + meta.row_group(g).column(0).total_compressed_size for g in range(meta.num_row_groups))
        data = bytearray(path.read_bytes())
        data[4:end] = bytes(end - 4)
        path.write_bytes(bytes(data))
        for crc in path.parent.glob(".*.crc"):
            crc.unlink()
    want = values(spark, 5000).agg(F.min("min_hash"), F.max("min_hash")).first()
    assert tuple(footer_statistics(spark, f"{at}/t", "min_hash").first()) == (5000, *want) and jobs.row_counts(spark, f"{at}/t") == 5000
    with pytest.raises(Exception):
        spark.read.parquet(f"{at}/t").agg(F.sum("min_hash")).collect()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_row_groups_are_exact(spark, at):
    rows = values(spark, 2500)
    for name, write in (("single", lambda p: sinks.write_single(rows, p, sort=["min_hash"], row_group_rows=700)), ("sorted", lambda p: sinks.write_sorted(rows, p, "min_hash", parts=1, row_group_rows=700))):
        write(f"{at}/{name}")
        assert [r["n_rows"] for r in row_groups(spark, f"{at}/{name}").orderBy("row_group").collect()] == [700, 700, 700, 400]
    sinks.write_shards(rows, f"{at}/shards", 3, "min_hash", row_group_rows=100, prefix="s_")
    groups = row_groups(spark, f"{at}/shards").groupBy("file").agg(F.max("n_rows").alias("most"), F.sum("n_rows").alias("all"), F.count("*").alias("n")).collect()
    assert len(groups) == 3 and all(g["most"] == 100 and g["n"] == -(-g["all"] // 100) for g in groups) and sum(g["all"] for g in groups) == 2500
    with pytest.raises(ValueError):
        sinks.write_single(rows, f"{at}/none", row_group_rows=0)


def test_failing_job_keeps_the_old_output(spark, at, tmp_path):
    rows = values(spark, 50)
    bad = rows.withColumn("min_hash", F.raise_error(F.lit("broken")).cast("bigint"))
    writers = {
        "plain": lambda df, **o: sinks.write_plain(df, f"{at}/plain", **o),
        "partitioned": lambda df, **o: sinks.write_partitioned(df.withColumn("b", F.lit(1)), f"{at}/partitioned", "b", values=2, **o),
        "single": lambda df, **o: sinks.write_single(df, f"{at}/single", **o),
        "sorted": lambda df, **o: sinks.write_sorted(df, f"{at}/sorted", "min_hash", parts=2, **o),
        "shards": lambda df, **o: sinks.write_shards(df, f"{at}/shards", 2, "min_hash", prefix="x", **o),
        "csv": lambda df, **o: sinks.write_csv(df, f"{at}/csv", **o),
        "json": lambda df, **o: sinks.write_json_lines(df, f"{at}/json", **o),
        "index": lambda df, **o: index.build_index(df, f"{at}/index", bits=1, layout=index.BUCKETS, **o),
        "preview": lambda df, **o: sinks.write_preview(df, f"{at}/preview", **o),
    }
    for name, write in writers.items():
        write(rows)
        before = sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / name).rglob("*"))
        with pytest.raises(Exception, match="broken"):
            write(bad, overwrite=True)
        assert sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / name).rglob("*")) == before
        with pytest.raises(files.OutputExists):
            write(rows)
        write(rows.limit(1), overwrite=True)
        assert not [p.name for p in tmp_path.iterdir() if p.name.startswith(("_staged", "_old"))]
    assert spark.read.parquet(f"{at}/plain").count() == 1
    sinks.write_plain(spark.read.parquet(f"{at}/plain").union(rows), f"{at}/plain", overwrite=True)  # from what it replaces
    assert spark.read.parquet(f"{at}/plain").count() == 51
    with pytest.raises(FileNotFoundError):
        with files.replacing(spark, f"{at}/nothing"):
            pass


@pytest.fixture()
def sets(spark, at):
    spark.createDataFrame([(1, 31), (2, 31), (3, 31), (3, 31)], "hash bigint, ksize int").write.parquet(f"{at}/q")
    spark.createDataFrame([(2, 31), (3, 21), (None, 31)], "hash bigint, ksize int").write.parquet(f"{at}/k1")
    entries = [("query", "q", "sigs.hashes", "hash", "left"), ("known", "k1", "hashes", "hash", "right")]
    return {"databases": [{"alias": a, "path": f"{at}/{p}", "table": t, "column": c, "set_id": s, "ksize": "ksize"} for a, p, t, c, s in entries]}


def test_negative_set_is_reused(spark, at, sets, no_broadcast):
    out = jobs.left_minus_rights(spark, sets, f"{at}/one", negatives=f"{at}/neg", buckets=8)
    again = jobs.left_minus_rights(spark, sets, f"{at}/two", negatives=f"{at}/neg", skip_build=True, buckets=8)
    rows = lambda p: sorted(r[0] for r in read_hive_hashes(spark, p).collect())
    assert rows(out) == rows(again) == [1, 3, 3]
    rights = [s for s in manifest.load_manifest(spark, sets) if s.set_id == "right"]
    kept = negatives.reuse(spark, rights, f"{at}/neg", ksize=31, buckets=8)
    from sketchloom.operators import setops

    text = plan(setops.difference(spark.read.parquet(f"{at}/q"), [], negatives=kept, buckets=8))
    assert text.count("Exchange") == 1 and text.index("Exchange") < text.index("Bucketed: true")
    for other in ({"ksize": 21}, {"fraction": 0.5}, {"buckets": 4}):
        with pytest.raises(negatives.OtherNegatives, match=next(iter(other))):
            jobs.left_minus_rights(spark, sets, f"{at}/three", negatives=f"{at}/neg", skip_build=True, **({"buckets": 8} | other))
    more = json.loads(json.dumps(sets))
    more["databases"].append({**sets["databases"][1], "alias": "more"})
    with pytest.raises(negatives.OtherNegatives, match="sets"):
        jobs.left_minus_rights(spark, more, f"{at}/three", negatives=f"{at}/neg", skip_build=True, buckets=8)
    spark.createDataFrame([(1, 31)], "hash bigint, ksize int").write.mode("append").parquet(f"{at}/k1")
    with pytest.raises(negatives.OtherNegatives, match="sets"):
        jobs.left_minus_rights(spark, sets, f"{at}/three", negatives=f"{at}/neg", skip_build=True, buckets=8)
    assert rows(jobs.left_minus_rights(spark, sets, f"{at}/three", negatives=f"{at}/neg", buckets=8)) == [3, 3]
    with pytest.raises(FileNotFoundError):
        jobs.left_minus_rights(spark, sets, f"{at}/four", negatives=f"{at}/none", skip_build=True)
    with pytest.raises(ValueError):
        jobs.left_minus_rights(spark, sets, f"{at}/four", skip_build=True)
    with pytest.raises(SystemExit):
        cli.main(["left-minus-rights", "--manifest", "m", "--out-dir", "o", "--skip-build-neg"])


def test_tables_by_name(spark, at, sets):
    spark.sql("CREATE DATABASE IF NOT EXISTS names_db")
    for path, name in (("q", "left_table"), ("k1", "right_table")):
        spark.read.parquet(f"{at}/{path}").write.mode("overwrite").saveAsTable(f"names_db.{name}")
    spark.read.parquet(f"{at}/k1").createOrReplaceTempView("right_view")
    of = lambda path, table, i: {**sets["databases"][i], "path": path, "table": table}
    for left, right in ((of("catalog", "names_db.left_table", 0), of("catalog:names_db", "right_table", 1)), (of("catalog:spark_catalog.names_db", "left_table", 0), of("catalog", "right_view", 1)), (sets["databases"][0], of("catalog", "spark_catalog.names_db.right_table", 1))):
        out = jobs.left_minus_rights(spark, {"databases": [left, right]}, f"{at}/out", overwrite=True)
        assert sorted(r[0] for r in read_hive_hashes(spark, out).collect()) == [1, 3, 3]
    got = manifest.load_manifest(spark, {"databases": [of("catalog", "names_db.left_table", 0), of("catalog:names_db", "right_table", 1)]})
    manifest.register(spark, got)
    assert spark.table("query").count() == 4 and got[1].state(spark) == got[1].state(spark)
    for bad, said in ((of("catalog", "names_db.nobody", 1), "no table"), (of("catalog", "a.b.c.d", 1), "more than"), ({**sets["databases"][1], "column": "h"}, "no column h"), ({**sets["databases"][1], "ksize": "k"}, "no column k")):
        with pytest.raises(manifest.ManifestError, match=said):
            jobs.left_minus_rights(spark, {"databases": [sets["databases"][0], bad]}, f"{at}/never")
    with pytest.raises(manifest.ManifestError):
        manifest.load_manifest(spark, {"databases": [sets["databases"][0], of("catalogue", "x", 1)]})


def test_long_top_lists_have_no_single_task(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 1_000_003).alias("min_hash"), (F.col("id") % 7).alias("n_samples"))
    best = counts.top(df, 20_000)
    text = plan(best)
    assert "SinglePartition" not in text and "TakeOrdered" not in text and "rangepartitioning" in text
    want = sorted(((r["min_hash"], r["n_samples"]) for r in df.collect()), key=lambda r: (-r[1], r[0]))[:20_000]
    assert [tuple(r) for r in best.collect()] == want


def test_several_files_for_a_bucket(spark, at):
    rows = values(spark, 1000).withColumn("b", (F.col("min_hash") % 2).cast("int"))
    sinks.write_partitioned(rows, f"{at}/p", "b", values=2, files=3, spread=F.xxhash64("min_hash"))
    found = spark.read.parquet(f"{at}/p").groupBy("b").agg(F.countDistinct("_metadata.file_path").alias("files"), F.count("*").alias("n")).collect()
    assert {r["b"]: r["files"] for r in found} == {0: 3, 1: 3} and sum(r["n"] for r in found) == 1000
    with pytest.raises(ValueError):
        sinks.write_partitioned(rows, f"{at}/q", "b", files=3)


def test_a_hot_value_is_split(spark, tmp_path):
    """A value that holds nearly all rows is written by several tasks, a small one by one."""
    at = f"file://{tmp_path}"
    rows = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") < 199_000, F.lit(0)).otherwise(F.lit(1)).alias("b"), F.xxhash64("id").alias("h"))
    had = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        sinks.write_partitioned(rows, f"{at}/p", "b")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", had)
    files = {v: len([p for p in (tmp_path / "p" / f"b={v}").iterdir() if p.name.endswith(".parquet")]) for v in (0, 1)}
    assert files[0] > 2 and files[1] <= 2
    back = spark.read.parquet(f"{at}/p")
    assert back.count() == 200_000 and back.select("b", "h").exceptAll(rows).count() == 0
