"""Operators on hand-written frames: nulls, repeats, empty sides, negative hashes, ties and edges."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions import hashing, kmers
from sketchloom.operators import annotate, counts, histogram, index, selection, setops


def hashes(spark, values, name="hash"):
    return spark.createDataFrame([(v,) for v in values], f"{name} bigint")


def column(df, name="hash"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is not None, x))


SIGNATURES = [("s1", 7, 31), ("s1", 7, 31), ("s2", 7, 31), ("s1", 9, 21), ("s3", 8, 31), ("s2", 8, 31), ("s1", -7, 31)]


@pytest.fixture(scope="module")
def sig(spark):
    return spark.createDataFrame(SIGNATURES, "sample_id string, min_hash bigint, ksize int")


@pytest.mark.parametrize(
    "left, rights, distinct, expected",
    [([1, 1, 2], [[2]], False, [1, 1]), ([1, 1, 2], [[2]], True, [1]), ([1, 2], [], False, [1, 2]), ([1, 2], [[]], False, [1, 2]), ([1, None, 2], [[1, None]], False, [2]), ([], [[1]], False, []), ([1, 2, 3], [[1, 1], [3]], False, [2])],
)
def test_difference(spark, left, rights, distinct, expected):
    assert column(setops.difference(hashes(spark, left), [hashes(spark, r) for r in rights], distinct_left=distinct)) == expected


def test_difference_buckets(spark):
    got = {r["hash"]: r["bucket"] for r in setops.difference(hashes(spark, [5, 257, -1]), [], buckets=256).collect()}
    assert got == {5: 5, 257: 1, -1: 255}
    with pytest.raises(ValueError):
        setops.difference(hashes(spark, [5]), [], buckets=100)


def test_exclude_keeps_nulls(spark):
    got = setops.exclude(hashes(spark, [1, None, 2], "min_hash"), hashes(spark, [1, None]))
    assert column(got, "min_hash") == [None, 2]


def test_venn(spark):
    row = setops.venn(hashes(spark, [1, 2, 3, None]), [hashes(spark, [3, 4, 4]), hashes(spark, [5])]).first()
    assert tuple(row) == (2, 1, 2, 3, 3, True, True)
    repeated = setops.venn(hashes(spark, [1, 3, 3]), [hashes(spark, [3])]).first()
    assert (repeated["intersection"], repeated["sanity_target"], repeated["sanity_others"]) == (2, True, False)
    assert tuple(setops.venn(hashes(spark, [1]), []).first())[:5] == (1, 0, 0, 1, 0)


def test_same_set(spark):
    assert setops.same_set(hashes(spark, [1, 2, 2]), hashes(spark, [2, 1]))
    assert not setops.same_set(hashes(spark, [1]), hashes(spark, [1, 2]))


def test_sampled_difference_is_part_of_the_whole(spark):
    left, right = hashes(spark, range(0, 40000, 7)), hashes(spark, range(0, 40000, 21))
    whole = set(column(setops.difference(left, [right])))
    part = set(column(setops.difference(left, [right], fraction=0.5, buckets=1)))
    assert part <= whole
    assert part == {h for h in whole if h % (1 << 20) < 1 << 19}


@pytest.mark.parametrize("fraction, threshold", [(0.5, 1 << 19), (1e-9, 1), (1.0, 1 << 20)])
def test_sample_threshold(fraction, threshold):
    assert hashing.sample_threshold(fraction) == threshold


def test_sample_fraction_range():
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            hashing.sample_threshold(bad)


def test_counts(sig):
    assert {tuple(r) for r in counts.hash_counts(sig, ksize=31).collect()} == {(7, 2), (8, 2), (-7, 1)}
    assert {tuple(r) for r in counts.sample_counts(sig, ksize=31).collect()} == {("s1", 2), ("s2", 2), ("s3", 1)}
    pairs = counts.distinct_pairs(sig, ksize=31, parts=4)
    assert {(r["min_hash"], r["part"]) for r in pairs.collect()} == {(7, 3), (8, 0), (-7, -3)}
    by_hash, by_sample = counts.counts_from_pairs(pairs)
    total = pairs.count()
    assert by_hash.agg(F.sum("sample_count")).first()[0] == by_sample.agg(F.sum("matched_hash_count")).first()[0] == total


def test_counts_of_selected(spark, sig):
    assert {tuple(r) for r in counts.hash_counts(sig, hashes(spark, [7, 7, 99], "min_hash"), ksize=31).collect()} == {(7, 2)}


def test_bucket_counts_negative(sig):
    assert {(r["min_hash"], r["bucket"]) for r in counts.bucket_counts(sig, 4).collect()} == {(7, 3), (8, 0), (9, 1), (-7, 1)}


def test_top_breaks_ties_by_hash(spark):
    df = spark.createDataFrame([(5, 3), (4, 3), (1, 9), (2, 1)], "min_hash bigint, n_samples bigint")
    assert [tuple(r) for r in counts.top(df, 3).collect()] == [(1, 9), (4, 3), (5, 3)]


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 40, 99, 100, 200])
def test_long_top_lists(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(h), int(c)) for h, c in zip(rng.permutation(np.arange(-50, 50)) * (1 << 56) + 7, rng.integers(1, 4, 100))]
    df = spark.createDataFrame(rows, "min_hash bigint, n_samples bigint")
    assert [tuple(r) for r in counts.top(df, n, heap=0).collect()] == sorted(rows, key=lambda r: (-r[1], r[0]))[:n]


def test_lists(sig, spark):
    chosen = hashes(spark, [7], "min_hash")
    assert [tuple(r) for r in counts.sample_lists(sig, chosen, ksize=31).collect()] == [(7, 2, ["s1", "s2"])]
    assert [tuple(r) for r in counts.sample_lists(sig, chosen, ksize=31, distinct=False).collect()] == [(7, 3, ["s1", "s1", "s2"])]
    best = spark.createDataFrame([(7, 2), (8, 2)], "min_hash bigint, n_samples bigint")
    got = counts.sample_lists_of(sig, best, n_keys=2).collect()
    assert [(r["min_hash"], r["sample_ids"], r["n_samples_exact"]) for r in got] == [(7, ["s1", "s2"], 2), (8, ["s2", "s3"], 2)]


def test_distinct_count(spark):
    assert counts.distinct_count(hashes(spark, [1, 1, None, 2])).first()[0] == 2
    assert counts.row_count(hashes(spark, [])).first()[0] == 0


def test_cutpoints(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 4, 10])], "min_hash bigint, sample_count bigint")
    cut = selection.cutpoints(df, "hash", percentiles=(0.0, 0.75))
    assert (cut.low_cut, cut.high_cut) == (1.0, 5.5)
    assert sorted(r[1] for r in selection.between(df, 2, 4, "sample_count").collect()) == [2, 4]
    manual = selection.cutpoints(df, "hash", cuts=(2, 4))
    assert manual.to_dict() == {"source": "hash", "p_low": None, "p_high": None, "low_cut": 2.0, "high_cut": 4.0}
    for bad in ({}, {"percentiles": (0.1, 0.2), "cuts": (1, 2)}, {"cuts": (3, 1)}, {"percentiles": (0.9, 0.1)}):
        with pytest.raises(ValueError):
            selection.cutpoints(df, "hash", **bad)
    with pytest.raises(ValueError):
        selection.cutpoints(df.filter("false"), "hash", percentiles=(0.1, 0.9))


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "sample_count bigint")


@pytest.mark.parametrize("values, bins, most", [([1, 2, 3, 3, 10], 3, None), (list(range(1, 200, 3)), 7, 150), ([5, 5, 5], 4, None), ([1, 1000], 10, 1000), (list(range(1, 50)), 10, None)])
def test_histogram_is_numpys(spark, values, bins, most):
    got = {r["bin"]: r["n"] for r in histogram.histogram(numbers(spark, values), bins=bins, max_value=most).collect()}
    inside = [v for v in values if most is None or v < most]
    top = max(values) if most is None else min(max(values), most)
    edges = np.linspace(min(values), top, bins + 1)
    expected = np.histogram(inside, edges)[0].tolist()
    assert [got[i] for i in range(bins)] == expected
    assert got.get(-1) == (None if most is None else len(values) - len(inside))


def test_histogram_edges(spark):
    assert histogram.histogram(numbers(spark, []), bins=3).collect() == []
    over = histogram.histogram(numbers(spark, [50, 60]), bins=3, max_value=10).collect()
    assert [(r["bin"], r["n"]) for r in over] == [(-1, 2)]


def test_bin_statistics(spark):
    stats = histogram.bin_statistics(numbers(spark, [0, 1, 1, 2, 100]), bins=2, max_value=4)
    assert (stats["total"], stats["overflow"], stats["median_bin"], stats["modal_bin"]) == (5, 1, 0, 0)
    assert stats["approx_mean_ref"] == pytest.approx((3 * 1 + 1 * 3) / 5) and stats["approx_mean"] == pytest.approx(6 / 4)
    assert histogram.bin_statistics(numbers(spark, []))["total"] == 0


def test_pictures(spark):
    import xml.etree.ElementTree as tree

    rows = histogram.histogram(numbers(spark, [0, 1, 1, 2, 9, 100, 200]), bins=4, max_value=10).collect()
    for log in (False, True):
        svg = tree.fromstring(histogram.picture(rows, column="a<b", log=log))
        bars = [e for e in svg.iter("{http://www.w3.org/2000/svg}rect") if len(e)]
        titles = [b[0].text for b in bars]
        assert titles == ["0 to 2.5: 4", "2.5 to 5: 0", "5 to 7.5: 0", "7.5 to 10: 1", ">= 10: 2"]
        heights = [float(b.get("height")) for b in bars]
        assert [b.get("fill") for b in bars] == ["steelblue"] * 4 + ["firebrick"] and max(heights) == pytest.approx(500) and heights[1] == 0 and 0 < heights[4] < heights[0]
        assert heights[4] / heights[0] == pytest.approx(np.log10(3) / np.log10(5) if log else 0.5, abs=1e-3)
    assert "<svg" in histogram.picture([]) and "<svg" in histogram.picture(histogram.histogram(numbers(spark, [100]), bins=2, max_value=10).collect())


def test_between_percentiles(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 4, 10])], "min_hash bigint, sample_count bigint")
    assert sorted(r[1] for r in selection.between_percentiles(df, 0.25, 0.75, "sample_count").collect()) == [2, 4]


def test_probe_of_columns_of_clashing_names(spark):
    asked = spark.createDataFrame([(3, "x", 1), (None, "y", 2), (3, "z", 3)], "`a.b` bigint, shard string, __k2 int")
    got = index.probe(asked, hashes(spark, [3, 3], "min_hash"), "a.b")
    assert got.columns == ["a.b", "shard", "__k2", "hit"] and sorted(r["hit"] for r in got.collect()) == [False, True, True]


def test_index(spark, tmp_path):
    rows = hashes(spark, [3, 3, 259, 7, None], "min_hash")
    meta = index.build_index(rows, f"file://{tmp_path}/i", bits=8)
    assert (meta["total_rows"], meta["shards"], meta["shard_strategy"]) == (4, 256, "low_bits")
    found = index.Index(spark, f"file://{tmp_path}/i")
    got = {r["min_hash"]: r["hit"] for r in found.probe(hashes(spark, [3, 4, 259, None], "min_hash")).collect()}
    assert got == {3: True, 4: False, 259: True, None: False}
    with pytest.raises(FileExistsError):
        index.build_index(rows, f"file://{tmp_path}/i")
    index.build_index(rows.limit(0), f"file://{tmp_path}/i", overwrite=True)
    assert not any(r["hit"] for r in index.Index(spark, f"file://{tmp_path}/i").probe(hashes(spark, [3], "min_hash")).collect())


def test_top_bits(spark):
    got = [r[0] for r in hashes(spark, [-1, 1, 1 << 62]).select(hashing.high_bits(F.col("hash"), 8)).collect()]
    assert got == [255, 0, 64]


def test_shard_statistics(spark):
    row = index.shard_statistics(hashes(spark, [0, 4, 8, 1], "min_hash"), bits=2).first()
    assert tuple(row) == (4, 1.0, 1, 3, "0:3,1:1")


# Known values of MurmurHash3 x64-128, first word.
@pytest.mark.parametrize("text, seed, value", [("hello", 0, 0xCBD8A7B341BD9B02), ("ACG", 42, 1731421407650554201), ("A" * 31, 42, 2689060699658636553), ("ACGT" * 7 + "ACG", 42, 17897553464741958189), ("C" + "A" * 30, 42, 332837949164353665)])
def test_murmur(text, seed, value):
    assert int(hashing.murmur64(np.frombuffer(text.encode(), np.uint8)[None, :], seed)[0]) == value


def test_canonical():
    got = [row.tobytes().decode() for rows in kmers.canonical(b"ttttNACGa", 4) for row in rows]
    assert got == ["AAAA", "ACGA"]
    assert not len(kmers.sketch_bytes("ACG", 31)) and not len(kmers.sketch_bytes(None, 31))


def test_sketch_is_strand_free():
    rng = np.random.default_rng(0)
    seq = "".join(rng.choice(list("ACGT"), 5000))
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = kmers.sketch_bytes(seq, 31, 1 << 62), kmers.sketch_bytes(back, 31, 1 << 62)
    assert len(a) > 500 and sorted(a.tolist()) == sorted(b.tolist())


def test_gate(spark):
    got = [r[0] for r in hashes(spark, [18446744073709550, 18446744073709551, -1]).select(hashing.gate(F.col("hash"), (1 << 64) // 1000)).collect()]
    assert got == [True, False, False]


def test_annotate(spark):
    contigs = spark.createDataFrame([("a", "c1", 40), ("a", "c1", 2), ("a", "c2", 5)], "accession string, contig string, contig_length int")
    found = spark.createDataFrame([("a", "c1", 1), ("a", "c1", 1), ("a", "c1", 2)], "accession string, contig string, hash bigint")
    known = hashes(spark, [1, 1])
    got = {r["contig"]: tuple(r)[2:] for r in annotate.annotate(found, known, contigs).collect()}
    assert got == {"c1": (42, 3, 2, 2 / 3), "c2": (5, 0, 0, 0.0)}
    assert {tuple(r)[1:] for r in annotate.annotate(found, known).collect()} == {("c1", -1, 3, 2, 2 / 3)}


@pytest.mark.parametrize("step, size", [(1 << 14, 1 << 20), (7, 50)])
@pytest.mark.parametrize("k, most", [(1, 1 << 60), (31, 1 << 60), (31, (1 << 60) // 10), (60, 1 << 60)])
def test_md5_of_many_kmers_at_once(monkeypatch, step, size, k, most):
    """Characters of one to four bytes, so messages of up to five blocks, in texts that are cut into pieces or not."""
    monkeypatch.setattr(kmers, "_MD5_STEP", step)
    monkeypatch.setattr(kmers, "_MD5_BYTES", size)
    pick = random.Random(k)
    texts = ["", "a", "x" * 31, "é" * 31, "😀" * 70, *("".join(pick.choices("abcd \néßñ中文😀"[: pick.choice([4, 9, 12])], k=pick.randint(0, 200))) for _ in range(20)), ""]
    content = [t.encode() for t in texts]
    row, h = kmers.md5_bytes(np.frombuffer(b"".join(content), np.uint8), np.cumsum([0, *map(len, content)]), k, most)
    of = lambda kmer: int(hashlib.md5(kmer.encode()).hexdigest()[:15], 16)
    assert list(zip(row.tolist(), h.tolist())) == [(i, x) for i, t in enumerate(texts) for j in range(len(t) - k + 1) if (x := of(t[j : j + k])) < most]


def test_md5_sketch_hashes_in_batches(spark):
    rows = [(1, None), (2, "short"), (3, "é" + "abc" * 20), (4, "")]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(3)
    assert "md5(" not in kmers.md5_sketch(docs, "id", "text")._jdf.queryExecution().toString()
    assert {r[0]: len(r[1]) for r in docs.select("id", kmers.md5_hashes(F.col("text"), 31, 1 << 60)).collect()} == {1: 0, 2: 0, 3: 31, 4: 0}
