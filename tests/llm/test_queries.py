"""The registered queries and the pipeline on the smallest tables, each against brute force over all of its rows."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_base, brute_hits, brute_print, brute_secrets, check_packing, classes, lower, shingle_set, words

import __spark_entry__ as entry
import corpus_pipeline
from sketchloom.llm import licenses, linededup, queries
from sketchloom.llm.tokens import Encoder

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def items():
    return [(str(i), t) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()]


def result(spark, name):
    return entry.queries()[name](spark, DATA).collect()


def by_id(rows, documents):
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(got) and set(got) == set(documents)
    return got


def test_op1(spark, documents):
    got = by_id(result(spark, "op1_license_scan"), documents)
    for i, text in documents.items():
        n, found = brute_base(text)
        r, places = got[i], [p for p, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
        w = words(text)
        more = {label for phrase, label in licenses.NOTICES.items() if any(w[k : k + phrase.count(" ") + 1] == phrase.split() for k in range(len(w)) if w[k] == phrase.split()[0])}
        labels = set(filter(None, r["labels"].split(",")))
        assert labels >= {label for _, label in found} | more and r["labels"] == ",".join(sorted(labels)) and 0 <= r["score"] <= 1


def test_op2(spark, documents, items):
    got = by_id(result(spark, "op2_decontamination"), documents)
    for i, text in documents.items():
        n, hit, names = brute_hits(text, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_op2_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.op2_decontamination(spark, DATA)
    found = c.execute(entry.oracle_sql()["op2_decontamination"])
    columns = [d[0] for d in found.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())


def remainder(i, by):
    return zlib.crc32(str(i).encode()) % by


def test_op3(spark, documents):
    got = by_id(result(spark, "op3_language_id"), documents)
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").fetchall())
    held = [i for i in documents if remainder(i, 3) == 1]
    for i, text in documents.items():
        assert got[i]["held_out"] == (remainder(i, 3) == 1) and 0 <= got[i]["score"] <= 1
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert got[i]["lang_pred"] in {*filter(None, lang.values()), "und"}
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) > 0.97


@pytest.mark.parametrize("data", [DATA, LARGER])
def test_op4(spark, data):
    got = {r["doc_id"]: r for r in entry.queries()["op4_quality"](spark, data).collect()}
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{data}/labels.parquet'").fetchall())
    assert set(got) == {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{data}/documents.parquet'").fetchall()}
    for i, r in got.items():
        assert r["held_out"] == (remainder(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[i]["score"], label[i]) for i in label if i in got and got[i]["held_out"]]
    if data == LARGER:  # the smallest tables hold out a handful of labels
        assert np.mean([(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x > y]) > 0.95


def test_op5(spark, documents):
    got = by_id(result(spark, "op5_matroska"), documents)
    for i, text in documents.items():
        plain = (text or "").encode()
        payload = plain + b"\xff" * (-len(plain) % 576 or (576 if not plain else 0))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(plain), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > len(payload) and re.fullmatch("[0-9a-f]{64}", r["media_sha256"]) and r["feature"]


def test_op6(spark, documents):
    got = by_id(result(spark, "op6_secret_scan"), documents)
    kinds = ("assign", "access", "hex")
    for i, text in documents.items():
        found = brute_secrets(text)
        base = [f"{kinds[k]}:{a}:{b}" for a, k, b in found]
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in found) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("literal")] == base


def test_op7(spark, documents):
    got = by_id(result(spark, "op7_simhash_dedup"), documents)
    ids = list(documents)
    prints = [brute_print(documents[i]) for i in ids]
    label = classes(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    for k, i in enumerate(ids):
        assert got[i]["fingerprint"] == f"{prints[k]:016x}" and got[i]["component_id"] == ids[label[k]]


def brute_lines(texts):
    """Per text (in order): places of the words in 50-word spans that an earlier one has."""
    seen, out = set(), {}
    for i, text in texts.items():
        w = words(text)
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        out[i] = {k + j for k, x in enumerate(windows) if x in seen for j in range(50)}
        seen.update(windows)
    return out


def test_op8(spark, documents):
    got = by_id(result(spark, "op8_line_dedup"), documents)
    for i, gone in brute_lines(documents).items():
        assert {k for r in got[i]["removed"] for k in range(r["start"], r["end"])} == gone and got[i]["n_removed"] == len(gone)
        assert words(got[i]["text"]) == [x for k, x in enumerate(words(documents[i])) if k not in gone]


def test_op9(spark, documents):
    got = by_id(result(spark, "op9_token_output"), documents)
    plain, at = Encoder(queries.tokenizer_path("word_bpe_49k.json")).tokenizer, 0
    for i, text in documents.items():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op10(spark, documents):
    rows = result(spark, "op10_packing")
    sizes = check_packing(rows, documents, Encoder(queries.tokenizer_path("byte_bpe_50k.json")).tokenizer, 1024)
    assert {r["doc_id"] for r in rows} == set(documents) and sum(sizes) / (1024 * len(sizes)) > 0.98


def test_pipeline(spark, documents, items):
    """Every stage again by brute force: language by letters (all that the model rejects), then spans, similar shingle sets, benchmark windows and pieces."""
    kept = {i: t for i, t in documents.items() if any(c.isalpha() for c in t or "")}
    gone, cut = brute_lines(kept), {}
    for i, text in kept.items():
        data = (text or "").encode()
        places = [m.span() for m in re.finditer(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text).encode())]
        ranges, left = [], gone[i]
        for k in sorted(left):
            if k - 1 not in left:
                ranges.append([k, k])
            ranges[-1][1] = k + 1
        cut[i] = linededup.cut(data, [tuple(r) for r in ranges], np.array([a for a, _ in places], np.int64)).decode() if ranges else text
    ids = list(cut)
    sets = [shingle_set(cut[i]) for i in ids]
    label = classes(len(ids), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    left = {ids[k]: cut[ids[k]] for k in sorted(set(label))}
    clean = {}
    for i, text in left.items():
        n, hit, _ = brute_hits(text, items)
        if not (hit and 20 * hit >= n):
            clean[i] = text
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "sequences"]
    assert {r["doc_id"] for r in rows} == set(clean)
    check_packing(rows, clean, Encoder(queries.tokenizer_path("byte_bpe_50k.json")).tokenizer, 1024)


def test_stages_on_odd_tables(spark):
    """Nulls in any column, repeated rows, empty and long texts, clashing names, and no rows, through each stage alone."""
    long_text = "a longer text of many words " * 20_000
    rows = [(1, None, None, "s", None), (None, "some words here", "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, long_text, "en", "s", 1), (3, long_text, "en", "s", 1), (4, "123 !!", "de", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit("x") for c in ("node", "root", "hits", "removed", "n_removed", "__c0", "a.b", "shard")})
    expected = defaultdict(set, {"language": {None, 3}, "lines": {None, 1, 2, 3, 4}, "near_duplicates": {None, 1, 3, 4}, "benchmark": {None, 1, 2, 3, 4}, "sequences": {None, 1, 2, 3, 4}})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "sequences":
            assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} == expected[name], name
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.count() == 0 and empty.columns == out.columns
