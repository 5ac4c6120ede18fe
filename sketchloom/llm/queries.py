"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import decontam, langid, licenses, linededup, matroska, nearest, packing, periods, quality, secrets, simhash, tables, tokenfile, trie

#: Folder of the public tokenizer files; None: as the installed package names it.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    places = F.transform(base, lambda m: m["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(F.transform(base, lambda m: m["label"])).alias("base_labels"),
        joined(F.concat(F.transform("matches", lambda m: m["label"]), F.flatten(F.transform("expressions", lambda e: e["ids"])))).alias("labels"),
        "score",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), spans AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS span
  FROM (SELECT item, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM spans), places AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT p.doc_id, p.s, p.n, q.item FROM places p JOIN spans q ON p.n = q.n AND p.span = q.span),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _remainder(doc_id: str, by: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(by))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(_remainder("doc_id", 3) != 1))
    return langid.identify(docs, model).select("doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels").filter(_remainder("doc_id", 5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_payloads(_table(spark, sf_dir, "documents"), keep_media=False)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(F.filter("found", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"), joined("found").alias("spans"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_tokens(spark, path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations (conv_id, turns) that begin with up to five turns of the hundred's first one."""
    c, h = F.col("conv_id"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    bases = convs.filter(c % 100 == 0).select(c.alias("base"), F.slice("turns", 1, 5).alias("head"))
    both = convs.withColumn("base", c - c % 100).join(bases, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", F.lit(1), F.lit(0))).otherwise(F.slice("head", F.lit(1), h))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, path = tables.written(trie.conversations(_table(spark, sf_dir, "conversations")), "conversations")
    found = trie.prefix_trie(rebuilt(convs))
    tables.drop(spark, path)
    return found


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of about every tenth document the words from a place on are replaced by repetitions of the first few of these."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).cast("bigint").alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    chosen = chosen.withColumn("n", F.size("w").cast("bigint")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    left, places = F.col("n") - F.col("a"), lambda c: c.cast("int")
    chosen = chosen.withColumn("p", F.floor(left / (3 + F.col("g") % 8)) + 1)
    again = F.flatten(F.array_repeat(F.slice("w", places(F.col("a") + 1), places(F.least("p", left))), places(F.ceil(left / F.col("p")))))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), places(F.col("a"))), F.slice(again, F.lit(1), places(left))), " ")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse_runs(repeated_tails(_table(spark, sf_dir, "documents")), keep_text=False)
    found = found.withColumn("best", periods.longest()).select("*", F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"))
    exponent = F.expr("1000 * length div period")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "start", "length", "period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_decontamination": op2_decontamination,
        "op3_language_id": op3_language_id,
        "op4_quality": op4_quality,
        "op5_matroska": op5_matroska,
        "op6_secret_scan": op6_secret_scan,
        "op7_simhash_dedup": op7_simhash_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_token_output": op9_token_output,
        "op10_packing": op10_packing,
        "op11_nearest": op11_nearest,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL}
