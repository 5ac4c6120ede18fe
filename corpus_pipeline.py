"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; the next one reads its result from Parquet, and what has been
read is deleted. All but the last return the columns of ``documents``, further
columns and clashing names included.

Defined cases, stage by stage: a null or empty text, or one without a letter,
has no language, so its row goes (language); of the other stages, each alone: a
null text stays null, and rows with a null id are cut by nobody (lines); null
and empty texts are copies of each other, of which one stays, as of repeated
rows (near_duplicates); a text without words isn't contaminated, and repeated
rows go or stay together (benchmark); null texts are packed as an end id, and
repeated rows each (sequences). Ties go to the smallest id. Texts of any length
are read whole. An empty table gives no rows at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import decontam, langid, linededup, packing, queries, simhash
from sketchloom.llm.textkit import Carried
from sketchloom.sources.files import remove, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go; the others keep their rows as they are."""
    return langid.keep_known(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of later ones."""
    carried = Carried(docs)
    name = lambda column: f"__c{docs.columns.index(column)}"
    cut = linededup.dedup_lines(docs.select(*carried.columns), doc_id=name("doc_id"), text=name("text"))
    if "n_chars" in docs.columns:
        n, kind = name("n_chars"), docs.schema["n_chars"].dataType
        cut = cut.withColumn(n, F.when(F.col("n_removed") > 0, F.length(name("text")).cast(kind)).otherwise(F.col(n)))
    return carried.back(cut)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts one document stays."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into windows."""
    return packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("sequences", sequences)]

#: SQL can express neither mixture inference nor tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
