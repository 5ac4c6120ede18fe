"""Contig annotation: how many of a contig's k-mer hashes are in an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.kmers import murmur_sketch
from sketchloom.operators.index import Index, probe
from sketchloom.schemas import KSIZE, MAX_HASH, SEED


def contig_hashes(contigs: DataFrame, *, k: int = KSIZE, most: int = MAX_HASH, seed: int = SEED) -> DataFrame:
    """(accession, contig, hash) of all canonical k-mers under the gate; every occurrence counts."""
    sketch = murmur_sketch(k, most, seed)
    return contigs.select("accession", "contig", F.explode(sketch("sequence")).alias("hash"))


def _counts(rows: DataFrame) -> DataFrame:
    """Columns in order, with the fraction."""
    fraction = F.when(F.col("candidate_hashes") > 0, F.col("novel_hashes") / F.col("candidate_hashes")).otherwise(F.lit(0.0))
    return rows.select("accession", "contig", "contig_length", "candidate_hashes", "novel_hashes", fraction.alias("frac_novel"))


def annotate_sketched(contigs: DataFrame, index: DataFrame | Index) -> DataFrame:
    """(accession, contig, contig_length, candidate_hashes, novel_hashes, frac_novel) of contigs with a column ``hashes`` (array).

    Contigs are read and hashed once: each goes on as its hashes, the first of which carries its length; one without hashes
    as a row that asks for nothing. Repeated ids are merged, their lengths added.
    """
    rows = contigs.select("accession", "contig", "contig_length", F.posexplode_outer("hashes").alias("place", "min_hash"))
    rows = rows.select("accession", "contig", F.when(F.coalesce("place", F.lit(0)) == 0, F.col("contig_length")).alias("length"), "min_hash")
    hits = probe(rows, index)
    found = hits.groupBy("accession", "contig").agg(F.sum("length").cast("int").alias("contig_length"), F.count("min_hash").alias("candidate_hashes"), F.sum(F.col("hit").cast("bigint")).alias("novel_hashes"))
    return _counts(found)


def annotate_contigs(contigs: DataFrame, index: DataFrame | Index, *, k: int = KSIZE, most: int = MAX_HASH, seed: int = SEED) -> DataFrame:
    """The same of contigs with a column ``sequence``."""
    return annotate_sketched(contigs.select("accession", "contig", "contig_length", murmur_sketch(k, most, seed)("sequence").alias("hashes")), index)


def annotate(hashes: DataFrame, index: DataFrame | Index, contigs: DataFrame | None = None) -> DataFrame:
    """The same of hashes (accession, contig, hash) that another tool has found.

    With ``contigs`` each contig has a row, also without candidates, and its
    length, repeated ids being merged (lengths added); without them only contigs
    with candidates do, and lengths are -1.
    """
    hits = probe(hashes.withColumnRenamed("hash", "min_hash"), index)
    counted = hits.groupBy("accession", "contig").agg(F.count("*").alias("candidate_hashes"), F.sum(F.col("hit").cast("bigint")).alias("novel_hashes"))
    if contigs is None:
        return _counts(counted.withColumn("contig_length", F.lit(-1)))
    lengths = contigs.groupBy("accession", "contig").agg(F.sum("contig_length").cast("int").alias("contig_length"))
    return _counts(lengths.join(counted, ["accession", "contig"], "left").fillna(0, ["candidate_hashes", "novel_hashes"]))
