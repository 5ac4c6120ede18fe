"""Schemas of the datasets that jobs read and write, and the fixed values of the sketches."""

from __future__ import annotations

# Fixed values of the sketches.
KSIZE = 31
SCALED = 1000
SEED = 42
MAX_HASH = (1 << 64) // SCALED
SHARD_BITS = 8

SIGNATURES = "sample_id string, min_hash bigint, ksize int"
HASHES = "hash bigint"
HASH_COUNTS = "min_hash bigint, sample_count bigint"
SAMPLE_COUNTS = "sample_id string, matched_hash_count bigint"
BUCKET_COUNTS = "min_hash bigint, n_samples bigint, bucket int"
PAIRS = "sample_id string, min_hash bigint, part int"
LISTS = "min_hash bigint, sample_count bigint, sample_ids array<string>"
CONTIGS = "accession string, contig string, sequence string, contig_length int"
CONTIG_COUNTS = "accession string, contig string, contig_length int, candidate_hashes bigint, novel_hashes bigint, frac_novel double"
