"""The negative set of a difference, kept so that later differences needn't build it again.

It is a bucketed table of all hashes of the RIGHT sets, each once, which an
anti-join reads in place, and a sidecar that says what it was built from. A
difference over other sets, parameters or changed files doesn't reuse it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sketchloom.operators import setops
from sketchloom.sources import bucketed
from sketchloom.sources.files import exists
from sketchloom.sources.manifest import HashSet


class OtherNegatives(ValueError):
    """A negative set that was built from something else."""


def described(spark: SparkSession, rights: list[HashSet], ksize: int, fraction: float, buckets: int) -> dict:
    """What a negative set depends on: the sets in the order of their names, the state of their files, and the parameters."""
    sets = [{"alias": s.alias, "path": s.path, "table": s.table, "column": s.column, "ksize": s.ksize, "state": s.state(spark)} for s in sorted(rights, key=lambda s: s.alias)]
    return {"sets": sets, "ksize": ksize, "fraction": fraction, "buckets": buckets}


def build(spark: SparkSession, rights: list[HashSet], path: str, *, ksize: int, fraction: float = 1.0, buckets: int = 256, overwrite: bool = False) -> DataFrame:
    """Write the negative set and return it."""
    note = described(spark, rights, ksize, fraction, buckets)
    frames = [setops.sampled(s.read(spark, ksize), fraction, buckets) for s in rights]
    rows = setops.union_distinct(frames) if frames else spark.createDataFrame([], "hash bigint")
    bucketed.write_buckets(rows.filter("hash IS NOT NULL"), path, "hash", buckets, note={"built_from": note}, overwrite=overwrite)
    return bucketed.open_buckets(spark, path)


def reuse(spark: SparkSession, rights: list[HashSet], path: str, *, ksize: int, fraction: float = 1.0, buckets: int = 256) -> DataFrame:
    """The negative set at ``path``, if it was built from just these sets as they are now, and alike."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no negative set at {path}")
    have, want = bucketed.note_of(spark, path).get("built_from"), described(spark, rights, ksize, fraction, buckets)
    if have != want:
        other = "no negative set" if not have else ", ".join(k for k in want if have.get(k) != want[k])
        raise OtherNegatives(f"the negative set at {path} was built from something else: {other}")
    return bucketed.open_buckets(spark, path)
