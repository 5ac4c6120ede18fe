"""Paths by Hadoop's file systems, so that any store Spark reads can be used: listing, guards, run folders, sidecars."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


class OutputExists(FileExistsError):
    """An output is there already and must not be replaced."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Full paths of what a folder holds, sorted; [] if there is none."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(where)) if fs.exists(where) else []


def files_below(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """All files below a folder, sorted by path."""
    fs, where = _at(spark, path)
    found, it = [], fs.listFiles(where, True)
    while it.hasNext():
        name = it.next().getPath().toString()
        if name.endswith(suffix):
            found.append(name)
    return sorted(found)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _at(spark, old)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def copy(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _at(spark, old)
    to_fs, to = _at(spark, new)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, to_fs, to, False, spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local session gets one of its own; a cluster has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/sketchloom-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _occupied(spark: SparkSession, path: str) -> bool:
    """Whether there is a file, or a folder that isn't empty."""
    fs, where = _at(spark, path)
    return fs.exists(where) and not (fs.getFileStatus(where).isDirectory() and not children(spark, path))


def guard(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Refuse an output that is there already, unless it may be replaced. Nothing is deleted: see :func:`replacing`."""
    if not overwrite and _occupied(spark, path):
        raise OutputExists(f"{path} exists; allow overwriting or choose another path")


@contextmanager
def replacing(spark: SparkSession, path: str, overwrite: bool = False) -> Iterator[str]:
    """A folder to write an output into, which takes the place of ``path`` when the block ends well.

    Until then the old output stays, can be read by the plan that makes the new one, and is what is left if that fails.
    The new folder stands beside the old one under a name that readers skip and is put in by renaming; if that fails the
    old one is put back. A folder that Spark wrote counts as complete only with its marker, where it writes one.
    """
    guard(spark, path, overwrite)
    root, name = path.rstrip("/").rsplit("/", 1)
    mark = uuid.uuid4().hex
    staged, old = f"{root}/_staged-{name}-{mark}", f"{root}/_old-{name}-{mark}"
    try:
        yield staged
        if not exists(spark, staged):
            raise FileNotFoundError(f"nothing was written for {path}")
        guard(spark, path, overwrite)  # another job may have written it meanwhile
        there = exists(spark, path)
        if there:
            rename(spark, path, old)
        try:
            rename(spark, staged, path)
        except OSError:
            if there:
                rename(spark, old, path)
            raise
        if there:
            remove(spark, old)
    finally:
        if exists(spark, staged):
            remove(spark, staged)


def materialised(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written into the shared folder and read again, so that it is made once; and its path, to be removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at or below a path, by which a change is noticed."""
    fs, where = _at(spark, path)
    found, it = [], fs.listFiles(where, True)
    while it.hasNext():
        s = it.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def run_id(tag: str | None = None) -> str:
    return tag or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def latest_run(spark: SparkSession, path: str) -> str:
    """The last ``run=`` folder by name."""
    runs = [p for p in children(spark, path) if p.rsplit("/", 1)[-1].startswith("run=")]
    if not runs:
        raise FileNotFoundError(f"no run= folder in {path}")
    return runs[-1]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file written by the driver."""
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_bytes(spark, path, json.dumps(value, indent=2, sort_keys=True).encode())


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def single_part(spark: SparkSession, folder: str, name: str, keep_rest: bool = False) -> str:
    """Give the one part file of a written folder a name and clear away markers; more than one part is an error, since renaming one would lose the others."""
    parts = [p for p in children(spark, folder) if p.rsplit("/", 1)[-1].startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{folder} has {len(parts)} part files; only a single one can be renamed")
    base = parts[0].rsplit("/", 1)[-1]
    new = f"{folder}/{name}" + base[base.index(".") :]
    rename(spark, parts[0], new)
    if not keep_rest:
        for p in children(spark, folder):
            if p.rsplit("/", 1)[-1] in ("_SUCCESS",) or p.endswith(".crc"):
                remove(spark, p)
    return new
