"""Manifests of named hash sets, and names of tables: in the session's catalog, or in folders that stand for databases."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sketchloom.sources.datasets import named
from sketchloom.sources.files import exists, fingerprint

#: The path of entries whose table is a name in the session's catalogs; ``catalog:database`` gives the database, too.
CATALOG = "catalog"


class ManifestError(ValueError):
    """A manifest that can't be used."""


@dataclass(frozen=True)
class HashSet:
    """One entry: where a set of hashes is, and on which side it stands."""

    alias: str
    path: str
    table: str
    column: str
    set_id: str
    ksize: str | None = None

    @property
    def in_catalog(self) -> bool:
        """Whether the table is a table or view of the session's catalogs instead of files."""
        return self.path == CATALOG or self.path.startswith(f"{CATALOG}:")

    def catalog_name(self) -> str:
        """The table's name as the catalog has it, quoted: one part is in the current database, or in the one that the path gives; two are database and table; three name the catalog, too."""
        given = self.path[len(CATALOG) + 1 :].strip() if self.in_catalog else ""
        parts = [*[p for p in given.split(".") if p], *name_parts(self.table)]
        if len(parts) > 3:
            raise ManifestError(f"{self.alias}: {'.'.join(parts)} has more than catalog, database and table")
        return ".".join("`" + p.replace("`", "``") + "`" for p in parts)

    def location(self, spark: SparkSession) -> str:
        """The Parquet data: the path itself, or the table's folder or file in a folder that stands for a database."""
        schema, name = split_table(self.table)
        for place in (f"{self.path}/{schema}/{name}", f"{self.path}/{name}", f"{self.path}/{schema}/{name}.parquet", f"{self.path}/{name}.parquet"):
            if exists(spark, place):
                return place
        return self.path

    def relation(self, spark: SparkSession) -> DataFrame:
        """The table with all its columns."""
        if self.in_catalog:
            return spark.table(self.catalog_name())
        return spark.read.parquet(self.location(spark))

    def state(self, spark: SparkSession) -> str:
        """What tells one state of the table from another: of files their names, sizes and times; of a view its plan's files."""
        if not self.in_catalog:
            return fingerprint(spark, self.location(spark))
        files = sorted(self.relation(spark).inputFiles())
        return hashlib.sha256("\n".join(f"{f} {fingerprint(spark, f)}" for f in files).encode()).hexdigest()

    def read(self, spark: SparkSession, k: int | None = None) -> DataFrame:
        """The hashes (column ``hash``), of k-size ``k`` if the entry names a column for it."""
        df = self.relation(spark)
        if self.ksize and k is not None:
            df = df.filter(named(self.ksize) == k)
        return df.select(named(self.column).cast("bigint").alias("hash"))

    def check(self, spark: SparkSession) -> None:
        """Whether the table and its columns are there, before anything is computed."""
        try:
            columns = self.relation(spark).columns
        except AnalysisException as e:
            raise ManifestError(f"{self.alias}: no table {self.table} in {self.path}: {str(e).splitlines()[0][:200]}") from e
        missing = [c for c in (self.column, self.ksize) if c and c.lower() not in [x.lower() for x in columns]]
        if missing:
            raise ManifestError(f"{self.alias}: {self.table} has no column {', '.join(missing)}, but {', '.join(columns)}")


def name_parts(name: str) -> list[str]:
    parts = [p for p in name.strip().split(".") if p]
    if not parts:
        raise ManifestError("a table needs a name")
    return parts


def split_table(name: str) -> tuple[str, str]:
    """Schema and table: the last two dotted parts; the schema is ``main`` if there is one part."""
    parts = name_parts(name)
    return (parts[-2] if len(parts) > 1 else "main"), parts[-1]


def load_manifest(spark: SparkSession, source: str | dict, *, one_left: bool = True) -> list[HashSet]:
    """Read and check a manifest: a dict, or the path of a JSON file."""
    if isinstance(source, str):
        text = "\n".join(r["value"] for r in spark.read.text(source, wholetext=True).collect())
        try:
            source = json.loads(text)
        except ValueError as e:
            raise ManifestError(f"not JSON: {e}") from e
    entries = source.get("databases") if isinstance(source, dict) else None
    if not isinstance(entries, list) or not entries:
        raise ManifestError("'databases' must be a list of entries")
    out: list[HashSet] = []
    for i, entry in enumerate(entries):
        if not isinstance(entry, dict):
            raise ManifestError(f"entry {i} must be an object")
        for key in ("alias", "path", "table", "column", "set_id"):
            if not isinstance(entry.get(key), str) or not entry[key].strip():
                raise ManifestError(f"entry {i}: '{key}' must be a non-empty string")
        if entry["set_id"] not in ("left", "right"):
            raise ManifestError(f"entry {i}: set_id must be left or right")
        if any(x.alias == entry["alias"] for x in out):
            raise ManifestError(f"entry {i}: alias {entry['alias']} occurs twice")
        if not (entry["path"] == CATALOG or entry["path"].startswith(f"{CATALOG}:")) and not exists(spark, entry["path"]):
            raise ManifestError(f"entry {i}: {entry['path']} doesn't exist")
        ksize = entry.get("ksize")
        out.append(HashSet(*(entry[k] for k in ("alias", "path", "table", "column", "set_id")), ksize.strip() if isinstance(ksize, str) and ksize.strip() else None))
    if one_left and sum(x.set_id == "left" for x in out) != 1:
        raise ManifestError("exactly one entry must be left")
    return out


def register(spark: SparkSession, sets: list[HashSet]) -> None:
    """A temporary view for each alias."""
    for item in sets:
        item.relation(spark).createOrReplaceTempView(item.alias)
