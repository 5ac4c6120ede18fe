"""Contigs and k-mer matches by accession: addresses opened, unpacked and read where the tasks run.

Everything begins with a table (accession, address). An accession is what that
table says, whatever the files are called, and goes with every row that is read.
Files are read as streams, a record at a time, so their size doesn't matter; a
single record is held whole. What goes wrong with one address is a row of its
own accession with a ``problem``, and doesn't stop the others.
"""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.hashing import gate
from sketchloom.schemas import MAX_HASH
from sketchloom.sources import streams
from sketchloom.sources.files import children

#: Header names of k-mer match files, in order of preference (fixed values).
SEQUENCE_NAMES = ("sequence_name", "name", "sequence", "seqname")
HASH_NAMES = ("hashval", "hash")

#: Endings that a file's name has beside the accession.
_ENDINGS = re.compile(r"(\.contigs|\.unitigs|\.kmer-matches)?(\.(fasta|fa|fna|csv))?(\.(zst|gz))?/?$")
#: Bytes of sequences and rows that a batch holds, and times that an address is tried.
_BATCH_BYTES, _BATCH_ROWS, TRIES = 8 << 20, 20_000, 3

ADDRESSES = "accession string, address string"
_CONTIGS = "accession string, contig string, sequence string, problem string"
_MATCHES = "accession string, contig string, hash bigint, problem string"

Opener = Callable[[str], object]


def accession_of(path: str) -> str:
    """The accession of a path that is given without one: its last part without the endings of such files."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return _ENDINGS.sub("", name) or name


def addresses(spark: SparkSession, given: Iterable[str] | dict[str, str | list[str]]) -> DataFrame:
    """(accession, address) of paths, by accession or with it as part of their names."""
    if isinstance(given, dict):
        rows = [(a, p) for a, paths in given.items() for p in ([paths] if isinstance(paths, str) else paths)]
    else:
        rows = [(accession_of(p), p) for p in given]
    return spark.createDataFrame(rows, ADDRESSES)


def templated(accessions: DataFrame, url: str) -> DataFrame:
    """(accession, address) by an address with {acc} in it."""
    return accessions.select("accession", F.replace(F.lit(url), F.lit("{acc}"), F.col("accession")).alias("address"))


def _listed(address: str) -> list[str]:
    """The files of a folder that tasks can look into, without hidden ones; else the address itself."""
    if streams.scheme(address) in ("", "file"):
        path = streams.local(address)
        if os.path.isdir(path):
            return sorted(f"{address.rstrip('/')}/{n}" for n in os.listdir(path) if not n.startswith((".", "_")) and os.path.isfile(f"{path}/{n}"))
    elif streams.scheme(address) in streams.STORES:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(address)
        if store.get_file_info(path).type == fs.FileType.Directory:
            names = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
            return sorted(f"{address.rstrip('/')}/{n.rsplit('/', 1)[-1]}" for n in names)
    return [address]


def _said(what: str, e: Exception) -> str:
    return f"{what}: {type(e).__name__}: {e}"[:300]


def _tried(address: str, opener: Opener, tries: int):
    """What the opener gives, or what was wrong with the last try."""
    for left in range(tries - 1, -1, -1):
        try:
            return opener(address), None
        except FileNotFoundError:
            return None, f"no file {address}"
        except Exception as e:  # whatever an opener raises, the last try's error is the answer
            if not left:
                return None, _said("fetch failed", e)
    raise ValueError("at least one try is needed")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for accession, address in zip(batch.column("accession").to_pylist(), batch.column("address").to_pylist()):
            try:
                rows += [(accession, f) for f in _listed(address)]
            except Exception:  # opening it will say what is wrong
                rows.append((accession, address))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["accession", "address"])


def _read(parse, kinds: list[tuple[str, pa.DataType]], opener: Opener, tries: int):
    """For mapInArrow: the rows that ``parse`` makes of each address's stream, or one that says what was wrong.

    A stream that breaks off is opened again; the rows that are out already aren't given twice.
    """
    names = [n for n, _ in kinds]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            contents = batch.column("content").to_pylist() if "content" in batch.schema.names else [None] * batch.num_rows
            for accession, address, content in zip(batch.column("accession").to_pylist(), batch.column("address").to_pylist(), contents):
                done = 0
                for left in range(tries - 1, -1, -1):
                    source, problem = (streams.in_memory(content), None) if content is not None else _tried(address, opener, tries)
                    if problem:
                        rows.append((accession, None, None, problem))
                        break
                    try:
                        with source:
                            for i, (contig, value, bad) in enumerate(parse(streams.unpacked(source, address))):
                                if i < done:
                                    continue
                                rows.append((accession, contig, value, bad))
                                done += 1
                                size += len(value) if isinstance(value, str) else 0
                                if size > _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                                    yield batch_of(rows)
                                    rows, size = [], 0
                        break
                    except OSError as e:  # the network or the disk
                        if not left or isinstance(e, EOFError) or "BadGzipFile" in type(e).__name__:
                            rows.append((accession, None, None, _said("not readable", e)))
                            break
                    except Exception as e:  # any decoder's or parser's error is this address's own
                        rows.append((accession, None, None, _said("not readable", e)))
                        break
        if rows:
            yield batch_of(rows)

    return run


def _opened(where: DataFrame, parse, schema: str, kinds, opener: Opener | None, tries: int) -> DataFrame:
    """Rows of all addresses, each file of a folder by itself."""
    run = _read(parse, kinds, opener or streams.open_address, tries)
    own = F.lower(F.regexp_extract("address", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*streams.OWN) if opener is None else F.lit(True)
    # a task for a few files each; their number is small beside what they hold, so it isn't left to the size of the table
    tasks = 4 * where.sparkSession.sparkContext.defaultParallelism
    files = where.filter(own).mapInArrow(_files, ADDRESSES) if opener is None else where
    rows = files.repartition(tasks).mapInArrow(run, schema)
    if opener is None and (others := where.filter(~own).collect()):
        # stores that only Spark's file systems reach: these files are read whole
        spark = where.sparkSession
        found = [(r["accession"], f) for r in others for f in (children(spark, r["address"]) or [r["address"]])]
        named = spark.createDataFrame(found, ADDRESSES)
        content = spark.read.format("binaryFile").load([f for _, f in found]).select(F.col("path"), "content")
        rows = rows.unionByName(named.join(content, F.col("address") == F.col("path")).select("accession", "address", "content").mapInArrow(run, schema))
    return rows


def records(lines: Iterable[bytes]) -> Iterator[tuple[str, str]]:
    """(id, sequence in capitals) of FASTA lines."""
    name, parts = None, []
    for line in lines:
        if line.startswith(b">"):
            if name is not None:
                yield name, b"".join(parts).decode("utf-8", "replace").upper()
            name, parts = (line[1:].split() or [b""])[0].decode("utf-8", "replace"), []
        elif name is not None:
            parts.append(b"".join(line.split()))
    if name is not None:
        yield name, b"".join(parts).decode("utf-8", "replace").upper()


def _contigs(parts: Iterator[bytes]):
    for contig, sequence in records(streams.lines(parts)):
        yield contig, sequence, None


def read_contigs(where: DataFrame, *, opener: Opener | None = None, tries: int = TRIES) -> DataFrame:
    """(accession, contig, sequence, contig_length, problem) of FASTA at (accession, address): a row for each record, or one that says what was wrong.

    ``opener`` gives a binary stream for an address; without it files, web addresses and object stores are opened by the
    tasks. Endings .gz and .zst are unpacked on the way.
    """
    kinds = [("accession", pa.string()), ("contig", pa.string()), ("sequence", pa.string()), ("problem", pa.string())]
    rows = _opened(where, _contigs, _CONTIGS, kinds, opener, tries)
    return rows.select("accession", "contig", "sequence", F.length("sequence").alias("contig_length"), "problem")


def checked(rows: DataFrame) -> DataFrame:
    """Rows without the column ``problem``; the first problem met is an error."""
    good = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("accession"), F.lit(": "), F.col("problem"))))
    return rows.filter(good).drop("problem")


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(accession, contig, sequence, contig_length) of FASTA files whose names say the accession; what can't be read is an error."""
    return checked(read_contigs(addresses(spark, paths)))


def _matches(parts: Iterator[bytes]):
    rows = csv.reader(line.decode("utf-8", "replace").rstrip("\r") for line in streams.lines(parts))
    header = next(rows, None)
    if header is None:
        return
    lower = [h.strip().lower() for h in header]
    at = [next((lower.index(n) for n in names if n in lower), None) for names in (SEQUENCE_NAMES, HASH_NAMES)]
    if None in at:
        raise ValueError(f"no sequence or hash column among {header}")
    for row in rows:
        if not row:
            continue
        name, text = (row[i] if i < len(row) else "" for i in at)
        try:
            value = int(text.strip())
            value = value - (1 << 64) if 1 << 63 <= value < 1 << 64 else value if -(1 << 63) <= value < 1 << 63 else None
        except ValueError:
            value = None
        if not name or value is None:
            yield None, None, LEFT_OUT
        else:
            yield name, value, None


#: The problem of single rows of match files.
LEFT_OUT = "no contig or no number"


def read_match_rows(where: DataFrame, *, opener: Opener | None = None, tries: int = TRIES) -> DataFrame:
    """(accession, contig, hash, problem) of k-mer match CSVs at (accession, address), each file with a header of its own; a row without a contig or a number has LEFT_OUT as its problem."""
    kinds = [("accession", pa.string()), ("contig", pa.string()), ("hash", pa.int64()), ("problem", pa.string())]
    return _opened(where, _matches, _MATCHES, kinds, opener, tries)


def usable(rows: DataFrame, most: int = MAX_HASH) -> DataFrame:
    """(accession, contig, hash) of the rows that have all of it, within the gate."""
    return rows.filter(F.col("problem").isNull() & gate(F.col("hash"), most)).select("accession", "contig", "hash")


def read_matches(spark: SparkSession, *paths: str, most: int = MAX_HASH) -> DataFrame:
    """(accession, contig, hash) of k-mer match CSVs whose names say the accession; rows without a number as hash, or beyond the gate, are left out (see :func:`left_out`)."""
    rows = read_match_rows(addresses(spark, paths))
    whole = F.when(F.col("problem").isNull() | (F.col("problem") == LEFT_OUT), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("accession"), F.lit(": "), F.col("problem"))))
    return usable(rows.filter(whole), most)


def left_out(rows: DataFrame) -> DataFrame:
    """(accession, n_left_out): how many rows of each accession's match CSVs have no contig or no number as hash."""
    return rows.filter(F.col("problem") == LEFT_OUT).groupBy("accession").agg(F.count("*").alias("n_left_out"))
