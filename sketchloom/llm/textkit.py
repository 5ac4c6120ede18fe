"""Shared pieces of the training-data operators: column picking, Arrow chunks, word spans.

Every operator takes a DataFrame plus the names of its id and text columns and
first narrows it with :func:`pick`; all further columns, whatever their names,
therefore cannot clash with those the operator makes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; temporaries take about 50 times as much.
CHUNK_BYTES = 1 << 20
#: Documents longer than this are cut at separators where an operator can do so.
PIECE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes of an Arrow batch that goes to a Python worker, where the session has no value of its own.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def limit_batches(spark) -> None:
    """Bound Arrow batches by bytes, as a number of rows bounds nothing when texts are long."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Narrow ``df`` to the named columns: pick(df, doc_id="id", text="body")."""
    limit_batches(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


class Carried:
    """All columns of a DataFrame under names of our own, beside picked ones, and back again."""

    def __init__(self, df: DataFrame):
        limit_batches(df.sparkSession)
        self.names = df.columns
        self.columns = [F.col(f"`{n}`").alias(f"__c{i}") for i, n in enumerate(df.columns)]
        self.ddl = "".join(f", __c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"__c{i}").alias(n) for i, n in enumerate(self.names)])


def word_table() -> np.ndarray:
    """Bytes of words (digits, letters with A-Z lowered, all of 128 and over), 0 for separators."""
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x61:0x7B] = keep[0x41:0x5B] = keep[0x80:] = True
    return np.where(keep, _LOWER, 0).astype(np.uint8)


#: Separators are spaces here, so that bytes.split() finds the words of word_table().
WORD_BYTES = bytes(np.where(word_table() == 0, 32, word_table()).astype(np.uint8))


def split_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 ``text`` with A-Z lowered."""
    return text.translate(WORD_BYTES).split()


def text_of(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column`` each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def cuts(data: np.ndarray, table: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that cover a text and begin at separators (0 in ``table``), so that no word is cut."""
    at = 0
    while True:
        to = at + most
        while to < len(data):
            stop = np.flatnonzero(table[data[to : to + most]] == 0)
            if len(stop):
                to += int(stop[0])
                break
            to += most
        to = min(to, len(data))
        yield at, to
        if to >= len(data):
            return
        at = to


#: What operators keep between the tasks of a worker; dropped when it goes on to another operator.
CACHES: list[dict] = []


def tidy(run, keep: bool = False):
    """``run`` for mapInArrow, after which a worker gives back the memory that it doesn't use; ``keep``: it goes on using CACHES."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            for cache in CACHES:
                cache.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Free memory goes from this process to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@dataclass
class Words:
    """Word spans of a run of texts; ``row`` is each word's row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


_P = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words longer than this are hashed one by one.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Spans and 64-bit hashes of the words of each row; ``table`` maps separators to 0."""
    folded = np.frombuffer(data.tobytes().translate(table.tobytes()), np.uint8)
    n = len(folded)
    inside = np.zeros(n + 1, np.int8)
    inside[:n] = folded != 0
    change = np.empty(n + 1, np.int8)
    change[0], change[1:] = inside[0], inside[1:] - inside[:-1]
    # a text that begins inside of a word ends the one before it
    inner = offsets[(offsets > 0) & (offsets < n)]
    both = inner[(inside[inner] != 0) & (inside[inner - 1] != 0)] if len(inner) else inner
    start, end = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
    if len(both):
        both = np.unique(both)
        start, end = np.sort(np.concatenate([start, both])), np.sort(np.concatenate([end, both]))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return Words(start, end, row, span_hashes(folded, start, end))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of some spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    # eight bytes of each span at a time, read at any offset
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = length.astype(np.uint64) * _P
    h = _round(h, eights[start] & _MASK[np.minimum(length, 8)])
    at, most = np.flatnonzero(length > 8), 8
    while len(at) and most < _LONG:
        h[at] = _round(h[at], eights[start[at] + most] & _MASK[np.minimum(length[at] - most, 8)])
        most += 8
        at = at[length[at] > most]
    for i in at.tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return mix(h)


def _round(h: np.ndarray, eight: np.ndarray) -> np.ndarray:
    h = (h ^ eight) * _P
    return h ^ (h >> np.uint64(29))


_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, at a cost that doesn't grow with k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words) - 1, _P, np.uint64)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P_INVERSE, np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power)])
    return mix((sums[k:] - sums[:-k]) * back)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, start + length), range after range."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
