"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of a benchmark item (an item of fewer words,
but not none, is one window). Every window holds ``w = 13 - k + 1`` k-grams;
the smallest k-gram hash of a window is its fingerprint. A document keeps the
smallest k-gram hash of each of its own sliding windows of w k-grams, so any
shared span of 13 words or more has a fingerprint in common: none is missed.
Fingerprints that join with the benchmark's are seeds; each seed is extended to
the at most w windows that contain it, which are looked up by hash and then
compared word by word. No pairs of a document's and an item's positions are
made, so frequent passages cost no more than rare ones.

Scale: the benchmark's bytes are summed first. Up to ``block_bytes`` it goes to
every task as arrays of hashes and places in its text, about 30 bytes a word,
and the documents are passed once without a shuffle. A larger one is joined:
its windows are written by their hashes (128 bits), and their bits and those of
their fingerprints in a map of bounded size go to every task. One pass over the
documents writes the windows around those fingerprints that the map lets pass,
by the text's hash; these are joined with the benchmark's windows, and what is
found with the documents in a second pass. So passes don't grow with the
benchmark. Only windows that documents have are dealt out over salts, so that
one that many documents share isn't one task's. Long documents are handled in
pieces that overlap by 12 words.

Defined cases: null text has no words; an item without words is never hit; a
null item id counts as the id "" ; repeated item rows are one item; repeated
document rows give one result each; texts of any length are read whole;
decontaminate() returns its own columns alone and drop_contaminated() all of
the documents', whatever their names; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.tables import drop, written
from sketchloom.llm.textkit import PIECE_BYTES, Carried, Words, chunks, cuts, mix, pick, raw, split_words, spread, tidy, word_table, words_of

WINDOW_WORDS = 13
GRAM_WORDS = 5
#: Bytes of a benchmark up to which it goes to every task.
BLOCK_BYTES = 16 << 20
#: Bits of the map of a larger one for each window, and the most it may have, as a power of two: 128 MB.
MAP_BITS, MAP_LOG = 16, 30
#: Parts into which the documents of a window are dealt.
SALT = 64

_TABLE = word_table()
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_OTHER = np.uint64(0x5851F42D4C957F2D)
_SCALE = [np.uint64(2 * (0x632BE59BD9B4E019 * (j + 1) % (1 << 62)) + 1) for j in range(WINDOW_WORDS)]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (len(words) - k + 1 values)."""
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _SCALE[j]
    return total ^ (total >> np.uint64(29))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of values[i : i + w], by doubling."""
    have, out = 1, values
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the minimum of one of the windows of ``w`` grams over them (ties all count)."""
    if not len(grams):
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.full(w - 1, _NONE), grams, np.full(w - 1, _NONE)])
    least = sliding_min(padded, w)
    best = ~sliding_min(~least, w)
    return np.flatnonzero((best == grams) & (grams != _NONE))


@dataclass
class Lengths:
    """The benchmark's distinct windows of one length, in the order of their hashes."""

    words: int
    k: int
    prints: np.ndarray
    windows: np.ndarray
    start: np.ndarray  # where the window's words are in Index.text
    end: np.ndarray
    first: np.ndarray  # its items are items[first[i] : first[i + 1]]
    items: np.ndarray


@dataclass
class Index:
    """A benchmark's windows by length, its words with a space between them, and the items' names."""

    lengths: list[Lengths]
    text: bytes
    names: list[str]

    def items(self, found: set[tuple[int, int]]) -> list[str]:
        """Names of the items of some windows (place in ``lengths``, window), sorted."""
        held, size = [np.zeros(0, np.int32)], 0
        for part, i in found:
            length = self.lengths[part]
            held.append(length.items[length.first[i] : length.first[i + 1]])
            size += len(held[-1])
            if size > 1 << 20:
                held = [np.unique(np.concatenate(held))]
                size = 0
        return sorted(self.names[i] for i in np.unique(np.concatenate(held)).tolist())


def _spaced(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``data``, each with a space after it, and where they start there."""
    length = words.end - words.start
    start = np.cumsum(length + 1) - length - 1
    out = np.full(int((length + 1).sum()), 32, np.uint8)
    out[spread(start, length)] = _TABLE[data[spread(words.start, length)]]
    return out, start


def build_index(items: pa.Table) -> Index:
    """The index of a table (item, text)."""
    names = items.column("item").combine_chunks().dictionary_encode()
    text, start, length, hashes, row, bytes_, at = [], [], [], [], [], 0, 0
    for part in chunks(items.select(["text"]).to_batches()):
        data, offsets = raw(part.column("text"))
        w = words_of(data, offsets, _TABLE)
        spaced, first = _spaced(data, w)
        text.append(spaced.tobytes())
        start.append(first + bytes_)
        length.append((w.end - w.start).astype(np.int32))
        hashes.append(w.hash)
        row.append((w.row + at).astype(np.int32))
        bytes_, at = bytes_ + len(spaced), at + part.num_rows
    if not bytes_:
        return Index([], b"", names.dictionary.to_pylist())
    start, length, hashes, row = (np.concatenate(x) for x in (start, length, hashes, row))
    kind = np.uint32 if bytes_ < 1 << 32 else np.int64
    start, end = start.astype(kind), (start + length).astype(kind)
    del length
    count = np.bincount(row, minlength=at)
    first = np.cumsum(count) - count
    other = mix(hashes ^ _OTHER)  # windows are told apart by 128 bits here
    item = names.indices.to_numpy()
    out = []
    for n in np.unique(np.minimum(count[count > 0], WINDOW_WORDS)).tolist():
        if n < WINDOW_WORDS:
            place = first[count == n]
        else:
            place = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        k = min(GRAM_WORDS, n)
        prints = np.unique(_prints(hashes, place, n))
        whole, more, of = gram_hashes_at(hashes, place, n), gram_hashes_at(other, place, n), item[row[place]]
        order = np.lexsort((of, more, whole))
        place, whole, more, of = place[order], whole[order], more[order], of[order]
        new = np.ones(len(place), bool)
        new[1:] = (whole[1:] != whole[:-1]) | (more[1:] != more[:-1])
        entry = new.copy()
        entry[1:] |= of[1:] != of[:-1]
        distinct = place[new]
        bounds = np.append(np.flatnonzero(new[entry]), int(entry.sum()))
        out.append(Lengths(n, k, prints, whole[new], start[distinct], end[distinct + n - 1], bounds.astype(np.int64 if len(place) >> 31 else np.int32), of[entry].astype(np.int32)))
    return Index(out, b"".join(text), names.dictionary.to_pylist())


#: Occurrences in some texts: (row, first word, number of words, window).
Found = list[tuple[int, int, int, tuple[int, int]]]


def _seeded(words: Words, lengths: list[tuple[int, int]], known: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each (number of words, k): its place, and where windows of so many words start that hold a fingerprint that is ``known``."""
    grams: dict[int, np.ndarray] = {}
    for number, (size, k) in enumerate(lengths):
        if k not in grams:
            g = gram_hashes(words.hash, k)
            if len(g):
                g[words.row[: len(g)] != words.row[k - 1 :]] = _NONE
            grams[k] = g
        g, w = grams[k], size - k + 1
        at = winnow(g, w)
        if len(at):
            at = at[known(number, g[at])]
        if not len(at):
            continue
        start = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
        start = start[(start >= 0) & (start + size <= len(words.row))]
        yield number, start[words.row[start] == words.row[start + size - 1]]


def _place(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where the values asked for are in sorted ones, or would be."""
    return np.minimum(np.searchsorted(values, asked), len(values) - 1)


def _search(data: np.ndarray, offsets: np.ndarray, index: Index) -> tuple[np.ndarray, Found]:
    """Words per row, and the occurrences of the index's windows (place in ``lengths``, window)."""
    words = words_of(data, offsets, _TABLE)
    count = np.bincount(words.row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    found = []
    prints = [part.prints for part in index.lengths]
    for number, start in _seeded(words, [(part.words, part.k) for part in index.lengths], lambda i, h: prints[i][_place(prints[i], h)] == h):
        part = index.lengths[number]
        whole = gram_hashes_at(words.hash, start, part.words)
        slot = _place(part.windows, whole)
        for s, i, h in zip(*(x[part.windows[slot] == whole].tolist() for x in (start, slot, whole))):
            text = b" ".join(split_words(data[words.start[s] : words.end[s + part.words - 1]].tobytes()))
            while i < len(part.windows) and int(part.windows[i]) == h:
                if text == index.text[part.start[i] : part.end[i]]:
                    row = int(words.row[s])
                    found.append((row, s - int(first[row]), part.words, (number, i)))
                    break
                i += 1
    return count, found


def gram_hashes_at(words: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """As gram_hashes, for some positions."""
    total = np.zeros(len(start), np.uint64)
    for j in range(k):
        total += words[start + j] * _SCALE[j]
    return total ^ (total >> np.uint64(29))


def _prints(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints of the windows of n words from some positions on."""
    k = min(GRAM_WORDS, n)
    least = gram_hashes_at(words, start, k)
    for j in range(1, n - k + 1):
        np.minimum(least, gram_hashes_at(words, start + j, k), out=least)
    return least


def _pieces(data: np.ndarray, search: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, Found]], piece: int) -> tuple[int, Found]:
    """As ``search`` for one long text, piece after piece with 12 words of overlap."""
    at, base, found = 0, 0, []
    while True:
        to = at + piece
        while to < len(data):
            stop = np.flatnonzero(_TABLE[data[to : to + piece]] == 0)
            if len(stop):
                to += int(stop[0])
                break
            to += piece
        to = min(to, len(data))
        part = data[at:to]
        ends = np.array([0, len(part)])
        count, hits = search(part, ends)
        found += [(0, base + s, n, g) for _, s, n, g in hits]
        if to >= len(data):
            return base + int(count[0]), found
        starts = words_of(part, ends, _TABLE).start
        back = min(WINDOW_WORDS - 1, max(0, len(starts) - 1))
        if back:
            at, base = at + int(starts[len(starts) - back]), base + len(starts) - back
        else:
            at, base = to, base + len(starts)


def _union(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


_SCHEMA = "doc_id bigint, n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>"
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _texts(text: pa.Array, search: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, Found]], piece: int) -> tuple[np.ndarray, Found]:
    """As ``search`` for a chunk of texts, in pieces if it is one long text."""
    data, offsets = raw(text)
    if len(offsets) == 2 and len(data) > piece:
        n, found = _pieces(data, search, piece)
        return np.array([n]), found
    return search(data, offsets)


def _found(text: pa.Array, index: Index, piece: int) -> tuple[np.ndarray, list[set[tuple[int, int]]], list[set[tuple[int, int]]]]:
    """Words, hit spans, and windows hit, of each text."""
    count, found = _texts(text, lambda data, offsets: _search(data, offsets, index), piece)
    rows = len(count)
    spans, windows = [set() for _ in range(rows)], [set() for _ in range(rows)]
    for row, start, n, window in found:
        spans[row].add((start, start + n))
        windows[row].add(window)
    return count, spans, windows


def _arrays(spans: list[set[tuple[int, int]]], items: list[list[str]]) -> list[pa.Array]:
    return [pa.array([[{"start": a, "end": b} for a, b in _union(x)] for x in spans], _HITS), pa.array(items, pa.list_(pa.string()))]


@dataclass
class Sieve:
    """A bit for each window of a benchmark and each of their fingerprints, at the upper ``log`` bits of their hashes."""

    sizes: list[int]
    bits: np.ndarray
    log: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.log)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _keyed(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of windows of n words, or of their fingerprints, that differ for other n and are spread over all bits."""
    return mix(hashes ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))


_WINDOWS = "n int, whole bigint, other bigint, seed bigint, item string"
_CANDIDATES = "node binary, n int, whole bigint, other bigint, start bigint"
_KEY = ["n", "whole", "other"]


def _windows(piece: int):
    """Of (item, text), all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = raw(batch.column("text"))
            if batch.num_rows == 1:
                hashes = np.concatenate([words_of(data[a:b], np.array([0, b - a]), _TABLE).hash for a, b in cuts(data, _TABLE, piece)])
                row = np.zeros(len(hashes), np.int64)
            else:
                words = words_of(data, offsets, _TABLE)
                hashes, row = words.hash, words.row
            other = mix(hashes ^ _OTHER)
            count = np.bincount(row, minlength=batch.num_rows)
            first = np.cumsum(count) - count
            for n in np.unique(np.minimum(count[count > 0], WINDOW_WORDS)).tolist():
                place = first[count == n] if n < WINDOW_WORDS else np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
                for i in range(0, len(place), 1 << 17):
                    at = place[i : i + (1 << 17)]
                    keys = [_keyed(gram_hashes_at(hashes, at, n), n), gram_hashes_at(other, at, n), _keyed(_prints(hashes, at, n), n)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), *(pa.array(x.view(np.int64)) for x in keys), batch.column("item").take(pa.array(row[at]))], ["n", "whole", "other", "seed", "item"])

    return run


def _possible(data: np.ndarray, offsets: np.ndarray, sieve: Sieve) -> tuple[np.ndarray, Found]:
    """Words per row, and the windows (by their hashes) that a benchmark may have."""
    words = words_of(data, offsets, _TABLE)
    other = mix(words.hash ^ _OTHER)
    count = np.bincount(words.row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    found = []
    for number, start in _seeded(words, [(n, min(GRAM_WORDS, n)) for n in sieve.sizes], lambda i, h: sieve.has(_keyed(h, sieve.sizes[i]))):
        n = sieve.sizes[number]
        whole = _keyed(gram_hashes_at(words.hash, start, n), n)
        some = sieve.has(whole)
        start, whole = start[some], whole[some]
        more, row = gram_hashes_at(other, start, n), words.row[start]
        found += [(r, s, n, key) for r, s, key in zip(row.tolist(), (start - first[row]).tolist(), zip(whole.view(np.int64).tolist(), more.view(np.int64).tolist()))]
    return count, found


def _candidates(sieve, piece: int):
    """Of (node, text), the windows that the benchmark may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, found = _texts(batch.column("text"), lambda data, offsets: _possible(data, offsets, sieve.value), piece)
            if not found:
                continue
            row, start, n, key = zip(*found)
            whole, other = zip(*key)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row, pa.int64())), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (whole, other, start))], ["node", *_KEY, "start"])

    return run


def _sieve(windows: DataFrame) -> Sieve:
    """The bit map of all windows: at most 2^MAP_LOG bits, which come as words of 64 with their places."""
    sizes = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # 13 rows at most
    log = min(MAP_LOG, max(16, (MAP_BITS * sum(sizes.values())).bit_length()))
    at = windows.select(F.explode(F.array(*[F.shiftrightunsigned(c, 64 - log) for c in ("whole", "seed")])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << log - 6, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Sieve(sorted(sizes), bits, log)


def _joined(texts: DataFrame, items: DataFrame, piece: int) -> DataFrame:
    """(node, hits, items) of texts (node, text) that have windows of a benchmark of any size; hits may overlap."""
    spark = texts.sparkSession
    windows, windows_at = written(items.mapInArrow(tidy(_windows(piece)), _WINDOWS).distinct(), "windows")
    sieve = spark.sparkContext.broadcast(_sieve(windows))
    # copies of a text have the same windows
    found, found_at = written(texts.mapInArrow(tidy(_candidates(sieve, piece)), _CANDIDATES).distinct(), "candidates")
    sieve.destroy()
    met, met_at = written(windows.join(found.select(_KEY).distinct(), _KEY, "left_semi").select(*_KEY, "item"), "met")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    spans = dealt.join(met.select(_KEY).distinct().select(*_KEY, salts), [*_KEY, "salt"], "left_semi").select("node", F.struct("start", (F.col("start") + F.col("n")).alias("end")).alias("hit"))
    named = dealt.select("node", *_KEY, "salt").distinct().join(met.select(*_KEY, "item", salts), [*_KEY, "salt"]).select("node", "item").distinct()
    hits = spans.groupBy("node").agg(F.collect_set("hit").alias("hits")).join(named.groupBy("node").agg(F.collect_list("item").alias("items")), "node")
    out, _ = written(hits, "hits")
    for path in (windows_at, found_at, met_at):
        drop(spark, path)
    return out


def _scan(index, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            count, spans, windows = _found(batch.column("text"), index.value, piece)
            items = [index.value.items(x) if x else [] for x in windows]
            if "hits" in batch.schema.names:  # found by the join
                for i, (hits, names) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist())):
                    if hits:
                        spans[i].update((x["start"], x["end"]) for x in hits)
                        items[i] = sorted({*items[i], *names})
            more = [c for c in batch.schema.names if c.startswith("__c")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), *_arrays(spans, items), *(batch.column(c) for c in more)], ["doc_id", "n_words", "hits", "items", *more])

    return run


def _run(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int, piece_bytes: int, ddl: str = "") -> DataFrame:
    """rows: doc_id, text and carried columns, whose types are ``ddl``."""
    spark = rows.sparkSession
    items = pick(benchmark, item=item_id, text=item_text).select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("size")).first()["size"]
    if size <= block_bytes:
        index = build_index(items.toArrow())
    else:
        index = Index([], b"", [])
        rows = rows.withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        rows = rows.join(_joined(rows.select("node", "text"), items, piece_bytes), "node", "left").drop("node")
    out = rows.mapInArrow(tidy(_scan(spark.sparkContext.broadcast(index), piece_bytes)), _SCHEMA + ddl)
    return out.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, x: total + x["end"] - x["start"])).withColumn("n_items", F.size("items").cast("bigint"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, hits (maximal runs of hit words), items (ids, sorted), n_hit, n_items."""
    return _run(pick(docs, doc_id=doc_id, text=text), benchmark, item_id, item_text, block_bytes, piece_bytes)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of ``docs``, unchanged, that are not contaminated."""
    carried = Carried(docs)
    rows = docs.select(F.lit(0).cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), *carried.columns)
    return carried.back(_run(rows, benchmark, item_id, item_text, block_bytes, piece_bytes, carried.ddl).filter(~is_contaminated()))


def is_contaminated() -> F.Column:
    """The contract's rule: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
