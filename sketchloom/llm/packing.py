"""Packing by lexical retrieval: a sharded BM25 index fills windows with neighbours.

Documents are dealt to shards by content: by the word with the smallest hash,
which two documents share as often as they share words (a min-hash), so that
lexical neighbours meet. A shard's inverted index maps words to postings with
BM25 weights, whose document frequencies and mean length are those of all
documents. A seed document starts a window; the rest of the window is filled
with the unused documents that all of its words rank highest, or the next unused
ones where none shares a word. What doesn't fit is cut, and the remainder starts
the next window as its seed. Only the last window of a shard is not full.

Shards: the bytes of documents with each smallest hash are counted in ``KEYS``
bins, and whole bins, in order, make up shards of about ``SHARD_BYTES``. A bin
of more than that has shards of its own, among which a second min-hash deals;
and a pair of both bins that is still too much (copies without end) is spread by
id and text, so no shard is hot.

Scale: one counting pass, whose result is bounded by ``TERMS`` and ``KEYS``
numbers, one pass that deals, and one exchange of the texts. Whatever lands in a
shard is worked off in blocks of at most four times its size, so memory is
bounded even if equal rows pile up. The longest single text is the one thing
that must fit. Document frequencies are counted in ``TERMS`` bins of words'
hashes, so a rare word's is at most that of all words of its bin.

Defined cases: null text is empty, an empty document is its end id; null ids and
repeated rows are packed like any other; documents without words go by id alone;
of neighbours of equal score the first in the shard's order is taken; further
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.textkit import chunks, give_back, mix, pick, raw, spread, tidy, word_table, words_of
from sketchloom.llm.tokens import collector_off, encoder

WINDOW = 1024
TERMS = 1 << 22
#: Bins of the smallest word hashes.
KEYS = 1 << 18
K1, B = 1.2, 0.75
SHARD_BYTES = 6 << 20
#: Words that at least one in so many documents of a block has are scored by whole rows instead of postings.
DENSE = 8
#: Postings that are weighted at once.
STEP = 1 << 18
#: Scores by frequent words are made for all pairs of a block at once, where these are not more than this.
PAIRS = 1 << 23

_TABLE = word_table()


def _bin(hashes: np.ndarray, bins: int = TERMS) -> np.ndarray:
    return (hashes >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)


def _counted(row: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = max(1, terms - 1).bit_length()  # shifts cost much less than divisions
    key = row.astype(np.int64)
    key <<= bits
    key |= term
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(at.astype(np.int32), np.int32(len(key))))
    key = key[at]
    return (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32), count


def least_words(hash_: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the smallest of its words' hashes under two orders; without words the largest number there is."""
    out = []
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        least = np.full(rows, np.iinfo(np.uint64).max, np.uint64)
        if len(row):
            least[row[first]] = np.minimum.reduceat(mix(hash_ ^ np.uint64(seed)), first)
        out.append(least)
    return tuple(out)


def key_bins(least: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the first smallest hash, of the second, and of both."""
    one, two = (mix(x + np.uint64(1)) for x in least)  # smallest hashes crowd near zero: hashed again
    return _bin(one, KEYS), _bin(two, KEYS), _bin(mix(one ^ mix(two)), KEYS)


#: What the counting pass counts, beside documents by word: documents, words, bytes; bytes by first bin and by both.
_WORD, _TOTAL, _FIRST, _BOTH = range(4)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TERMS, np.int32)
    first, both, sums = np.zeros(KEYS, np.int64), np.zeros(KEYS, np.int64), np.zeros(3, np.int64)
    for batch in chunks(batches):
        data, offsets = raw(batch.column("text"))
        w = words_of(data, offsets, _TABLE)
        terms = np.sort(_counted(w.row, _bin(w.hash), TERMS)[1])
        new = np.flatnonzero(np.diff(terms, prepend=-1))
        total[terms[new]] += np.diff(new, append=len(terms)).astype(np.int32)
        size = np.diff(offsets)
        one, _, pair = key_bins(least_words(w.hash, w.row, batch.num_rows))
        np.add.at(first, one, size)
        np.add.at(both, pair, size)
        sums += (batch.num_rows, len(w.hash), len(data))
    if sums[0]:
        kinds = [(_WORD, total), (_TOTAL, sums), (_FIRST, first), (_BOTH, both)]
        at = [np.flatnonzero(x) for _, x in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _ in kinds], [len(x) for x in at]).astype(np.int32)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate([x[i].astype(np.int64) for (_, x), i in zip(kinds, at)]))], ["kind", "bin", "n"])


@dataclass
class Statistics:
    """Of all documents: inverse document frequencies by word bin, mean number of words, bytes, and bytes by key bins."""

    idf: np.ndarray
    mean: float
    size: int
    first: np.ndarray
    both: np.ndarray


def statistics(docs: DataFrame, *, text: str = "text") -> Statistics:
    """One counting pass; what reaches the driver has at most a number a bin."""
    rows = pick(docs, text=text).mapInArrow(tidy(_frequencies), "kind int, bin int, n bigint").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (rows.column(c).to_numpy() for c in ("kind", "bin", "n"))

    def filled(which: int, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        out[at[kind == which]] = n[kind == which]
        return out

    count, words, size = filled(_TOTAL, 3).tolist()
    df = filled(_WORD, TERMS)
    return Statistics(np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32), max(1.0, words / max(1, count)), size, filled(_FIRST, KEYS), filled(_BOTH, KEYS))


@dataclass
class Dealer:
    """Which shard a document goes to: the first of its bin, how many of them the bin has, and over how many a pair of bins is spread."""

    start: np.ndarray
    shards: np.ndarray
    spread: np.ndarray
    count: int

    @classmethod
    def of(cls, stats: Statistics, shard_bytes: int) -> Dealer:
        own = np.where(stats.first >= shard_bytes, -(-stats.first // shard_bytes), 0)
        small = np.where(own > 0, 0, stats.first)
        # shards of small bins are numbered first, by the bytes before each bin
        start = (np.cumsum(small) - small) // shard_bytes
        common = int(start.max()) + 1
        start[own > 0] = common + (np.cumsum(own) - own)[own > 0]
        return cls(start.astype(np.int64), np.maximum(own, 1), np.maximum(1, -(-stats.both // shard_bytes)), common + int(own.sum()))

    def shard(self, least: tuple[np.ndarray, np.ndarray], tie: np.ndarray) -> np.ndarray:
        one, two, both = key_bins(least)
        return self.start[one] + (two + tie % self.spread[both]) % self.shards[one]


def _deal(dealer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = raw(batch.column("text"))
            w = words_of(data, offsets, _TABLE)
            tie = batch.column("tie").to_numpy().view(np.uint64) >> np.uint64(1)
            shard = dealer.value.shard(least_words(w.hash, w.row, batch.num_rows), tie.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("tie"), pa.array(shard)], ["doc_id", "text", "tie", "shard"])

    return run


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, and how many each text has."""
    w = words_of(data, offsets, _TABLE)
    return w.hash, np.bincount(w.row, minlength=len(offsets) - 1)


class Shard:
    """A BM25 inverted index over the texts of a block; ``neighbours`` ranks unused documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, idf: np.ndarray, mean: float):
        hash_, length = hashed(data, offsets)
        self._fill([hash_], length, idf, mean)

    @classmethod
    def of(cls, hashes: list[np.ndarray], length: np.ndarray, idf: np.ndarray, mean: float) -> Shard:
        """From what :func:`hashed` gave for the texts, run after run; ``hashes`` is emptied."""
        shard = cls.__new__(cls)
        shard._fill(hashes, length, idf, mean)
        return shard

    def _fill(self, hashes: list[np.ndarray], length: np.ndarray, idf: np.ndarray, mean: float) -> None:
        # what isn't needed any more goes at once: a block's words take several times its bytes
        self.n = n = len(length)
        coded = pa.chunked_array([pa.array(x) for x in hashes], pa.uint64()).dictionary_encode()
        hashes.clear()
        real = coded.chunk(0).dictionary.to_numpy() if coded.num_chunks else np.zeros(0, np.uint64)
        word = np.concatenate([np.zeros(0, np.int32), *(x.indices.to_numpy() for x in coded.chunks)])
        idf, terms = idf[_bin(real)], max(1, len(real))
        coded = real = None
        give_back()
        row, term, tf = _counted(np.repeat(np.arange(n, dtype=np.int32), length), word, terms)
        word = None
        norm, weight = K1 * (1 - B + B * length / mean), np.empty(len(row), np.float32)
        for at in range(0, len(row), STEP):
            part = slice(at, at + STEP)
            weight[part] = (tf[part] * (K1 + 1) / (tf[part] + norm[row[part]])).astype(np.float32) * idf[term[part]]
        order = term.astype(np.int64)  # by term, then by row
        tf = term = None
        order <<= 32
        order |= np.arange(len(order))
        order.sort()
        ordered = (order >> 32).astype(np.int32)
        order &= 0xFFFFFFFF
        self.doc, self.weight = row[order], weight[order]
        weight = None
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(new).astype(np.int32)
        size = np.diff(np.append(at, np.int32(len(order))))
        ordered = np.cumsum(new, dtype=np.int32)
        ordered -= 1
        slot = np.empty(len(order), np.int32)
        slot[order] = ordered
        order = ordered = None
        shared = size[slot] > 1  # words of one document alone lead nowhere
        self.row_first = np.searchsorted(row[shared], np.arange(n + 1, dtype=np.int32))
        self.slot, self.at, self.size = slot[shared], at, size
        row = slot = shared = None
        give_back()
        wide = np.flatnonzero((size > 1) & (size.astype(np.int64) * DENSE >= n))
        self.dense, self.whole = np.full(len(at), -1, np.int32), np.zeros((len(wide), n), np.float32)
        self.dense[wide] = np.arange(len(wide))
        places = spread(at[wide], size[wide])
        self.whole[np.repeat(np.arange(len(wide)), size[wide]), self.doc[places]] = self.weight[places]
        places, self.pairs = None, None
        if n * n <= PAIRS:
            self.pairs = (self.whole > 0).astype(np.float32).T @ self.whole
            self.whole = self.whole[:0]  # the pairs have what it says
        self.used = np.zeros(n, bool)
        self.free = 0

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents by score, then the others in order; each is marked as used when it is given."""
        slots = self.slot[self.row_first[seed] : self.row_first[seed + 1]]
        if len(slots):
            dense = self.dense[slots]
            few = slots[dense < 0]
            at = spread(self.at[few], self.size[few])
            score = np.bincount(self.doc[at], self.weight[at], self.n) + (self.whole[dense[dense >= 0]].sum(axis=0) if self.pairs is None else self.pairs[seed])
            score[self.used] = 0
            while score[best := int(score.argmax())] > 0:  # the first of equal ones
                score[best] = 0
                if not self.used[best]:
                    self.used[best] = True
                    yield best
        while self.free < self.n:
            if not self.used[self.free]:
                self.used[self.free] = True
                yield self.free
            self.free += 1


def plan(shard: Shard, tokens: list[int], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover each document once."""
    sequence, offset, start = 0, 0, 0
    doc = 0 if shard.n else -1
    if shard.n:
        shard.used[0] = True
    near: Iterator[int] = iter(())
    while doc >= 0:
        if not offset:
            near = shard.neighbours(doc)
        length = min(window - offset, tokens[doc] - start)
        yield doc, start, length, sequence, offset
        start, offset = start + length, offset + length
        if offset == window:
            sequence, offset = sequence + 1, 0
        if start == tokens[doc]:
            doc, start = next(near, -1), 0


def _pack(tokenizer: str, end_id: int, stats, window: int, most: int, keep_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 7 + [pa.binary()]

    def block(shard_id: int, first: int, batches: list[pa.RecordBatch]) -> tuple[int, pa.RecordBatch]:
        with collector_off():  # what piles up here, ids and tuples, holds no cycles
            return packed(shard_id, first, batches)

    def packed(shard_id: int, first: int, batches: list[pa.RecordBatch]) -> tuple[int, pa.RecordBatch]:
        coder = encoder(tokenizer)
        ids_of, parts, counts, hashes, words = [], [], [], [], []
        batches.reverse()
        while batches:  # each goes when it is read
            for part in chunks([batches.pop()]):
                ids_of += part.column("doc_id").to_pylist()
                flat, count = coder.encode(part.column("text"))
                parts.append(flat.astype(np.uint16 if flat.max(initial=0) < 1 << 16 else np.uint32))
                counts.append(count)
                hash_, length = hashed(*raw(part.column("text")))
                hashes.append(hash_)
                words.append(length)
        flat, counts, words = np.concatenate(parts), np.concatenate(counts), np.concatenate(words)
        part = parts = hash_ = None
        give_back()
        first_id = np.cumsum(counts) - counts
        tail = np.array([end_id], "<u4").tobytes()
        idf, mean = stats.value
        index = Shard.of(hashes, words, idf, mean)
        give_back()
        tokens = (counts + 1).tolist()
        rows, last = [], first - 1
        for doc, start, length, sequence, offset in plan(index, tokens, window):
            end = start + length
            a = int(first_id[doc]) + start
            piece = flat[a : int(first_id[doc]) + min(end, tokens[doc] - 1)].astype("<u4").tobytes() + (tail if end == tokens[doc] else b"")
            last = first + sequence
            rows.append((ids_of[doc], start, length, zlib.crc32(piece), tokens[doc], shard_id << 32 | last, offset, piece if keep_ids else None))
        return last + 1, pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, current, first = 0, None, 0
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            ends = np.append(np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(shards))
            at = 0
            for end in ends.tolist():
                if end == at:
                    continue
                if current is not None and shards[at] != current:
                    first, out = block(current, first, held)
                    yield out
                    held, size, first = [], 0, 0
                current = int(shards[at])
                for part in chunks([batch.slice(at, end - at)], most=most):
                    bytes_ = len(raw(part.column("text"))[0])
                    if held and size + bytes_ > 4 * most:
                        first, out = block(current, first, held)
                        yield out
                        held, size = [], 0
                    held.append(part)
                    size += bytes_
                at = end
        if held:
            yield block(current, first, held)[1]

    return run


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids as little-endian uint32]."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = statistics(docs)
    dealer = Dealer.of(found, shard_bytes)
    stats = spark.sparkContext.broadcast((found.idf, found.mean))
    dealt = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tie")).mapInArrow(tidy(_deal(spark.sparkContext.broadcast(dealer))), "doc_id bigint, text string, tie bigint, shard bigint")
    parts = min(dealer.count, 100_000)
    dealt = dealt.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard", "doc_id", "tie")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    out = dealt.mapInArrow(tidy(_pack(tokenizer, end_id, stats, window, shard_bytes, keep_ids), keep=True), schema)
    return out if keep_ids else out.drop("ids")
