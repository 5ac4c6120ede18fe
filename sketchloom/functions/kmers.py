"""K-mers: extraction, canonical form, and sketches by MurmurHash3 or by md5, which SQL has, too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.hashing import murmur64
from sketchloom.schemas import KSIZE, MAX_HASH, SEED

_STEP = 1 << 18
_PAIR = np.zeros(256, np.uint8)
for _a, _b in ("AT", "TA", "CG", "GC"):
    _PAIR[ord(_a)] = ord(_b)


def canonical(sequence: bytes, k: int = KSIZE) -> Iterator[np.ndarray]:
    """Canonical k-mers as byte matrices, some at a time; k-mers with letters other than ACGT are left out."""
    x = np.frombuffer(sequence.upper(), np.uint8)
    for at in range(0, len(x) - k + 1, _STEP):
        part = x[at : at + _STEP + k - 1]
        other = _PAIR[part]
        rows = np.lib.stride_tricks.sliding_window_view(part, k)
        back = np.lib.stride_tricks.sliding_window_view(other[::-1], k)[::-1]
        good = np.convolve(other == 0, np.ones(k, np.int64), "valid") == 0
        rows, back = np.ascontiguousarray(rows[good]), np.ascontiguousarray(back[good])
        if len(rows):
            smaller = back.view(f"S{k}").ravel() < rows.view(f"S{k}").ravel()
            yield np.where(smaller[:, None], back, rows)


def sketch_bytes(sequence: str | None, k: int = KSIZE, most: int = MAX_HASH, seed: int = SEED) -> np.ndarray:
    """Hashes under ``most`` of all canonical k-mers, in order, repeats kept."""
    parts = [murmur64(rows, seed) for rows in canonical((sequence or "").encode("ascii", "replace"), k)]
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return h[h < np.uint64(most)] if most < 1 << 64 else h


def murmur_sketch(k: int = KSIZE, most: int = MAX_HASH, seed: int = SEED):
    """An Arrow UDF: sequence -> array of the hashes that the gate keeps, so that only those leave Python."""

    @F.pandas_udf("array<bigint>")
    def sketch(sequences):
        return sequences.map(lambda s: sketch_bytes(s, k, most, seed).view(np.int64))

    return sketch


def canonical_column(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


# Constants of the public MD5.
_SINES = [int(abs(np.sin(np.float64(i + 1))) * (1 << 32)) for i in range(64)]
_TURNS = [t[i % 4] for t in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_M32 = (1 << 32) - 1
#: K-mers that are hashed at a time, so that what is worked on stays in a core's cache; bytes of text that are.
_MD5_STEP, _MD5_BYTES = 1 << 14, 1 << 20


def _md5_blocks(n: int, words: list[np.ndarray | int]) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the MD5 of n padded messages, whose words (16 a block) are arrays or the same for all."""
    state = [np.full(n, v, np.uint32) for v in _START]
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            word, more = words[at + _PLACES[i]], _SINES[i]
            np.add(a, f, out=a)
            if isinstance(word, int):
                more = (more + word) & _M32
            else:
                np.add(a, word, out=a)
            np.add(a, np.uint32(more), out=a)
            np.left_shift(a, np.uint32(_TURNS[i]), out=t), np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a)
            np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state[0], state[1]


def _md5_kept(fours: np.ndarray, start: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes under ``most`` of substrings of one size; ``fours`` has the four bytes from each place on."""
    together = int(start[-1]) - int(start[0]) == len(start) - 1
    at = lambda i: fours[start[0] + i : start[0] + i + len(start)] if together else fours[start + i]
    full, rest = divmod(size, 4)
    words: list = [at(4 * i) for i in range(full)]
    end = 0x80 << 8 * rest
    words.append((at(4 * full) & np.uint32((1 << 8 * rest) - 1)) | np.uint32(end) if rest else end)
    words += [0] * (-(len(words) + 2) % 16) + [8 * size & _M32, 8 * size >> 32]
    a, b = (x.byteswap() for x in _md5_blocks(len(start), words))
    place = np.flatnonzero(a <= np.uint32(min(most >> 28, _M32)))
    h = (a[place].astype(np.uint64) << np.uint64(32) | b[place]) >> np.uint64(4)
    good = h < np.uint64(most)
    return place[good], h[good].view(np.int64)


def _text_pieces(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Texts as (first row, ends of rows) of some together; one that is long in pieces, which share k - 1 characters."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        at, end = int(offsets[row]), int(offsets[row + 1])
        if end - at <= _MD5_BYTES:
            to = int(np.searchsorted(offsets, at + _MD5_BYTES, "right")) - 1
            yield row, offsets[row : to + 1]
            row = to
            continue
        while at < end:
            to = min(at + _MD5_BYTES, end)
            while to < end and data[to] & 0xC0 == 0x80:
                to += 1
            more = np.flatnonzero(data[to : min(end, to + 4 * k)] & 0xC0 != 0x80)
            yield row, np.array([at, to + int(more[k - 1]) if len(more) >= k else end])
            at = to
        row += 1


def md5_bytes(data: np.ndarray, offsets: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and md5 hash, in order, of each substring of k characters of UTF-8 texts whose hash is under ``most``."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for row, ends in _text_pieces(data, offsets, k):
        low = int(ends[0])
        part = np.concatenate([data[low : int(ends[-1])], np.zeros(4, np.uint8)])
        fours = np.ndarray((len(part) - 3,), "<u4", part, strides=(1,)).copy()
        chars = np.flatnonzero(part[:-4] & 0xC0 != 0x80)
        first = np.searchsorted(chars, ends - low)
        count = np.maximum(np.diff(first) - (k - 1), 0)
        which = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        start = chars[which]
        size = np.append(chars, len(part) - 4)[which + k] - start
        # substrings of one size at a time; where all is ASCII, in order and without gathering
        order = np.argsort(size, kind="stable") if len(size) and size.max() > k else np.arange(len(size))
        edges = [0, *(np.flatnonzero(np.diff(size[order])) + 1).tolist(), len(order)]
        places, hashes = [], []
        for a, z in zip(edges, edges[1:]):
            for i in range(a, z, _MD5_STEP):
                some = order[i : min(z, i + _MD5_STEP)]
                place, h = _md5_kept(fours, start[some], int(size[some[0]]), most)
                places.append(some[place])
                hashes.append(h)
        if places:
            place, h = np.concatenate(places), np.concatenate(hashes)
            by = np.argsort(place)
            found.append((row + np.searchsorted(np.cumsum(count), place[by], "right"), h[by]))
    return tuple(np.concatenate(x) for x in zip(*found))


def md5_hashes(text: Column, k: int = KSIZE, most: int = (1 << 60) // 100) -> Column:
    """The md5 hashes under ``most`` of a text's k-mers, in order; repeats kept. A hash is 60 bits, the first 15 hex digits, as any SQL engine can compute it."""

    @F.arrow_udf("array<bigint>")
    def hashed(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        content = texts.buffers()[2]
        row, h = md5_bytes(np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8), ends, k, most)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32()), pa.array(h, pa.int64()))

    return hashed(text)


def md5_sketch(df: DataFrame, key: str, text: str, k: int = KSIZE, most: int = (1 << 60) // 100) -> DataFrame:
    """(key, hash) of each k-mer whose md5 hash is under ``most``; repeats kept."""
    return df.select(key, F.explode(md5_hashes(F.col(text), k, most)).alias("hash"))
