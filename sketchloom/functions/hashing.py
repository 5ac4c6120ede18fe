"""Bucket and shard columns, the hash-bit sample, and MurmurHash3 of k-mers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolution of hash-bit samples: fractions are multiples of 2^-20.
SAMPLE_BITS = 20


def power_of_two(n: int, most: int = 65536) -> int:
    """``n`` if it is a power of two up to ``most``."""
    if n < 1 or n & (n - 1) or n > most:
        raise ValueError(f"{n} isn't a power of two from 1 to {most}")
    return n


def low_bits(h: Column, count: int) -> Column:
    """Bucket or shard by the low bits; ``count`` is a power of two."""
    return h.bitwiseAND(F.lit(power_of_two(count) - 1)).cast("int")


def high_bits(h: Column, bits: int) -> Column:
    """Shard by the top bits of the unsigned hash, as old indexes have it."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def modulo(h: Column, count: int) -> Column:
    """Bucket from 0 to count - 1, for negative hashes too."""
    return F.pmod(h, F.lit(count)).cast("int")


def remainder(h: Column, count: int) -> Column:
    """Truncating remainder: negative for negative hashes."""
    return (h % F.lit(count)).cast("int")


def sample_threshold(fraction: float) -> int:
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be over 0 and at most 1")
    return max(1, round(fraction * (1 << SAMPLE_BITS)))


def bit_sample(h: Column, fraction: float, bucket_bits: int) -> Column:
    """A sample by hash bits above those of the bucket: equal hashes are in or out on every side."""
    if fraction >= 1:
        return F.lit(True)
    return F.shiftright(h, bucket_bits).bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1)) < F.lit(sample_threshold(fraction))


def gate(h: Column, most: int) -> Column:
    """Whether a signed hash is one that a sketch keeps; unsigned values from 2^63 on are negative here."""
    return (h >= 0) & (h < F.lit(most))


# Constants of the public MurmurHash3 x64-128.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_ADD1, _ADD2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _finish(x: np.ndarray) -> np.ndarray:
    for scale in (_F1, _F2):
        x = (x ^ (x >> np.uint64(33))) * scale
    return x ^ (x >> np.uint64(33))


def _words(rows: np.ndarray) -> np.ndarray:
    """Little-endian words of up to 8 bytes a row."""
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view("<u8").ravel()


def murmur64(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """First word of MurmurHash3 x64-128 of each row of a byte matrix."""
    n, size = rows.shape
    first = np.full(n, seed, np.uint64)
    second = first.copy()
    full = size // 16 * 16
    with np.errstate(over="ignore"):
        for at in range(0, full, 16):
            first ^= _turn(_words(rows[:, at : at + 8]) * _C1, 31) * _C2
            first = (_turn(first, 27) + second) * np.uint64(5) + _ADD1
            second ^= _turn(_words(rows[:, at + 8 : at + 16]) * _C2, 33) * _C1
            second = (_turn(second, 31) + first) * np.uint64(5) + _ADD2
        if size - full > 8:
            second ^= _turn(_words(rows[:, full + 8 :]) * _C2, 33) * _C1
        if size > full:
            first ^= _turn(_words(rows[:, full : min(size, full + 8)]) * _C1, 31) * _C2
        first ^= np.uint64(size)
        second ^= np.uint64(size)
        first = first + second
        second = second + first
        return _finish(first) + _finish(second)
