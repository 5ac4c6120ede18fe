"""Exact and fast token ids: a unit cache in front of the ``tokenizers`` library.

Texts are cut into units at places where their tokenizer always cuts, each
distinct unit is encoded by the library, and the ids are put together with
numpy. Two pre-tokenizers allow this:

* byte-level BPE with the usual pattern and no normalizer, where a token never
  goes from a non-space to a space, nor from a letter to other visible ASCII;
* NFC, white space and lower case normalizers with a pattern that drops white
  space and has the same two properties.

Any other tokenizer encodes whole texts, uncached. Cuts are only made after
bytes that surely are no white space; where in doubt a unit is longer.
"""

from __future__ import annotations

import contextlib
import gc
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from sketchloom.llm.textkit import CACHES, raw, span_hashes, spread


def _kind(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(re.search(r"\s", x["content"]) or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens") or ()):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    if pre.get("type") == "Sequence" and [x.get("type") for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        first = pre["pretokenizers"][0]
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"]["Regex"].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
            return "between"
    return "whole"


def _flags(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in members]] = True
    return out


_SPACE = _flags("\t\n\v\f\r ")
_LETTER = _flags("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SOLID = ~_SPACE
_SOLID[0x1C:0x20] = False
_SOLID[0x80:] = False
_HIGH = np.arange(256) >= 0x80
#: What white space beyond ASCII starts with (two bytes; three bytes).
_LEAD2, _LEAD3 = np.zeros(256, bool), np.zeros(256, bool)
_LEAD2[0xC2] = True
_LEAD3[0xE1:0xE4] = True
#: What Latin letters beyond ASCII start with, and end with.
_LEAD_LATIN, _LATIN_END = np.zeros(256, bool), _HIGH.copy()
_LEAD_LATIN[0xC3] = True
_LATIN_END[[0x97, 0xB7]] = False
#: These, a bit each, so that a text is looked up once.
SPACE, SOLID, LETTER, HIGH, LEAD2, LEAD3, LEAD_LATIN, LATIN_END = (1 << i for i in range(8))
_CLASSES = sum(x.astype(np.uint8) << i for i, x in enumerate((_SPACE, _SOLID, _LETTER, _HIGH, _LEAD2, _LEAD3, _LEAD_LATIN, _LATIN_END))).astype(np.uint8).tobytes()

#: ASCII punctuation and digits: a token of letters ends before these.
_STOPS = _flags("!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~")
#: White space as spaces; and A-Z lowered, too.
_PLAIN_SPACE = bytes(np.where(_SPACE, 32, np.arange(256)).astype(np.uint8))
_LOWERED = _PLAIN_SPACE.lower()


def unit_offsets(data: np.ndarray, offsets: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts, with the total as the last."""
    if len(data) < 3:
        return np.unique(np.concatenate([offsets, [0, len(data)]]))
    whole = data.tobytes()
    kind = np.frombuffer(whole.translate(_CLASSES), np.uint8)
    now, last = kind[1:], kind[:-1]
    before2, before3 = np.zeros(len(last), np.uint8), np.zeros(len(last), np.uint8)
    before2[1:], before3[2:] = kind[:-2], kind[:-3]
    high = (last & HIGH) != 0
    solid = ((last & SOLID) != 0) | (high & (before2 & LEAD2 == 0) & (before3 & LEAD3 == 0))
    letter = ((last & LETTER) != 0) | ((last & LATIN_END != 0) & (before2 & LEAD_LATIN != 0))
    stop = np.frombuffer(whole.translate(stops.astype(np.uint8).tobytes()), bool)[1:]
    cut = ((now & SPACE) != 0) & solid | stop & letter
    # a line feed between two visible letters or stops is a token of its own, or none
    cut[1:] |= (data[1:-1] == 10) & solid[:-1] & ((now[1:] & LETTER) != 0)
    mark = np.zeros(len(data) + 1, bool)
    mark[1:-1] = cut
    mark[offsets] = mark[0] = mark[-1] = True
    return np.flatnonzero(mark)


#: Letters that every pre-tokenizer here keeps together, and single in NFC.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f"[{_LATIN}]+")
_SPACED = re.compile(f" ?[{_LATIN}]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes the bytes of a space and of Latin letters: printable bytes as themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {code: "".join(shown[b] for b in chr(code).encode()) for code in [32, *range(192, 256)]}


@contextlib.contextmanager
def collector_off() -> Iterator[None]:
    """Without the garbage collector, which is then as it was before."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Units:
    """Units that have been encoded: an open hash table over their bytes, which are compared in full."""

    def __init__(self, most: int):
        self.most = most  # the table is twice as large, so that every search ends
        self.table = np.full(1 << max(4, (2 * most - 1).bit_length()), -1, np.int32)
        self.count = 0
        self.hash = np.zeros(1 << 12, np.uint64)
        self.start, self.length = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.bytes, self.used = np.zeros(1 << 16, np.uint8), 0

    def find(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each of some units (bytes of ``data``), or -1."""
        out = np.full(len(h), -1, np.int64)
        at, left = (h & np.uint64(len(self.table) - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            slot = self.table[at[left]]
            left, slot = left[slot >= 0], slot[slot >= 0]
            same = self.hash[slot] == h[left]
            out[left[same]] = slot[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (len(self.table) - 1)
        found = np.flatnonzero(out >= 0)  # by hash: the bytes decide
        equal = self.length[out[found]] == length[found]
        out[found[~equal]] = -1
        found = found[equal]
        size = length[found]
        apart = data[spread(start[found], size)] != self.bytes[spread(self.start[out[found]], size)]
        if apart.any():
            out[np.repeat(found, size)[apart]] = -1
        return out

    def add(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Number some distinct units from ``count`` on. One whose hash another unit has is only numbered, not found again."""
        n, size = len(h), int(length.sum())
        self.hash, self.start, self.length = (_room(x, self.count + n) for x in (self.hash, self.start, self.length))
        self.bytes = _room(self.bytes, self.used + size)
        number = np.arange(self.count, self.count + n)
        self.hash[number], self.length[number] = h, length
        self.start[number] = self.used + np.cumsum(length) - length
        self.bytes[self.used : self.used + size] = data[spread(start, length)]
        self.used, self.count = self.used + size, self.count + n
        at, left = (h & np.uint64(len(self.table) - 1)).astype(np.int64), np.arange(n)
        while len(left):
            free = self.table[at[left]] < 0
            self.table[at[left[free]]] = number[left[free]]  # of several the last one stays
            placed = self.table[at[left]]
            left = left[(placed != number[left]) & (self.hash[placed] != h[left])]
            at[left] = (at[left] + 1) & (len(self.table) - 1)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with space for n values."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x) + len(x) // 2) - len(x), x.dtype)])


class Encoder:
    """Ids of texts by a tokenizer file; ``most`` bounds the units that are kept."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        # special tokens are found before anything is cut: none may be cut in two
        self.stops = _STOPS.copy()
        for added in spec.get("added_tokens") or ():
            self.stops[[ord(b) for a, b in zip(added["content"], added["content"][1:]) if a.isalpha() and ord(b) < 256]] = False
        self.most = most
        self.table = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.units = Units(self.most)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int32)
        self.length = np.zeros(1 << 16, np.int32)

    def largest_id(self) -> int:
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)

    def _codes(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit; plain words skip the library's normalizers and go to its model at once."""
        tokenize, table, out, rest = self.tokenizer.model.tokenize, self.table, [], []
        if self.kind == "between":
            for i, unit in enumerate(units):
                word = unit.lstrip(" ")
                if _WORD.fullmatch(word):
                    word = word.lower()
                    out.append([t.id for t in tokenize(word if word.isascii() else word.translate(table))])
                else:
                    out.append(unit)
                    rest.append(i)
        else:
            space = table[32]  # of ASCII words, the only character that is written otherwise
            for i, unit in enumerate(units):
                if _SPACED.fullmatch(unit):
                    out.append([t.id for t in tokenize(unit.replace(" ", space) if unit.isascii() else unit.translate(table))])
                else:
                    out.append(unit)
                    rest.append(i)
        for i, code in zip(rest, self.tokenizer.encode_batch([out[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = code.ids
        return out

    def _add(self, units: list[str], k: int) -> None:
        """Ids of the units with the numbers from k on."""
        for at in range(0, len(units), 20_000):
            part = units[at : at + 20_000]
            ids = self._codes(part)
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))
            end = k + at + len(part)
            self.start, self.length, self.ids = _room(self.start, end), _room(self.length, end), _room(self.ids, self.used + len(flat))
            self.ids[self.used : self.used + len(flat)] = flat
            self.start[k + at : end] = self.used + np.cumsum(length) - length
            self.length[k + at : end] = length
            self.used += len(flat)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one uint32 array, and the number of ids of each text (null: empty)."""
        if self.kind == "whole":
            codes = [x.ids for x in self.tokenizer.encode_batch([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)], add_special_tokens=False)]
            return np.array([i for ids in codes for i in ids], np.uint32), np.array([len(ids) for ids in codes], np.int64)
        data, offsets = raw(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        bounds = unit_offsets(data, offsets, self.stops)
        if self.kind == "between":
            whole = data.tobytes()
            # special tokens are found before letters are lowered
            data = np.frombuffer(whole.translate(_PLAIN_SPACE if b"<" in whole else _LOWERED), np.uint8)
        units = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        plain, ends = raw(units.dictionary)
        start, size = ends[:-1], np.diff(ends)
        h = span_hashes(plain, start, ends[1:])
        at = self.units.find(h, plain, start, size)
        new = np.flatnonzero(at < 0)
        if self.units.count + len(new) > self.units.most or self.units.used + int(size[new].sum()) >> 31:
            self._clear()
            at, new = np.full(len(h), -1), np.arange(len(h))
            self.units = Units(max(self.most, len(new)))
        if len(new):
            at[new] = np.arange(self.units.count, self.units.count + len(new))
            with collector_off():  # the many short lists hold no cycles
                self._add(units.dictionary.take(pa.array(new)).to_pylist(), self.units.count)
            self.units.add(h[new], plain, start[new], size[new])
        at = at[units.indices.to_numpy()]
        length = self.length[at].astype(np.int64)
        first = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.repeat(self.start[at] - first[:-1], length) + np.arange(first[-1])]
        return flat, np.diff(first[np.searchsorted(bounds, offsets)])


_ENCODERS: dict[str, Encoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
