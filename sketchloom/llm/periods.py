"""Periodic runs of words: stretches that repeat themselves at least four times, found and collapsed.

Method. Karp, Miller and Rosenberg's naming: two stretches of 2^k words of a
text have one name if they are equal, and the names for 2^(k+1) come from the
pairs of names of the two halves. Names start from the words themselves, told
apart by a dictionary, so nothing is decided by a hash. How far two places agree
is read off the names by descending powers of two. A run of smallest period q,
2^k <= q < 2^(k+1), that repeats at least four times has a place i on a grid of
2^(k+1) with the names of 2^k words at i and at i + q equal; so with names
written in rows of 2^(k+1), each row's first one is compared with its second
half. What agrees is extended to both sides by the names.

Names that occur once are never equal to others, so naming stops where no
stretch repeats. Grid places that lie deep in a run of smaller period that is
known aren't extended again: by Fine and Wilf no other period can be smallest
there. Texts are named together, in batches; names are a text's own, so nothing
crosses from one to the next.

Scale. One pass, no exchange. A text is one row and read whole; each level of
names takes four bytes a word, and there are as many as the longest stretch that
repeats has powers of two.

Defined cases. A null or empty text, or one of separators alone, has no word, no
run and an empty collapsed text. Equal runs found from several places count
once. Of runs of equal length the first one, then the one of smaller period, is
the longest. Repeated rows have a result each; null ids stay null; further
columns are never looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.textkit import chunks, pick, raw, spread, tidy

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Candidates that are extended at a time.
_SLICE = 1 << 20


def names(words: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words from each place on, until none repeats; those that occur once in their text are negative and all different."""
    n = len(words)
    if not n:
        return []
    alone = -np.arange(1, n + 1, dtype=np.int32)
    levels = []
    at, key, size = np.arange(n), row.astype(np.int64) * (int(words.max()) + 1) + words, 1
    while len(at):
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        number = np.cumsum(new) - 1
        many = (np.bincount(number) > 1)[number]
        level = alone.copy()
        level[at[order[many]]] = number[many]
        if not many.any():
            break
        levels.append(level)
        # only places whose two halves both repeat can repeat as a whole
        at = np.sort(at[order[many]])
        at = at[at + size < n]
        second = level[at + size]
        at, second = at[second >= 0], second[second >= 0]
        key = level[at].astype(np.int64) * n + second
        size *= 2
    return levels


def agree(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x and from y on are equal; x < y."""
    n = len(levels[0])
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        far = y + out
        fits = far < n
        same = np.zeros(len(x), bool)
        same[fits] = levels[k][(x + out)[fits]] == levels[k][far[fits]]
        out += same.astype(np.int64) << k
    return out


def agree_back(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words before x and before y are equal; x < y."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        near = x - out - (1 << k)
        fits = near >= 0
        same = np.zeros(len(x), bool)
        same[fits] = levels[k][near[fits]] == levels[k][(y - out - (1 << k))[fits]]
        out += same.astype(np.int64) << k
    return out


def runs(words: np.ndarray, row: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of at least ``times`` (four or more) periods and ``least`` words, by start and period; rows are texts, in order."""
    levels = names(words, row)
    n = len(words)
    found = []
    deep = np.zeros(n + 1, np.int64)  # a place plus a period up to here is inside of a known run of smaller period
    for k, level in enumerate(levels):
        half, wide = 1 << k, 2 << k
        rows = -(-n // wide)
        padded = np.full(rows * wide, np.iinfo(np.int32).min, np.int32)
        padded[:n] = level
        grid = padded.reshape(rows, wide)
        heads = np.flatnonzero(grid[:, 0] >= 0)
        mine = []
        step = max(1, _SLICE // half)
        for a in range(0, len(heads), step):
            some = heads[a : a + step]
            r, c = np.nonzero(grid[some, half:] == grid[some, :1])
            i, q = some[r] * wide, c + half
            fresh = i + q > deep[i]
            i, q = i[fresh], q[fresh]
            if not len(i):
                continue
            start, end = i - agree_back(levels, i, i + q), i + q + agree(levels, i, i + q)
            long = end - start >= times * q
            mine.append(np.stack([start[long], end[long], q[long]], axis=1))
        if not mine or not sum(map(len, mine)):
            continue
        mine = np.unique(np.concatenate(mine), axis=0)
        found.append(mine)
        lengths = mine[:, 1] - mine[:, 0]
        np.maximum.at(deep, spread(mine[:, 0], lengths), np.repeat(mine[:, 1] - mine[:, 2], lengths))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    every = np.concatenate(found)
    every = every[every[:, 1] - every[:, 0] >= least]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = raw(batch.column("text"))
            data = data.tobytes()
            texts = [data[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            sizes = np.array([len(t) for t in texts], np.int64)
            flat = [w for t in texts for w in t]
            words = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(texts)), sizes)
            start, end, period = runs(words, row)
            first = np.cumsum(sizes) - sizes
            # of a run all but its first period goes
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change)[:-1] > 0
            lost = np.bincount(row[gone], minlength=len(texts))
            owner = row[start]
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
            at, length, periods = (start - first[owner]).tolist(), (end - start).tolist(), period.tolist()
            runs_sha, text_sha, kept_texts = [], [], []
            for i, t in enumerate(texts):
                lo, hi = bounds[i], bounds[i + 1]
                runs_sha.append(hashlib.sha256("".join(f"{at[j]},{length[j]},{periods[j]}\n" for j in range(lo, hi)).encode()).hexdigest())
                if lost[i]:
                    t = [w for w, g in zip(t, gone[first[i] : first[i] + sizes[i]].tolist()) if not g]
                text = b" ".join(t)
                text_sha.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept_texts.append(text.decode("utf-8", "surrogatepass"))
            spans = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(periods, pa.int64())], ["start", "length", "period"])
            arrays = [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans), pa.array(lost.astype(np.int64)), pa.array(runs_sha), pa.array(text_sha)]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(kept_texts, pa.string())] if keep_text else [])], [*_COLUMNS, *(["collapsed"] if keep_text else [])])

    return run


_COLUMNS = ["doc_id", "n_words", "runs", "n_dropped", "runs_sha256", "collapsed_sha256"]


def collapse_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period by start and period), n_dropped, runs_sha256, collapsed_sha256 and, if asked, the collapsed text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, n_dropped bigint, runs_sha256 string, collapsed_sha256 string" + (", collapsed string" if keep_text else "")
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(tidy(_collapsed(keep_text)), schema)


def longest() -> F.Column:
    """The longest of ``runs``; null if there is none."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size("runs") > 0, best)
