"""Language ID by mixture inference over n-gram likelihoods.

Training counts hashed byte 4-grams of words (padded at the word's start) for
each language, over every training row. A document is a mixture: each of its
words comes from one of the languages, with the product of its n-grams'
probabilities as likelihood, and expectation-maximisation estimates the
proportions. Language sets are nested by those proportions; the set is the one
with the largest log-likelihood less ``PENALTY`` times log(words) for each
language beyond the first. The prediction is the language with the largest
proportion in the set, the score that proportion.

Scale: two passes over the texts. Counts are summed per partition before the
exchange; the model that reaches the driver has at most ``BINS`` numbers a
language, however many documents there are. More than ``MOST_LANGS`` languages
(a column that isn't clean) are an error rather than a model without bounds.

Defined cases: texts that are null or without any letter are ``und`` with score
0, as are all texts when there is nothing to learn from; texts of any length are
read whole, in pieces, of which only a number a word and language is kept; rows
with a null language or text teach nothing; ties go to the language that sorts
first; repeated rows count each; identify() returns its own columns alone and
keep_known() all of the documents', whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.textkit import CHUNK_BYTES, Carried, chunks, cuts, pick, raw, tidy

BINS = 1 << 16
#: Added to each count.
SMOOTHING = 0.1
ROUNDS = 8
PENALTY = 2.0
#: Languages that a model has at most; it takes a quarter of a MB for each.
MOST_LANGS = 1000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True

#: Letters (A-Z lowered) and all bytes of 128 and over; everything else separates.
_TABLE = np.zeros(256, np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the 4-grams (one for each byte of a word), where words begin among them, and each word's row."""
    x = _TABLE[data].astype(np.uint32)
    n = len(x)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    code, open_ = x.copy(), ~cut[:n]
    for back in (1, 2, 3):
        last = np.zeros(n, np.uint32)
        last[back:] = x[:-back]
        last[~open_] = 0
        code |= last << np.uint32(8 * back)
        open_ &= last != 0  # nothing from before a separator or another text
        if back < 3:
            open_[back:] &= ~cut[: n - back]
            open_[:back] = False
    inside = x != 0
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    code = code[inside]
    bins = (code * np.uint32(2654435761)) >> np.uint32(16)
    at = np.cumsum(inside)[start] - 1
    return bins, at, np.searchsorted(offsets, start, "right") - 1


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """grams() of some texts; of a long one, a piece at a time."""
    if len(offsets) > 2:
        yield grams(data, offsets)
    else:
        for a, b in cuts(data, _TABLE):
            yield grams(data[a:b], np.array([0, b - a]))


@dataclass
class Model:
    """Languages in order, and their log-probabilities (bins x languages)."""

    langs: list[str]
    logp: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def out():
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bin", "n"])
        held.clear()

    for batch in chunks(batches):
        langs = batch.column("lang").to_pylist()
        for bins, at, row in _parts(*raw(batch.column("text"))):
            first = np.searchsorted(row, np.arange(len(langs) + 1))
            ends = np.append(at, len(bins))[first]
            for i, lang in enumerate(langs):
                if ends[i + 1] > ends[i]:
                    if lang not in held:
                        held[lang] = np.zeros(BINS, np.int64)
                    if ends[i + 1] - ends[i] > BINS // 8:
                        held[lang] += np.bincount(bins[ends[i] : ends[i + 1]], minlength=BINS)
                    else:
                        np.add.at(held[lang], bins[ends[i] : ends[i + 1]], 1)
        if len(held) > 256:
            yield from out()
    yield from out()


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row that has a language and a text."""
    rows = pick(docs, lang=lang, text=text).filter("lang IS NOT NULL AND text IS NOT NULL")
    found = rows.select("lang").distinct().limit(MOST_LANGS + 1).count()
    if found > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    counts = rows.mapInArrow(tidy(_count), "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_numpy(zero_copy_only=False)
    langs = sorted(set(names.tolist()))
    total = np.full((BINS, len(langs)), SMOOTHING)
    if langs:
        total[counts.column("bin").to_numpy(), np.searchsorted(np.array(langs, object), names)] += counts.column("n").to_numpy()
    return Model(langs, np.log(total / total.sum(axis=0)).astype(np.float32) if langs else np.zeros((BINS, 0), np.float32))


def _em(p: np.ndarray, share: np.ndarray, row: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions (texts x languages) after some rounds; words are in the order of their texts."""
    words = np.diff(np.append(first, len(row)))[:, None]
    for _ in range(rounds):
        part = p * share[row]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / words
    return share


def infer(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: proportions of the languages (0 outside the selected set), and whether it has any word."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(model.langs)))
    sums, places = [], []
    for bins, at, row in _parts(data, offsets):
        if len(at) and model.langs:
            sums.append(np.add.reduceat(model.logp[bins], at, axis=0))
        places.append(row)
    row = np.concatenate(places)
    if not len(row) or not model.langs:
        return out, np.bincount(row, minlength=rows) > 0
    logp = np.concatenate(sums)
    best = logp.max(axis=1, keepdims=True)
    p = np.maximum(np.exp(logp - best), 1e-30)
    texts, first = np.unique(row, return_index=True)
    row = np.searchsorted(texts, row)
    words = np.diff(np.append(first, len(row)))
    level = np.add.reduceat(best[:, 0].astype(np.float64), first)
    share = _em(p, np.full((len(texts), len(model.langs)), 1 / len(model.langs), np.float32), row, first, ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    alone = np.add.reduceat(logp, first, axis=0, dtype=np.float64)
    top = alone.argmax(axis=1)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(texts)), top] = 1
    value = alone[np.arange(len(texts)), top]
    cost = PENALTY * np.log(words + 1)
    # level bounds the likelihood of any mixture: where it can't pay for one more language nothing is tried
    going = np.flatnonzero(level - cost > value)
    for size in range(2, len(model.langs) + 1):
        if not len(going):
            break
        keep = np.isin(row, going)
        part_row = np.searchsorted(going, row[keep])
        part_first = np.flatnonzero(np.concatenate([[True], part_row[1:] != part_row[:-1]]))
        start = np.where(rank[going] < size, np.maximum(share[going], 1e-6), 0).astype(np.float32)
        start /= start.sum(axis=1, keepdims=True)
        part_p = p[keep]
        got = _em(part_p, start, part_row, part_first, ROUNDS // 2)
        mixed = np.log(np.maximum((part_p * got[part_row]).sum(axis=1), 1e-37).astype(np.float64))
        new = level[going] + np.add.reduceat(mixed, part_first) - (size - 1) * cost[going]
        better = new > value[going]
        value[going[better]] = new[better]
        chosen[going[better]] = got[better]
        going = going[level[going] - size * cost[going] > value[going]]
    out[texts] = chosen
    return out, np.bincount(texts, minlength=rows) > 0


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        most = max(1 << 16, CHUNK_BYTES // max(1, len(m.langs) // 4))
        for batch in chunks(batches, most=most):
            data, offsets = raw(batch.column("text"))
            share, _ = infer(m, data, offsets)
            letters = np.add.reduceat(np.append(_ASCII[data], False), offsets[:-1]) > 0 if len(data) else np.zeros(batch.num_rows, bool)
            letters &= offsets[1:] > offsets[:-1]
            for i in np.flatnonzero(~letters & (offsets[1:] > offsets[:-1])):
                letters[i] = bool(_LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
            known = letters & (share.sum(axis=1) > 0)
            top = share.argmax(axis=1) if m.langs else np.zeros(batch.num_rows, int)
            lang = [m.langs[t] if k else UNKNOWN for t, k in zip(top.tolist(), known.tolist())]
            score = np.where(known, np.clip(share.max(axis=1, initial=0), 0, 1), 0.0)
            parts = [[{"lang": m.langs[j], "share": float(share[i, j])} for j in np.flatnonzero(share[i])] if known[i] else [] for i in range(batch.num_rows)]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(parts, kind)], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "mixture"])

    return run


_SCHEMA = "lang_pred string, score double, mixture array<struct<lang:string,share:double>>"


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, mixture (the selected languages and their proportions)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(tidy(_predict(shared)), "doc_id bigint, " + _SCHEMA)


def keep_known(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = Carried(docs)
    rows = docs.select(F.lit(0).cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), *carried.columns)
    return carried.back(rows.mapInArrow(tidy(_predict(shared)), "doc_id bigint" + carried.ddl + ", " + _SCHEMA).filter(F.col("lang_pred") != UNKNOWN))
