"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character
n-grams (3 and 5 bytes, case and punctuation kept), a softmax layer gives the
class, and both are trained by numpy stochastic gradient descent. For scoring,
the two layers are multiplied out once, so a feature costs one look-up.

Scale: the training sample is the only bounded thing: at most ``TRAINING_ROWS``
labelled rows, those with the smallest hash of their id; it is broadcast as ids
and trained on in one task, which returns a model of fixed size. Every text is
scored whole, in one pass without a shuffle.

Defined cases: null and empty texts get the model's bias; texts of any length
are read whole, in pieces; without any label, or any text that has one, all
scores are 0.5; with labels of one class only the score is that class's share,
smoothed; rows of ``labels`` with a null id or label teach nothing; of several
labels of an id each counts; ties in the sample's order go by label and number
of features; repeated rows get equal scores each; further columns are left out;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.textkit import CHUNK_BYTES, chunks, cuts, pick, raw, word_table, words_of

BITS = 18
DIMENSION = 16
TRAINING_ROWS = 6000
EPOCHS = 6
RATE = 0.5
SEED = 7
#: Bytes of the longest n-gram.
LONGEST = 5

_TABLE = word_table()


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bins, rows), both in the order of the rows, of each kind of feature."""
    if len(offsets) == 2 and len(data) > CHUNK_BYTES:  # a long text, a piece at a time; n-grams reach into the next one
        for a, b in cuts(data, _TABLE):
            yield from _some(data[a:b], np.array([0, b - a]), data[b : b + LONGEST - 1])
    else:
        yield from _some(data, offsets)


def _some(data: np.ndarray, offsets: np.ndarray, after: np.ndarray = np.zeros(0, np.uint8)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    words = words_of(data, offsets, _TABLE)
    yield _bits(words.hash * np.uint64(0x9E3779B97F4A7C15)), words.row
    begin, x = len(data), np.concatenate([data, after]).astype(np.uint64)
    if len(after):
        offsets = np.array([0, len(x)])
    for n, scale in ((3, 0xD6E8FEB86659FD93), (LONGEST, 0xA0761D6478BD642F)):
        count = min(len(x) - n + 1, begin)
        if count <= 0:
            continue
        code = np.zeros(count, np.uint64)
        for j in range(n):
            code = code << np.uint64(8) | x[j : j + count]
        row = np.searchsorted(offsets, np.arange(count), "right") - 1 if len(offsets) > 2 else np.zeros(count, np.int64)
        keep = np.arange(count) + n <= offsets[1:][row]
        code = (code + np.uint64(n)) * np.uint64(scale)
        code ^= code >> np.uint64(32)
        yield _bits(code * np.uint64(scale))[keep], row[keep]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights of the bins (for the average) and the bias, from (bins, their shares, label) of each document."""
    labels = np.array([y for *_, y in rows])
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(rows) + 1)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << BITS, DIMENSION)).astype(np.float32)
    out = np.zeros((2, DIMENSION), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bins, share, y = rows[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            hidden = share @ vectors[bins]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= step * np.outer(p, hidden)
            bias -= step * np.float32(0.1) * p
            # the average's gradient is shared out; scaled up as averages of many features move slowly
            vectors[bins] -= (step * 50 * share)[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            data, offsets = raw(one.column("text"))
            counts = np.zeros(1 << BITS, np.int64)
            for bins, _ in features(data, offsets):
                counts += np.bincount(bins, minlength=1 << BITS)
            at = np.flatnonzero(counts)
            share = (counts[at] / max(1, counts.sum())).astype(np.float32)
            rows.append((one.column("rank")[0].as_py(), at.astype(np.int32), share, one.column("label")[0].as_py()))
    rows.sort(key=lambda r: (r[0], r[3], len(r[1])))
    weights, bias = fit([r[1:] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", most: int = TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most ``most`` labelled rows of ``docs``."""
    order = F.xxhash64("doc_id", "label")
    marked = pick(labels, doc_id=label_id, label=label).filter("doc_id IS NOT NULL AND label IN (0, 1)").withColumn("rank", order).orderBy("rank").limit(most)
    rows = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(marked), "doc_id").select("rank", F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    # repeated ids of documents could make the join larger than the sample: the limit holds for both
    row = rows.orderBy("rank").limit(most).coalesce(1).mapInArrow(_train, "weights binary, bias double").first()
    if row is None:
        return fit([])
    return np.frombuffer(row["weights"], np.float32), row["bias"]


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in chunks(batches):
            data, offsets = raw(batch.column("text"))
            total = np.zeros(batch.num_rows)
            count = np.zeros(batch.num_rows, np.int64)
            for bins, row in features(data, offsets):
                total += np.bincount(row, weights[bins], batch.num_rows)
                count += np.bincount(row, minlength=batch.num_rows)
            z = np.clip(total / np.maximum(count, 1) + bias, -50, 50)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score (probability of label 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(_score(shared), "doc_id bigint, score double")
