"""Token-id output: containers of documents compressed one by one with a shared dictionary.

A zstandard dictionary is trained on serialized id arrays of a bounded sample
of documents. Ids are written as little-endian unsigned integers (16 bits where
the vocabulary allows, else 32), every document is a frame of its own, and a
container holds the frames of consecutive documents with an offset index, so a
short document is read without its neighbours.

Container, all numbers little-endian::

    "LOOMIDS1"  8 bytes
    sha256 of the dictionary, 32 bytes; width of an id, u8; documents, u64
    frames
    index: has an id, u8 each; document ids, i64 each; ids in it, u64 each; frame ends, u64 each
    offset of the index, u64; "LOOMEND1"

Containers travel as rows of a Parquet dataset (``part``, ``seq``, ``first_id``,
``documents``, ``tokens``, ``start``, ``container``), since Spark commits those
files whole whatever store they are in and whichever executor is lost; the
dictionary is a dataset beside it.

Scale: documents are range-partitioned by id (ties by a hash of the text, so
that a repeated id can be split) and encoded after the exchange; the global
position of a document is its place in the container, plus ``start`` within the
partition, plus the ids of all earlier partitions. Only those totals, one number
a partition, and the dictionary reach the driver.

Defined cases: null text is empty; texts of any length are one frame; null ids
come first; repeated rows, and rows of one id, are written each; an id that the
width can't hold is an error, not another id; further columns are left out; an
empty table gives an empty dataset.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm.textkit import chunks, pick, tidy
from sketchloom.llm.tokens import encoder
from sketchloom.sources.files import shared_dir

MAGIC, END = b"LOOMIDS1", b"LOOMEND1"
#: The dictionary is trained on this many documents at most, the first by a hash of id and text, of each on this many characters at most.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 1000, 20_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
CONTAINER_IDS = 2 << 20


def pack(frames: list[bytes], ids: list[int | None], counts: list[int], width: int, digest: bytes) -> bytes:
    """A container."""
    head = MAGIC + digest + struct.pack("<BQ", width, len(frames))
    has = np.array([i is not None for i in ids], np.uint8)
    keys = np.array([i or 0 for i in ids], "<i8")
    ends = np.cumsum([len(f) for f in frames]).astype("<u8")
    body = b"".join(frames)
    return b"".join([head, body, has.tobytes(), keys.tobytes(), np.array(counts, "<u8").tobytes(), ends.tobytes(), struct.pack("<Q", len(head) + len(body)), END])


class Container:
    """Read access to a container; ``read(i)`` decompresses only that document."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        if data[:8] != MAGIC or data[-8:] != END:
            raise ValueError("not a container")
        if data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("written with another dictionary")
        self.width, self.documents = struct.unpack("<BQ", data[40:49])
        (at,) = struct.unpack("<Q", data[-16:-8])
        n = self.documents
        self.data = data
        has = np.frombuffer(data, np.uint8, n, at)
        keys = np.frombuffer(data, "<i8", n, at + n)
        self.ids = [int(k) if h else None for h, k in zip(has, keys)]
        self.counts = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        self.ends = np.concatenate([[0], np.frombuffer(data, "<u8", n, at + 17 * n).astype(np.int64)]) + 49
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def read(self, i: int) -> np.ndarray:
        frame = self.data[self.ends[i] : self.ends[i + 1]]
        plain = self.reader.decompress(frame, max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(plain, f"<u{self.width}")


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else zstandard.ZstdCompressionDict(b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary; empty if there is too little to train on."""
    import zstandard

    total = sum(map(len, samples))
    if len(samples) < 8 or total < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 4), samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


def _writer(tokenizer: str, end_id: int | None, width: int, dictionary):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = encoder(tokenizer)
        plain = dictionary.value
        digest = hashlib.sha256(plain).digest()
        out = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(plain))
        tail = np.array([] if end_id is None else [end_id], f"<u{width}").tobytes()
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        frames: list[bytes] = []
        ids: list[int | None] = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal frames, ids, counts, seq, start
            n = sum(counts)
            row = [part, seq, ids[0], len(ids), n, start, pack(frames, ids, counts, width, digest)]
            frames, ids, counts, seq, start = [], [], [], seq + 1, start + n
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 6 + [pa.binary()])], ["part", "seq", "first_id", "documents", "tokens", "start", "container"])

        held = 0
        for batch in chunks(batches, most=4 << 20):
            flat, length = coder.encode(batch.column("text"))
            if len(flat) and int(flat.max()) >> 8 * width:
                raise ValueError(f"id {flat.max()} doesn't fit into {width} bytes")
            data = flat.astype(f"<u{width}").tobytes()
            at = 0
            for key, n in zip(batch.column("doc_id").to_pylist(), length.tolist()):
                frames.append(out.compress(data[at * width : (at + n) * width] + tail))
                ids.append(key)
                counts.append(n + len(tail) // width)
                held += n
                at += n
                if held >= CONTAINER_IDS:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return write


_ROWS = "part bigint, seq bigint, first_id bigint, documents bigint, tokens bigint, start bigint, container binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, *, doc_id: str = "doc_id", text: str = "text", end_id: int | None = None) -> str:
    """Encode and write all documents in ascending id order; returns the dataset's path. The tokenizer's largest id decides how wide ids are."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    coder = encoder(tokenizer)
    width = 2 if max(coder.largest_id(), end_id or 0) < 1 << 16 else 4
    order = F.xxhash64("doc_id", "text")
    # the hashes alone are ranked; texts reach the driver only for those up to the last of them
    ranked = docs.withColumn("rank", order)
    ranks = [r["rank"] for r in ranked.select("rank").orderBy("rank").limit(SAMPLE_DOCUMENTS).collect()]
    sample = [r["text"] for r in ranked.filter(F.col("rank") <= ranks[-1]).select(F.substring("text", 1, SAMPLE_CHARACTERS).alias("text")).limit(SAMPLE_DOCUMENTS).collect()] if ranks else []
    flat, length = coder.encode(sample)
    ends = np.cumsum(length)
    plain = train([flat[b - n : b].astype(f"<u{width}").tobytes() for b, n in zip(ends, length) if n])
    spark.createDataFrame([(hashlib.sha256(plain).hexdigest(), bytearray(plain))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = docs.repartitionByRange("doc_id", order).sortWithinPartitions("doc_id", order)
    parts.mapInArrow(tidy(_writer(tokenizer, end_id, width, spark.sparkContext.broadcast(plain)), keep=True), _ROWS).write.parquet(f"{path}/containers")
    return path


def _reader(dictionary, base):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                box = Container(row["container"], dictionary.value)
                ends = np.cumsum(box.counts)
                start = base[row["part"]] + row["start"] + ends - box.counts
                crc = [zlib.crc32(box.read(i).astype("<u4").tobytes()) for i in range(box.documents)]
                yield pa.RecordBatch.from_arrays([pa.array(box.ids, pa.int64()), pa.array(start, pa.int64()), pa.array(box.counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def open_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The containers and the dictionary of a written dataset."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    plain = bytes(row["dictionary"])
    if hashlib.sha256(plain).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary is damaged")
    return spark.read.schema(_ROWS).parquet(f"{path}/containers"), plain


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    boxes, plain = open_dataset(spark, path)
    base, total = {}, 0
    for part, n in sorted(boxes.groupBy("part").agg(F.sum("tokens")).collect()):
        base[part], total = total, total + n
    return boxes.select("part", "start", "container").mapInArrow(tidy(_reader(spark.sparkContext.broadcast(plain), base)), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
