"""Media columns: Matroska files as packet tables.

:func:`parse` reads EBML elements with variable-length ids and sizes (unknown
sizes too), tracks, clusters, SimpleBlocks and BlockGroups with no, Xiph, EBML
or fixed-size lacing, and cues, and returns one packet for each frame with its
track, timestamp and byte range. :func:`build` writes audio samples as such a
file. :func:`packet_table` is the operator for binary columns,
:func:`store_payloads` the one that stores texts as 8-bit samples and reads them
back.

Scale: a row at a time, no shuffle; memory is a few times the largest text.

Defined cases: null text is empty (one frame of padding); null media has no
packets; a file that ends or breaks in the middle gives the packets before that
and ``complete`` false; texts of any length are one file, within what a row may
hold; repeated rows give equal results each; further columns are left out; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sketchloom.llm.textkit import chunks, pick, text_of

FRAME = 576
RATE = 48_000
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 64

# Element ids of the public Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
TRACK, NUMBER, UID, KIND, CODEC, LACING, AUDIO, SAMPLING, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: A segment or cluster of unknown size ends where an element begins that cannot be in it.
_LEVEL1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}


class Broken(ValueError):
    """The data end or break here."""


def size_bytes(n: int, width: int = 0) -> bytes:
    """``n`` as a variable-length integer; all ones are left for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def vint(data: bytes, at: int, marker: bool = False) -> tuple[int | None, int]:
    """A variable-length integer (ids keep their marker) and where it ends; None: unknown size."""
    if at >= len(data) or not data[at]:
        raise Broken
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Broken
    value = int.from_bytes(data[at : at + width], "big")
    if marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def signed(data: bytes, at: int) -> tuple[int, int]:
    value, to = vint(data, at)
    width = to - at
    bias = (1 << 7 * width - 1) - 1
    return ((1 << 7 * width) - 1 if value is None else value) - bias, to


def elements(data: bytes, at: int, end: int, unknown: Callable[[int, int], int] | None = None) -> Iterator[tuple[int, int, int]]:
    """Ids with the start and end of their bodies; ``unknown`` finds the end of one without a size. The end is negative for a body that is cut short, which is the last one."""
    while at < end:
        key, to = vint(data, at, True)
        size, to = vint(data, to)
        if size is None:
            if unknown is None:
                raise Broken
            size = unknown(key, to) - to
        if to + size > end:
            yield key, to, -end
            raise Broken
        yield key, to, to + size
        at = to + size


@dataclass
class Packet:
    track: int
    timestamp: int
    offset: int
    size: int
    cluster: int
    keyframe: bool


@dataclass
class File:
    """What was read; timestamps are in nanoseconds."""

    scale: int = 1_000_000
    doc_type: str = ""
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    lacings: set[int] = field(default_factory=set)
    complete: bool = True


def frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Offsets and sizes of the frames of a block's body; lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise Broken
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise Broken
        step = (end - at) // n
        return [(at + i * step, step) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Broken
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        elif not i:
            size, at = vint(data, at)
        else:
            step, at = signed(data, at)
            size = sizes[-1] + step
        if size is None or size < 0:
            raise Broken
        sizes.append(size)
    rest = end - at - sum(sizes)
    if rest < 0:
        raise Broken
    out = []
    for size in [*sizes, rest]:
        out.append((at, size))
        at += size
    return out


def _value(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _real(data: bytes, at: int, end: int) -> float:
    return struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end - at in (4, 8) else 0.0


def _block(out: File, data: bytes, at: int, end: int, base: int, cluster: int, simple: bool) -> None:
    track, at = vint(data, at)
    if track is None or at + 3 > end:
        raise Broken
    (relative,), flags, at = struct.unpack(">h", data[at : at + 2]), data[at + 2], at + 3
    lacing = flags >> 1 & 3
    parts = frames(data, at, end, lacing)
    out.lacings.add(lacing)
    step = out.tracks.get(track, {}).get("frame_ns", 0)
    first = (base + relative) * out.scale
    for i, (offset, size) in enumerate(parts):
        out.packets.append(Packet(track, first + i * step, offset, size, cluster, bool(flags & 0x80) if simple else False))


def _track(data: bytes, at: int, end: int) -> tuple[int, dict]:
    n, info = 0, {"kind": 0, "codec": "", "rate": 0.0, "channels": 1, "depth": 0, "frame_ns": 0}
    for key, a, b in elements(data, at, end):
        if key == NUMBER:
            n = _value(data, a, b)
        elif key == KIND:
            info["kind"] = _value(data, a, b)
        elif key == CODEC:
            info["codec"] = data[a:b].decode("ascii", "replace").rstrip("\0")
        elif key == 0x23E383:
            info["frame_ns"] = _value(data, a, b)
        elif key == AUDIO:
            for inner, c, d in elements(data, a, b):
                if inner == SAMPLING:
                    info["rate"] = _real(data, c, d)
                elif inner in (CHANNELS, DEPTH):
                    info["channels" if inner == CHANNELS else "depth"] = _value(data, c, d)
    return n, info


def parse(data: bytes) -> File:
    """All of a Matroska file; never raises for broken data."""
    out = File()
    try:
        _file(out, data)
    except (Broken, TypeError, struct.error):
        out.complete = False
    return out


def _next_of(data: bytes, at: int, end: int, stop: set[int]) -> int:
    """Where an element of unknown size ends: before the first of the ids in ``stop``, or at ``end``."""
    while at < end:
        key, to = vint(data, at, True)
        if key in stop:
            return at
        size, to = vint(data, to)
        if size is None:
            raise Broken
        at = min(end, to + size)
    return end


def _file(out: File, data: bytes) -> None:
    first = True
    for key, at, end in elements(data, 0, len(data), lambda key, at: len(data)):
        if first and key != EBML:
            raise Broken
        first = False
        if key == EBML:
            for inner, a, b in elements(data, at, abs(end)):
                if inner == DOC_TYPE:
                    out.doc_type = data[a:b].decode("ascii", "replace")
        elif key == SEGMENT:
            _segment(out, data, at, abs(end))
    if first:
        raise Broken


def _segment(out: File, data: bytes, start: int, end: int) -> None:
    for key, at, to in elements(data, start, end, lambda key, at: _next_of(data, at, end, _LEVEL1) if key == CLUSTER else end):
        to = abs(to)
        if key == INFO:
            for inner, a, b in elements(data, at, to):
                if inner == SCALE:
                    out.scale = _value(data, a, b)
        elif key == TRACKS:
            for inner, a, b in elements(data, at, to):
                if inner == TRACK:
                    n, info = _track(data, a, b)
                    out.tracks[n] = info
        elif key == CLUSTER:
            _cluster(out, data, at, to)
        elif key == CUES:
            _cues(out, data, at, to)


def _cluster(out: File, data: bytes, at: int, end: int) -> None:
    base, number_ = 0, len(out.clusters)
    out.clusters.append(at)
    for key, a, b in elements(data, at, end):
        if b < 0:
            raise Broken
        if key == TIMESTAMP:
            base = _value(data, a, b)
        elif key == SIMPLE_BLOCK:
            _block(out, data, a, b, base, number_, True)
        elif key == BLOCK_GROUP:
            for inner, c, d in elements(data, a, b):
                if inner == BLOCK:
                    _block(out, data, c, d, base, number_, False)


def _cues(out: File, data: bytes, at: int, end: int) -> None:
    for key, a, b in elements(data, at, end):
        if key != CUE_POINT:
            continue
        time, track, place = 0, 0, 0
        for inner, c, d in elements(data, a, b):
            if inner == CUE_TIME:
                time = _value(data, c, d)
            elif inner == CUE_POSITIONS:
                for deep, e, f in elements(data, c, d):
                    if deep == CUE_TRACK:
                        track = _value(data, e, f)
                    elif deep == CUE_CLUSTER:
                        place = _value(data, e, f)
        out.cues.append((time * out.scale, track, place))


def build(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """8-bit mono samples, a multiple of ``frame``, as a Matroska file with fixed-size lacing and cues."""
    count = len(payload) // frame
    ms = frame * 1000 / rate
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", count * ms)) + element(0x4D80, b"sketchloom") + element(0x5741, b"sketchloom"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(rate))) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + number(0x23E383, round(ms * 1e6)) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    place = len(info) + len(tracks)
    per = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, count, per):
        base = round(first * ms)
        parts = [number(TIMESTAMP, base)]
        for f in range(first, min(first + per, count), FRAMES_PER_BLOCK):
            n = min(FRAMES_PER_BLOCK, count - f)
            head = b"\x81" + struct.pack(">h", round(f * ms) - base) + (bytes([0x84, n - 1]) if n > 1 else b"\x80")
            parts.append(element(SIMPLE_BLOCK, head + payload[f * frame : (f + n) * frame]))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def padded(text: bytes, unit: int = FRAME) -> bytes:
    """``text`` with bytes 255 up to a positive multiple of ``unit``."""
    return text + b"\xff" * (max(1, -(-len(text) // unit)) * unit - len(text))


def features(media: File, payload: bytes) -> str:
    """Exact features of the packets and samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    last = media.packets[-1] if media.packets else None
    length = (last.timestamp + media.tracks[last.track]["frame_ns"]) // 1_000_000 if last else 0
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    levels = np.bincount(x, minlength=256)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={length};sum={int(x.sum(dtype=np.int64))};squares={int(levels @ (np.arange(256) ** 2))};crossings={crossings};levels={int(np.count_nonzero(levels))}"


_PACKET = "doc_id bigint, packet bigint, track bigint, timestamp_ns bigint, cluster bigint, keyframe boolean, offset bigint, size bigint, complete boolean"


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PACKET.split(", ")]
    kinds = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in _PACKET.split(", ")]
    for batch in batches:
        for key, media in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
            got = parse(b"" if media.as_py() is None else media.as_py())
            rows = [(key, i, p.track, p.timestamp, p.cluster, p.keyframe, p.offset, p.size, got.complete) for i, p in enumerate(got.packets)]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000]), kinds)], names)


def packet_table(files: DataFrame, *, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each packet of each Matroska file of a binary column."""
    return pick(files, doc_id=doc_id, media=media).mapInArrow(_packets, _PACKET)


def _store(keep: bool):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                plain = text_of(text)
                media = build(padded(plain))
                got = parse(media)
                back = b"".join([media[p.offset : p.offset + p.size] for p in got.packets])
                rows.append((len(plain), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(got, back), media if keep else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return store


def store_payloads(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """Per row: the text stored as a Matroska file (``media``), and digests and features of what is read back from it."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media binary"
    out = pick(docs, doc_id=doc_id, text=text).mapInArrow(_store(keep_media), schema)
    return out if keep_media else out.drop("media")
