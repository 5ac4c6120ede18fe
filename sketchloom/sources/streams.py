"""Addresses opened where a task runs: local and shared files, web addresses and object stores, as streams of bytes."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

#: Schemes that tasks open themselves; what has another one is read by Spark's own file systems.
WEB = ("http", "https", "ftp")
STORES = ("s3", "gs", "gcs", "hdfs", "abfs", "abfss")
OWN = ("", "file", *WEB, *STORES)
_PART = 1 << 20


def scheme(address: str) -> str:
    return address.split(":", 1)[0].lower() if ":" in address.split("/", 1)[0] else ""


def local(address: str) -> str:
    """The path of a local or shared file."""
    return re.sub("^file:(//)?", "", address, flags=re.IGNORECASE)


def open_address(address: str, seconds: int = 60):
    """A binary stream of what is at an address."""
    kind = scheme(address)
    if kind in ("", "file"):
        return open(local(address), "rb")
    if kind in WEB:
        from urllib.request import urlopen

        return urlopen(address, timeout=seconds)
    if kind in STORES:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(address)
        return store.open_input_file(path)
    raise ValueError(f"tasks can't open {kind}: addresses")


def _ending(address: str) -> str:
    path = urlsplit(address).path if scheme(address) in WEB else address
    return next((e for e in (".zst", ".gz") if path.endswith(e)), "")


def unpacked(source, address: str) -> Iterator[bytes]:
    """The bytes of a stream in parts, unpacked as the address's ending says; a stream that ends too early is an error when its end is reached."""
    ending = _ending(address)
    if ending == ".gz":
        source = gzip.GzipFile(fileobj=source)
    if ending == ".zst":
        import zstandard

        plain = None
        while left := source.read(_PART):
            while left:
                plain = plain or zstandard.ZstdDecompressor().decompressobj()
                yield plain.decompress(left)
                left = plain.unused_data if plain.eof else b""
                if plain.eof:  # another frame may follow
                    plain = None
        if plain:
            raise EOFError("the stream ends inside of a frame")
        return
    while part := source.read(_PART):
        yield part


def lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Lines, without their ends, of bytes that come in parts."""
    rest: list[bytes] = []
    for part in parts:
        first, *more = part.split(b"\n")
        rest.append(first)
        for line in more:
            yield b"".join(rest)
            rest = [line]
    if last := b"".join(rest):
        yield last


def in_memory(content: bytes):
    return io.BytesIO(content)
