"""The archive file: its header and the dictionary in it, to bytes and back.

    6 bytes magic, 8 bytes size of the dictionary, dictionary, 8 bytes offset of the payload, 64 bytes BLAKE2b of all before,
    then stored chunks back to back. Numbers are little-endian; the dictionary is a protocol buffers message.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from chunkloom.config import ALGORITHMS, CODECS, ChunkerConfig, Compression
from chunkloom.errors import ArchiveError

# The signature that files of this format begin with, now and in older files.
MAGIC = b"BITA1\0"
OLD_MAGIC = b"\0BITA1"
PREFIX, SUFFIX = len(MAGIC) + 8, 8 + 64

# Field numbers of the messages, with the kind of each field (a number, bytes, text or a message).
DESCRIPTOR = {1: ("hash", "bytes"), 3: ("archive_size", "number"), 4: ("archive_offset", "number"), 5: ("source_size", "number")}
PARAMS = {1: ("filter_bits", "number"), 2: ("min_size", "number"), 3: ("max_size", "number"), 4: ("window_size", "number"), 5: ("hash_length", "number"), 6: ("algorithm", "number")}
COMPRESSION = {2: ("codec", "number"), 3: ("level", "number")}
ENTRY = {1: ("key", "text"), 2: ("value", "bytes")}
MESSAGE = {
    1: ("application_version", "text"),
    2: ("source_checksum", "bytes"),
    3: ("source_total_size", "number"),
    4: ("chunker_params", PARAMS),
    5: ("compression", COMPRESSION),
    6: ("rebuild_order", "numbers"),
    7: ("chunk_descriptors", [DESCRIPTOR]),
    8: ("metadata", [ENTRY]),
}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ArchiveError("the dictionary is cut off")
        b = data[at]
        out, at, shift = out | (b & 0x7F) << shift, at + 1, shift + 7
        if b < 0x80:
            return out, at


def encode(values: dict, schema: dict) -> bytes:
    """A message; numbers of zero and empty values are left out."""
    out = []
    for number, (name, kind) in sorted(schema.items()):
        value = values.get(name)
        if not value and not isinstance(kind, list):
            continue
        if kind == "number":
            out.append(_varint(number << 3) + _varint(value))
            continue
        parts = [encode(v, kind[0]) for v in value or []] if isinstance(kind, list) else [b"".join(map(_varint, value))] if kind == "numbers" else [encode(value, kind)] if isinstance(kind, dict) else [value.encode() if kind == "text" else bytes(value)]
        out += [_varint(number << 3 | 2) + _varint(len(p)) + p for p in parts]
    return b"".join(out)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        if tag & 7 == 0:
            value, at = _read_varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if tag & 7 == 2:
                size, at = _read_varint(data, at)
            if size is None or at + size > len(data):
                raise ArchiveError("the dictionary is damaged")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def decode(data: bytes, schema: dict) -> dict:
    """The fields of a message by name, with defaults for those that it doesn't have; unknown fields are passed over."""
    out = {name: [] if isinstance(kind, list) or kind == "numbers" else {"number": 0, "text": "", "bytes": b""}.get(kind if isinstance(kind, str) else "", None) for name, kind in schema.values()}
    for name, kind in schema.values():
        if isinstance(kind, dict):
            out[name] = decode(b"", kind)
    for number, value in _fields(data):
        if number not in schema:
            continue
        name, kind = schema[number]
        if isinstance(kind, list):
            out[name].append(decode(value, kind[0]))
        elif kind == "numbers":
            if isinstance(value, int):
                out[name].append(value)
            else:
                at = 0
                while at < len(value):
                    n, at = _read_varint(value, at)
                    out[name].append(n)
        else:
            out[name] = decode(value, kind) if isinstance(kind, dict) else value.decode() if kind == "text" else value
    return out


@dataclass
class Dictionary:
    """All that the header tells; offsets of descriptors count from the start of the file."""

    source_checksum: bytes = b""
    source_total_size: int = 0
    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)
    compression: Compression = field(default_factory=lambda: Compression(None))
    rebuild_order: list[int] = field(default_factory=list)
    descriptors: list[dict] = field(default_factory=list)
    metadata: dict[str, bytes] = field(default_factory=dict)
    application_version: str = ""
    payload_offset: int = 0
    header_size: int = 0
    header_checksum: bytes = b""

    def metadata_value(self, key: str) -> bytes:
        if key not in self.metadata:
            raise KeyError(f"no metadata {key!r}")
        return self.metadata[key]


def build(d: Dictionary) -> bytes:
    """The header's bytes; the dictionary's descriptors must count from the start of the payload."""
    params = d.chunker.to_params()
    message = encode(
        {
            "application_version": d.application_version,
            "source_checksum": d.source_checksum,
            "source_total_size": d.source_total_size,
            "chunker_params": params | {"algorithm": ALGORITHMS.index(params["algorithm"])},
            "compression": {"codec": CODECS.index(d.compression.codec or "none"), "level": d.compression.level},
            "rebuild_order": d.rebuild_order,
            "chunk_descriptors": d.descriptors,
            "metadata": [{"key": k, "value": v} for k, v in sorted(d.metadata.items())],
        },
        MESSAGE,
    )
    head = MAGIC + struct.pack("<Q", len(message)) + message
    head += struct.pack("<Q", len(head) + SUFFIX)
    return head + hashlib.blake2b(head).digest()


def parse(read, table: tuple[int, ...] | None = None) -> Dictionary:
    """The dictionary of an archive; read(offset, size) gives its bytes. Two reads, whatever the archive's size."""
    prefix = read(0, PREFIX)
    if len(prefix) < PREFIX or prefix[: len(MAGIC)] not in (MAGIC, OLD_MAGIC):
        raise ArchiveError("no archive")
    (size,) = struct.unpack("<Q", prefix[len(MAGIC) :])
    rest = read(PREFIX, size + SUFFIX)
    if len(rest) < size + SUFFIX:
        raise ArchiveError("the header is cut off")
    head, checksum = prefix + rest[:-64], rest[-64:]
    if hashlib.blake2b(head).digest() != checksum:
        raise ArchiveError("the header's checksum is wrong")
    (payload,) = struct.unpack("<Q", head[-8:])
    x = decode(rest[:size], MESSAGE)
    params, packed = x["chunker_params"], x["compression"]
    if params["algorithm"] >= len(ALGORITHMS) or packed["codec"] >= len(CODECS):
        raise ArchiveError("unknown algorithm or codec")
    codec = CODECS[packed["codec"]]
    return Dictionary(
        x["source_checksum"],
        x["source_total_size"],
        ChunkerConfig.from_params(params | {"algorithm": ALGORITHMS[params["algorithm"]]}, table),
        Compression(None) if codec == "none" else Compression(codec, packed["level"]),
        x["rebuild_order"],
        [c | {"archive_offset": c["archive_offset"] + payload} for c in x["chunk_descriptors"]],
        {e["key"]: e["value"] for e in x["metadata"]},
        x["application_version"],
        payload,
        len(head) + 64,
        checksum,
    )
