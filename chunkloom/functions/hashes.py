"""Hashes of binary values, their prefixes and their text form."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from chunkloom.errors import ConfigError

ALGORITHMS = ("blake2b", "sha256")


def digest(data: bytes, algorithm: str = "blake2b") -> bytes:
    """The whole hash of some bytes: BLAKE2b of 64 bytes, or SHA-256 (which SQL engines have, too)."""
    if algorithm not in ALGORITHMS:
        raise ConfigError(f"unknown hash {algorithm!r}")
    return hashlib.blake2b(data).digest() if algorithm == "blake2b" else hashlib.sha256(data).digest()


@F.arrow_udf(BinaryType())
def _blake2b(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else hashlib.blake2b(x).digest() for x in data.to_pylist()], pa.binary())


def hash_of(data: Column, algorithm: str = "blake2b") -> Column:
    """The hash of a binary column; SHA-256 stays in the JVM."""
    if algorithm not in ALGORITHMS:
        raise ConfigError(f"unknown hash {algorithm!r}")
    return _blake2b(data) if algorithm == "blake2b" else F.unhex(F.sha2(data, 256))


def truncate(hash_: Column, length: int) -> Column:
    """The first bytes of a hash; a shorter one stays as it is. To be done on both sides before a join."""
    return F.substring(hash_, 1, length)


def same_prefix(a: Column, b: Column) -> Column:
    """Whether two hashes agree as far as the shorter goes; an empty one agrees with all."""
    n = F.least(F.length(a), F.length(b))
    return F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Bytes of hexadecimal text; an odd number of digits gets a leading zero, other characters are an error."""
    even = F.when(F.length(text) % 2 == 1, F.concat(F.lit("0"), text)).otherwise(text)
    return F.when(text.isNotNull(), F.to_binary(even, F.lit("hex")))


@F.arrow_udf(BinaryType())
def joined(parts: pa.Array) -> pa.Array:
    """The binary values of each array, end to end. They lie so in memory already: only where rows begin is new. Null counts as empty."""
    lists = parts.fill_null([]) if parts.null_count else parts
    flat = lists.flatten().cast(pa.large_binary()).fill_null(b"")
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(at[edges])), data or pa.py_buffer(b"")]).cast(pa.binary())
