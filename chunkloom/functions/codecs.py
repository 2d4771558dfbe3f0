"""Compression of chunks: what is stored is compressed only where that is smaller."""

from __future__ import annotations

import lzma

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkloom.config import Compression
from chunkloom.errors import CompressionError


def squeeze(data: bytes, how: Compression) -> bytes:
    if how.codec is None:
        return data
    if how.codec == "brotli":
        return pa.Codec("brotli", how.level).compress(data, asbytes=True)
    if how.codec == "lzma":
        return lzma.compress(data, preset=how.level)
    import zstandard

    return zstandard.ZstdCompressor(level=how.level).compress(data)


def expand(data: bytes, codec: str | None, size: int) -> bytes:
    """The `size` bytes that were compressed; data of another size is damaged."""
    try:
        if codec is None:
            out = data
        elif codec == "brotli":
            out = pa.Codec("brotli").decompress(data, size, asbytes=True) if size else b""
        elif codec == "lzma":
            out = lzma.decompress(data)
        elif codec == "zstd":
            import zstandard

            out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        else:
            raise CompressionError(f"unknown codec {codec!r}")
    except (OSError, lzma.LZMAError, EOFError) as e:
        raise CompressionError(str(e)) from e
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            raise CompressionError(str(e)) from e
        raise
    if len(out) != size:
        raise CompressionError(f"{len(out)} bytes instead of {size}")
    return out


def compressed(data: Column, how: Compression) -> Column:
    """The compressed form of a binary column, even where it is larger."""
    if how.codec is None:
        return data

    @F.arrow_udf("binary")
    def work(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else squeeze(x, how) for x in data.to_pylist()], pa.binary())

    return work(data)


def smaller(data: Column, packed: Column) -> Column:
    """What an archive stores: the compressed form if it is smaller."""
    return F.when(F.length(packed) < F.length(data), packed).otherwise(data)


def codec_of(archive_size: Column, source_size: Column, codec: str | None) -> Column:
    """The codec of a stored chunk; null if it is stored as it is, which equal sizes tell."""
    return F.when(archive_size != source_size, F.lit(codec))


def expanded(stored: Column, codec: Column, source_size: Column) -> Column:
    """The data of stored chunks; a chunk that doesn't expand to its size fails the query."""

    @F.arrow_udf("binary")
    def work(stored: pa.Array, codec: pa.Array, size: pa.Array) -> pa.Array:
        rows = zip(stored.to_pylist(), codec.to_pylist(), size.to_pylist())
        return pa.array([None if x is None else expand(x, c, n) for x, c, n in rows], pa.binary())

    return work(stored, codec, source_size)
