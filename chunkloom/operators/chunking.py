"""Chunks of files: one row for each value in, one for each chunk out."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.config import ChunkerConfig
from chunkloom.errors import ConfigError
from chunkloom.functions.hashes import ALGORITHMS, digest, hash_of, joined, truncate

from .kernels import Scanner, chunk_ends, rolling_sums

#: Bytes of an Arrow batch, and of values that are cut together.
BATCH, TOGETHER = 16 << 20, 2 << 20


def _by_bytes(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def _streams(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time, with the bytes of their values end to end and where each starts; null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            values = batch.column(column).slice(a, b - a).cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = values.buffers()
            at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + b - a + 1]
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
            yield batch.slice(a, b - a), raw, at - at[0]


def chunks(df: DataFrame, config: ChunkerConfig, *, key: str = "file_id", content: str = "content", hash_algorithm: str = "blake2b", with_data: bool = False) -> DataFrame:
    """(key, seq, offset, length, hash[, data]): the chunks of every value, in order of seq from 0.

    content: text (as UTF-8) or binary. The hash is cut to the config's length. An empty or null value has no chunks. One pass over
    Arrow batches, no shuffle; data is returned only if asked for, so that later shuffles don't carry it.
    """
    if hash_algorithm not in ALGORITHMS:
        raise ConfigError(f"unknown hash {hash_algorithm!r}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in _streams(batches):
            ends = chunk_ends(raw, at, config)
            counts = [len(e) for e in ends]
            if not sum(counts):
                continue
            row = np.repeat(np.arange(len(ends)), counts)
            local = np.concatenate(ends)
            first = np.concatenate([[True], row[1:] != row[:-1]])
            begin = np.where(first, 0, np.concatenate([[0], local[:-1]]))
            seq = np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            data = raw.tobytes()
            pieces = [data[a:b] for a, b in zip((begin + at[row]).tolist(), (local + at[row]).tolist())]
            hashes = [digest(x, hash_algorithm)[: config.hash_length] for x in pieces]
            columns = [rows.column(0).take(pa.array(row)), pa.array(seq), pa.array(begin), pa.array(local - begin), pa.array(hashes, pa.binary())]
            names = ["key", "seq", "offset", "length", "hash"]
            whole = pa.RecordBatch.from_arrays(columns + ([pa.array(pieces, pa.binary())] if with_data else []), names=names + ["data"] * with_data)
            for k in range(0, whole.num_rows, 10_000):
                yield whole.slice(k, 10_000)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, seq long, offset long, length long, hash binary" + ", data binary" * with_data
    return _by_bytes(df).select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(work, schema).withColumnRenamed("key", key)


def fixed_chunks(df: DataFrame, size: int, *, key: str = "file_id", content: str = "content", with_data: bool = False) -> DataFrame:
    """(key, seq, offset, length, hash[, data]) of chunks of `size` bytes, SHA-256, by column expressions alone."""
    data = F.col(content).cast("binary")
    starts = F.when(F.length(data) > 0, F.sequence(F.lit(0).cast("long"), F.length(data).cast("long") - 1, F.lit(size).cast("long")))
    cut = df.select(F.col(key), data.alias("content_"), F.posexplode(starts).alias("seq", "offset"))
    piece = F.substring("content_", F.col("offset").cast("int") + 1, F.lit(size))
    out = cut.select(key, F.col("seq").cast("long").alias("seq"), "offset", piece.alias("data"))
    out = out.select(key, "seq", "offset", F.length("data").cast("long").alias("length"), F.unhex(F.sha2("data", 256)).alias("hash"), "data")
    return out if with_data else out.drop("data")


def candidates(df: DataFrame, config: ChunkerConfig, *, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, place, sum): every byte after which the filter would allow a boundary, whatever the sizes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(config.mask)
        for rows, raw, at in _streams(batches):
            sums = rolling_sums(raw, at[:-1], config)
            hit = np.flatnonzero((sums & mask) == mask)
            row = np.searchsorted(at, hit, "right") - 1
            place = hit - at[row]
            full = place >= config.window if config.algorithm == "buzhash" else np.ones(len(hit), bool)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row[full])), pa.array(place[full]), pa.array(sums[hit][full].astype(np.int64))], names=["key", "place", "sum"])

    kind = df.schema[key].dataType.simpleString()
    return _by_bytes(df).select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(work, f"key {kind}, place long, sum long").withColumnRenamed("key", key)


def chunks_of_splits(splits: DataFrame, config: ChunkerConfig, *, key: str = "file_id", hash_algorithm: str = "blake2b", with_data: bool = False) -> DataFrame:
    """(key, seq, offset, length, hash[, data]) of files that come as rows (key, split_offset, content), too large for one value.

    Candidates are found split by split; those whose window reaches into the split before come from a narrow table of the splits'
    first and last bytes. The choice among them is made file by file over candidates alone; chunks are then put together from the
    splits that they touch. A split must have a window's bytes, but for the last. Streams to which the buzhash exception applies are
    not cut this way: they raise.
    """
    back = max(config.window - 1, 1)
    mask = np.uint64(config.mask)
    kind = splits.schema[key].dataType.simpleString()
    rows = _by_bytes(splits).select(F.col(key).alias("key"), "split_offset", F.coalesce(F.col("content").cast("binary"), F.lit(b"").cast("binary")).alias("content"))

    def found_in(x: np.ndarray) -> np.ndarray:
        return np.flatnonzero((rolling_sums(x, np.zeros(1, np.int64), config) & mask) == mask)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, offset, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(content.as_buffer(), np.uint8)
                found = np.zeros(0, np.int64)
                if config.algorithm != "fixed" and len(x):
                    if config.algorithm == "buzhash" and offset == 0 and not x[: config.min_size + config.window + 1].all():
                        raise ConfigError("a buzhash stream with zeros near its start must be cut whole")
                    found = found_in(x)
                    found = (found if offset == 0 else found[found >= back]) + offset
                yield pa.RecordBatch.from_arrays([pa.array([k] * (len(found) + 1), batch.column(0).type), pa.array([*found.tolist(), -offset - len(x)], pa.int64())], names=["key", "place"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, offset, head, tail in zip(*(c.to_pylist() for c in batch.columns)):
                if len(tail) < back and offset > len(tail):
                    raise ConfigError("a split has fewer bytes than the window")
                found = found_in(np.frombuffer(tail + head, np.uint8))
                found = found[found >= len(tail)] - len(tail) + offset
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), batch.column(0).type), pa.array(found, pa.int64())], names=["key", "place"])

    places = rows.mapInArrow(hits, f"key {kind}, place long")
    if config.algorithm != "fixed":
        heads = rows.where("split_offset > 0 and length(content) > 0").select("key", "split_offset", F.substring("content", 1, back).alias("head"))
        tails = rows.select("key", (F.col("split_offset") + F.length("content")).alias("split_offset"), F.substring("content", -back, back).alias("tail")).where("length(tail) > 0")
        places = places.unionByName(heads.join(tails, ["key", "split_offset"]).select("key", "split_offset", "head", "tail").mapInArrow(edges, f"key {kind}, place long"))

    def cut(table: pa.Table) -> pa.Table:
        place = np.sort(table["place"].to_numpy())
        n, place = -int(place[0]), place[place >= 0]
        if config.algorithm == "fixed":
            ends = np.minimum(np.arange(config.max_size, n + config.max_size, config.max_size), n)
        else:
            ends, start, hit = [], 0, place.tolist()
            while start < n:
                test = start + config.first_tested
                if config.algorithm == "buzhash" and start == 0:
                    test = max(test, config.window)
                k = bisect_left(hit, test)
                start = min((hit[k] if k < len(hit) else n) + 1, start + config.max_size, n)
                ends.append(start)
            ends = np.array(ends, np.int64)
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return pa.table({"key": pa.array([table["key"][0].as_py()] * len(ends)), "seq": np.arange(len(ends)), "offset": begin, "length": ends - begin})

    bounds = places.groupBy("key").applyInArrow(cut, f"key {kind}, seq long, offset long, length long").withColumnRenamed("key", key)
    whole = splits.select(key, F.col("split_offset").alias("s"), (F.col("split_offset") + F.length("content")).alias("e"), F.col("content").cast("binary").alias("c"))
    step = config.max_size
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / step), F.floor((b - 1) / step))).alias("bin")
    # which splits a chunk touches is found without content; each split then meets its chunks once
    left = bounds.select("*", bins(F.col("offset"), F.col("offset") + F.col("length")))
    right = whole.where("e > s").select(key, "s", "e", bins(F.col("s"), F.col("e")))
    first = F.floor(F.greatest("s", "offset") / step)  # a pair is met in each bin that both touch, and kept in the first
    touch = left.join(right, [key, "bin"]).where("s < offset + length and offset < e").where(F.col("bin") == first)
    of_split = touch.groupBy(key, "s").agg(F.collect_list(F.struct("seq", "offset", "length")).alias("chunks"))

    def cut_out(x):
        a, b = F.greatest(x["offset"], F.col("s")), F.least(x["offset"] + x["length"], F.col("e"))
        part = F.substr("c", (a - F.col("s") + 1).cast("int"), (b - a).cast("int"))
        return F.struct(x["seq"].alias("seq"), x["offset"].alias("offset"), x["length"].alias("length"), part.alias("part"))

    touch = whole.join(of_split, [key, "s"]).select(key, "s", F.explode(F.transform("chunks", cut_out)).alias("x")).select(key, "s", "x.*")
    data = touch.groupBy(key, "seq", "offset", "length").agg(F.sort_array(F.collect_list(F.struct("s", "part"))).alias("parts"))
    whole = data.select(key, "seq", "offset", "length", joined(F.transform("parts", lambda x: x["part"])).alias("data"))
    return whole.select(key, "seq", "offset", "length", truncate(hash_of(F.col("data"), hash_algorithm), config.hash_length).alias("hash"), *["data"] * with_data)


__all__ = ["Scanner", "candidates", "chunks", "chunks_of_splits", "fixed_chunks"]
