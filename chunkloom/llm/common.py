"""Small helpers that the operators share: tables in the shared folder, Arrow batches, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Texts are taken from an Arrow batch in slices of about so many bytes, whatever its rows hold.
SLICE_BYTES = 1 << 20
#: What separates words, as a class for regular expressions.
SPACE = r"\x20\x09-\x0D"
#: The place of null keys, after all others.
LAST = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is set, but only if they are one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def going(spark: SparkSession, path: str) -> tuple:
    """The folder at path and its file system, to delete it by; it goes when the application ends, if not before."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(folder)
    return folder, files


def small_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch may hold very long texts, so batches are kept to about 8 MB, however many rows that is."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class Table:
    """A table written in the shared folder; it outlives executors and cuts the lineage. It goes when the application ends."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark).rstrip('/')}/chunkloom-{tag}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.folder, self.files = going(self.spark, self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, once nothing that is still to run reads them."""
        self.files.delete(self.folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores if the table already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_root(df: DataFrame, root: str, *endings: str) -> str:
    """root, or root with underscores, so that neither it nor it with any of the endings is a column of the table."""
    taken = {c.lower() for c in df.columns}
    while taken & {f"{root}{e}".lower() for e in ("", *endings)}:
        root += "_"
    return root


def with_place(df: DataFrame, key: str, name: str) -> DataFrame:
    """The table with a long column `name` that orders rows as the key does, null keys last. Keys that are no whole numbers are numbered in their order."""
    if isinstance(df.schema[key].dataType, IntegralType):
        return df.withColumn(name, F.coalesce(F.col(key).cast("long"), F.lit(LAST)))
    keys = df.select(F.col(key).alias("key")).where("key is not null").distinct().orderBy("key")
    other = f"{name}_key"
    numbers = Table(keys.select(F.col("key").alias(other), F.monotonically_increasing_id().alias(name)), "keys").df
    placed = df.join(numbers, F.col(key) == F.col(other), "left")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(name, F.lit(LAST)).alias(name))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, a few at a time, so that the texts of a slice have about `limit` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = pa.large_binary()
    else:
        kind = pa.binary()
    column = column.cast(kind).fill_null(b"")
    dtype = np.int64 if kind == pa.large_binary() else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=dtype)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return out + np.arange(total)


def binary_rows(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of fixed-size numbers as one binary value per run, in the machine's (little-endian) order."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(np.asarray(counts) * flat.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the words before each row (rows + 1 numbers).

    Words are runs of other bytes than the six ASCII blanks; a row's end also ends a word.
    """
    solid = ~_IS_SPACE[raw]
    begins = solid.copy()
    ends = solid.copy()
    if len(raw):
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: The first powers of a base, which most slices need no more of; kept by each worker, 16 MB for a base at most.
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64; not to be written to."""
    kept = _POWERS.get(int(base))
    if kept is not None and len(kept) >= n:
        return kept[:n]
    size = n if n > 1 << 21 else 1 << max(n - 1, 1).bit_length()
    out = np.full(size, base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if size <= 1 << 21:
        _POWERS[int(base)] = out
    return out[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each span, in a time linear in the bytes."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(_BASE, n), out=sums[1:])
    value = (sums[stops] - sums[starts]) * powers(_BASE_INVERSE, n + 1)[starts]
    return mix64(value + (stops - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n words in a row, for every position from which n words follow."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), out=sums[1:])
    return mix64((sums[n:] - sums[:-n]) * powers(_BASE_INVERSE, count))


def run_sums(words: np.ndarray):
    """A function that gives a hash of the words from start to stop, for spans of any lengths; what it needs of all words is taken once."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), out=sums[1:])
    inverse = powers(_BASE_INVERSE, len(words) + 1)
    return lambda starts, stops: mix64((sums[stops] - sums[starts]) * inverse[starts])


def run_hashes(words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the words from start to stop, for spans of any lengths."""
    return run_sums(words)(starts, stops)
