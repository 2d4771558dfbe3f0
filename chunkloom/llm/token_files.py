"""Token files: ids of all documents in key order, Huffman-coded, in blocks that decode on their own.

A folder holds three Parquet tables, each written by one Spark job (so a lost executor costs a task):

    codebook  id int, bits int                 the length of each id's code; the codes follow from it
    blocks    shard int, block int, first long (ids of the shard before it), keys array, n_ids array<long>,
              sizes array<long> (bytes of each document), marks binary, data binary
    shards    shard int, base long             ids of all shards before it

Codes are canonical: by length and then id, counting up. No code is longer than LIMIT bits, so one
table lookup decodes an id. In `data` every document starts at a byte; `marks` has the bit offset in its
document of every STEP-th id (unsigned 32-bit, or 64-bit where wide), so that a reader can start
there, and does: all stretches of a block are decoded abreast.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import coder_of
from .common import Table, binary_rows, going, ragged, shared_folder, slices, small_batches, text_bytes

#: Longest code in bits (more only if there are more ids than codes), ids between marks, ids in a block, ids in a shard (more beyond SHARDS shards).
LIMIT, STEP, BLOCK, SHARD, SHARDS = 16, 256, 1 << 20, 1 << 24, 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over `limit` bits, by package-merge; all counts over 0."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:need].sum())
        lengths[:taken] += 1
        need = 2 * (need - taken)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of ids with given lengths."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        self.limit = int(bits.max(initial=1))
        order = np.lexsort((ids, bits))
        spans = np.int64(1) << (self.limit - bits[order])
        firsts = np.cumsum(spans) - spans
        self.code = np.zeros(int(ids.max(initial=0)) + 1, np.uint64)
        self.bits = np.zeros(len(self.code), np.int64)
        self.code[ids[order]] = firsts >> (self.limit - bits[order])
        self.bits[ids] = bits
        room = (1 << self.limit) - int(spans.sum())
        self.symbol = np.append(np.repeat(ids[order], spans), np.zeros(room, np.int64)).astype(np.uint32)
        self.length = np.append(np.repeat(bits[order], spans), np.ones(room, np.int64)).astype(np.uint8)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, the bytes of each document, and the bit offsets in its document of every STEP-th id but the first."""
        bits = self.bits[ids]
        after = np.cumsum(bits)
        edges = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(counts)])]
        sizes = (np.diff(edges) + 7) // 8
        begin = 8 * (np.cumsum(sizes) - sizes)
        at = after - bits + np.repeat(begin - edges[:-1], counts)
        word, value = at >> 5, self.code[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        n = int(sizes.sum()) // 4 + 2
        words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        data = words.astype(np.uint32).astype(">u4").view(np.uint8)[: int(sizes.sum())]
        marks = np.maximum(counts - 1, 0) // STEP
        first = np.cumsum(counts) - counts
        where = np.repeat(first, marks) + STEP * (ragged(np.ones_like(marks), marks))
        return data, sizes, at[where] - np.repeat(begin, marks)

    def decode(self, data: np.ndarray, counts: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The ids of all documents, all stretches between marks abreast."""
        lanes = np.maximum(counts - 1, 0) // STEP + (counts > 0)
        inner = ragged(np.zeros_like(lanes), lanes)
        at = np.repeat(8 * (np.cumsum(sizes) - sizes), lanes)
        at[inner > 0] += marks
        left = np.minimum(np.repeat(counts, lanes) - STEP * inner, STEP)
        to = np.repeat(np.cumsum(counts) - counts, lanes) + STEP * inner
        order = np.argsort(-left, kind="stable")
        at, left, to = at[order], left[order], to[order]
        words = np.concatenate([data, np.zeros(12 - len(data) % 4, np.uint8)]).view(">u4").astype(np.uint64)
        pairs = words[:-1] << np.uint64(32) | words[1:]
        out = np.zeros(int(counts.sum()), np.uint32)
        shift = np.uint64(64 - self.limit)
        for k in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -k, "left"))
            pos = at[:m]
            code = (pairs[pos >> 5] << (pos & 31).astype(np.uint64)) >> shift
            out[to[:m] + k] = self.symbol[code]
            at[:m] += self.length[code]
        return out


def _coded_ids(df: DataFrame, definition: str, pattern: str, end: int, key: str, text: str, added: bool) -> tuple[DataFrame, type]:
    """(key, n, ids): the ids of each text and the end id, in as few bytes as the vocabulary allows."""
    spec = json.loads(definition)
    if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
        raise ValueError("only byte-level definitions without a normalizer or a prefix space are supported")
    highest = max([end, *spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", []))])
    small = np.uint16 if highest < 1 << 16 else np.uint32
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(definition, pattern, added)
        for part in slices(batches):
            ids, counts = coder.encode(part.column(1))
            ids = np.insert(ids, np.cumsum(counts), end).astype(small)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts + 1, pa.int64()), binary_rows(ids, counts + 1)], names=["key", "n", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"key {df.schema[key].dataType.simpleString()}, n long, ids binary"), small


def _flat(column: pa.Array, small) -> np.ndarray:
    raw, _ = text_bytes(column)
    return np.frombuffer(raw.tobytes(), small)


def write_tokens(df: DataFrame, path: str, definition: str, pattern: str, end: int, *, key: str = "doc_id", text: str = "text", added: bool = True) -> None:
    """Write the ids of every whole text, `end` after each, in ascending key order.

    A null or empty text has the end id alone. Null keys come first; rows with equal keys follow each
    other in the order of a hash of their coded ids. Only key and text are read, so other columns' names don't matter. An empty table
    gives empty tables. added: tokens that the definition adds to its vocabulary are found in the texts, as
    Tokenizer.encode does unless told otherwise. Ids are made once and kept in the shared folder, then Huffman-coded; what is coded is
    dealt to shards by ranges of key and hash, so rows of one key are no hot group.
    """
    spark = df.sparkSession
    coded, small = _coded_ids(df, definition, pattern, end, key, text, added)
    ids = Table(coded, "ids")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_flat(batch.column(0), small))
            if len(found) > len(total):
                total, found = found, total
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counted = ids.df.select("ids").mapInArrow(tally, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    used, counts = counted.id.to_numpy(np.int64), counted.n.to_numpy(np.int64)
    bits = code_lengths(counts, max(LIMIT, int(len(used) - 1).bit_length()))
    spark.createDataFrame(list(zip(used.tolist(), bits.tolist())), "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(used, bits)
        for part in slices(batches, 2):
            n = part.column(1).to_numpy()
            data, sizes, marks = code.encode(_flat(part.column(2), small).astype(np.int64), n)
            per = np.maximum(n - 1, 0) // STEP
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binary_rows(marks.astype(np.int64), per), packed], names=["key", "n", "marks", "data"])

    kind = df.schema[key].dataType.simpleString()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first, rows, held = TaskContext.get().partitionId(), 0, 0, [], 0

        def one() -> pa.RecordBatch:
            keys = pa.concat_arrays([r.column(0) for r in rows])
            n = np.concatenate([r.column(1).to_numpy() for r in rows])
            marks = np.frombuffer(b"".join(x for r in rows for x in r.column(2).to_pylist()), np.int64)
            data = [x for r in rows for x in r.column(3).to_pylist()]
            wide = np.uint32 if not len(marks) or marks.max() < 1 << 32 else np.uint64
            cells = [[shard], [number], [first], pa.array([keys.to_pylist()], pa.list_(keys.type)), [n.tolist()], [[len(x) for x in data]], [marks.astype(wide).tobytes()], [b"".join(data)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), None, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(cells, kinds)], names=["shard", "block", "first", "keys", "n_ids", "sizes", "marks", "data"])

        for part in slices(batches, 3):
            rows.append(part)
            held += int(part.column(1).to_numpy().sum())
            if held >= BLOCK:
                yield one()
                number, first, rows, held = number + 1, first + held, [], 0
        if rows:
            yield one()

    totals = ids.df.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(-(-totals // SHARD), SHARDS))
    packed = Table(ids.df.mapInArrow(compress, f"key {kind}, n long, marks binary, data binary").withColumn("tie", F.xxhash64("n", "data")), "coded")
    ids.drop()
    order = ("key", "tie", "data")
    dealt = packed.df if parts == 1 else packed.df.repartitionByRange(parts, *order[:2])
    sorted_ = (dealt.coalesce(1) if parts == 1 else dealt).sortWithinPartitions(*order).select("key", "n", "marks", "data")
    blocks = sorted_.mapInArrow(block, f"shard int, block int, first long, keys array<{kind}>, n_ids array<long>, sizes array<long>, marks binary, data binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    packed.drop()
    sizes = spark.read.parquet(f"{path}/blocks").select("shard", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start long, n_tokens long, ids binary of little-endian unsigned 32-bit numbers) of the files at path."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    used, bits = book.id.to_numpy(np.int64), book.bits.to_numpy(np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(used, bits)
        for batch in batches:
            for k in range(batch.num_rows):
                start, keys, counts, sizes = (batch.column(i)[k] for i in range(4))
                counts, sizes = (x.values.to_numpy() for x in (counts, sizes))
                marks, n_marks = batch.column(4)[k].as_py(), int((np.maximum(counts - 1, 0) // STEP).sum())
                marks = np.frombuffer(marks, np.uint32 if len(marks) == 4 * n_marks else np.uint64).astype(np.int64)
                ids = code.decode(np.frombuffer(batch.column(5)[k].as_py(), np.uint8), counts, sizes, marks)
                starts = start.as_py() + np.cumsum(counts) - counts
                for a in range(0, len(counts), 2000):
                    b = min(a + 2000, len(counts))
                    i, j = int(counts[:a].sum()), int(counts[:b].sum())
                    yield pa.RecordBatch.from_arrays([keys.values[a:b], pa.array(starts[a:b]), pa.array(counts[a:b]), binary_rows(ids[i:j], counts[a:b])], names=["key", "start", "n_tokens", "ids"])

    rows = blocks.join(spark.read.parquet(f"{path}/shards"), "shard").select((F.col("base") + F.col("first")).alias("start"), "keys", "n_ids", "sizes", "marks", "data")
    return rows.mapInArrow(work, f"key {kind}, start long, n_tokens long, ids binary").withColumnRenamed("key", key)


def op5_token_files(spark, sf_dir: str, definition: str | None = None, pattern: str | None = None, end: int = 2) -> DataFrame:
    """Write all documents' ids, read the files back; definition: the path of a tokenizers file."""
    if definition is None:
        import public_tokenizers

        definition, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    with open(definition, encoding="utf-8") as file:
        text = file.read()
    path = f"{shared_folder(spark).rstrip('/')}/chunkloom-tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, text, pattern, end)
    going(spark, path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
