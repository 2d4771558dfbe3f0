"""Archives as a Spark source and sink.

A source of any length is cut, different chunks are compressed once, and what is left is one file: header and stored chunks. Reading
goes by descriptors: only the chunks that a plan needs are fetched, in runs that lie back to back, verified and expanded on executors.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chunkloom.config import ArchiveOptions
from chunkloom.errors import ArchiveError, HashMismatchError
from chunkloom.functions import codecs, hashes
from chunkloom.operators import chunking, clone, dictionary, reorder
from chunkloom.sources import header
from chunkloom.sources.ranges import ByteReader, resolve
from chunkloom.sources.shared import write_at

VERSION = "chunkloom 0.1"
#: Bytes of a split of a file, of a file that is cut as one value, and of a run of stored chunks that is read at once.
SPLIT, WHOLE, RUN = 8 << 20, 64 << 20, 8 << 20


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, content) of files, numbered by path."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.xxhash64("path").alias("file_id"), "path", "content")


def from_bytes(spark: SparkSession, data: bytes, file_id: int = 0) -> DataFrame:
    """(file_id, content) of bytes at the driver, such as its standard input."""
    return spark.createDataFrame([(file_id, bytearray(data))], "file_id long, content binary")


def file_splits(spark: SparkSession, source: str, size: int = SPLIT) -> DataFrame:
    """(file_id, split_offset, content) of a file of any length, read in splits on the executors, which must see its path."""
    reader, length = ByteReader(resolve(source)), _length(source)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                data = reader.read(k * size, min(size, length - k * size))
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([k * size], pa.int64()), pa.array([data], pa.binary())], names=["file_id", "split_offset", "content"])

    n = -(-length // size)
    return spark.range(0, n, 1, max(1, min(n, 10_000))).mapInArrow(work, "file_id long, split_offset long, content binary")


def cut_source(content: DataFrame, config: header.ChunkerConfig, with_data: bool = False) -> DataFrame:
    """(file_id, seq, offset, length, hash[, data]) of a source: one value (file_id, content) or splits of it (with split_offset)."""
    if "split_offset" in content.columns:
        return chunking.chunks_of_splits(content, config, with_data=with_data)
    return chunking.chunks(content, config, with_data=with_data)


def source_of(spark: SparkSession, data: bytes | str | DataFrame) -> DataFrame:
    """Bytes, the path of a file, or a table (content), or (split_offset, content), as a source."""
    if isinstance(data, bytes):
        return from_bytes(spark, data)
    if isinstance(data, str):
        if _length(data) > WHOLE:
            return file_splits(spark, data)
        with open(data, "rb") as file:
            return from_bytes(spark, file.read())
    content = data.withColumns({"file_id": F.lit(0).cast("long"), "content": F.col("content").cast("binary")})
    return content.select("file_id", *[c for c in ("split_offset", "content") if c in data.columns])


def _checksum(content: DataFrame) -> tuple[bytes, int]:
    """BLAKE2b and length of a source: splits pass one task in order, as no such hash can be put together from parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n = hashlib.blake2b(), 0
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    whole.update(x.as_buffer())
                    n += len(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([whole.digest()], pa.binary()), pa.array([n], pa.int64())], names=["hash", "n"])

    ordered = content.repartition(1).sortWithinPartitions("split_offset") if "split_offset" in content.columns else content.coalesce(1)
    found = ordered.select("content").mapInArrow(work, "hash binary, n long").collect()
    return (bytes(found[0].hash), found[0].n) if found else (hashlib.blake2b().digest(), 0)


def stored_chunks(content: DataFrame, options: ArchiveOptions) -> tuple[DataFrame, DataFrame]:
    """Chunks (archive_id, file_id, seq, offset, length, hash) of a source and the stored form of different ones (archive_id, idx, hash, source_size, archive_size, stored).

    Payload is cut out again for first occurrences only, instead of being carried through the grouping.
    """
    zero = F.lit(0).alias("archive_id")
    cut = cut_source(content, options.chunker).select(zero, "*")
    numbered = dictionary.dictionary(cut)
    first = dictionary.unique_chunks(cut).select("archive_id", "file_id", "seq", "hash")
    data = cut_source(content, options.chunker, with_data=True).select(zero, "*").drop("hash")
    payload = data.join(first, ["archive_id", "file_id", "seq"]).join(numbered.select("archive_id", "hash", "idx"), ["archive_id", "hash"])
    stored = codecs.smaller(F.col("data"), codecs.compressed(F.col("data"), options.compression))
    kept = payload.select("archive_id", "idx", "hash", F.col("length").alias("source_size"), stored.alias("stored"))
    return cut, kept.withColumn("archive_size", F.length("stored").cast("long"))


def create_archive(spark: SparkSession, content: bytes | str | DataFrame, path: str, options: ArchiveOptions = ArchiveOptions(), overwrite: bool = False) -> header.Dictionary:
    """Write the archive of one source (see source_of) to a file; returns its dictionary.

    The driver writes the header, which lists all chunks; the executors write stored chunks at their offsets, so they must see the path.
    Hashes shortened so far that they stand for different chunks are an error.
    """
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    path = os.path.abspath(path)
    files = source_of(spark, content)
    full = ArchiveOptions(header.ChunkerConfig.from_params(options.chunker.to_params() | {"hash_length": 64}, options.chunker.table), options.compression, options.metadata)
    cut, kept = stored_chunks(files, full)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        kept.write.parquet(f"file://{part}s")  # compressed once
        kept = spark.read.parquet(f"file://{part}s")
        length = options.chunker.hash_length
        if not dictionary.truncation_collisions(kept, length).isEmpty():
            raise ArchiveError(f"hashes of {length} bytes stand for different chunks")
        order = dictionary.rebuild_order(cut, kept).orderBy("pos").select("idx").toPandas().idx.tolist()
        placed = dictionary.archive_layout(kept)
        listed = placed.join(kept.select("idx", "source_size"), "idx").orderBy("idx").select("hash", "archive_size", "archive_offset", "source_size")
        descriptors = [{"hash": bytes(r.hash)[:length], "archive_size": r.archive_size, "archive_offset": r.archive_offset, "source_size": r.source_size} for r in listed.toLocalIterator()]
        checksum, size = _checksum(files)
        head = header.build(header.Dictionary(checksum, size, options.chunker, options.compression, order, descriptors, options.metadata, VERSION))
        with open(part, "wb") as out:
            out.write(head)
            out.truncate(len(head) + sum(c["archive_size"] for c in descriptors))
        write_at(kept.join(placed.select("idx", "archive_offset"), "idx").select((F.col("archive_offset") + len(head)).alias("offset"), F.col("stored").alias("data")), part)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
        shutil.rmtree(f"{part}s", ignore_errors=True)
    return open_archive(spark, path, table=options.chunker.table).dictionary


@dataclass
class Archive:
    """An open archive: its dictionary, and tables of what it holds."""

    spark: SparkSession
    reader: ByteReader
    dictionary: header.Dictionary

    @property
    def descriptors(self) -> DataFrame:
        """(archive_id, idx, hash, source_size, archive_size, archive_offset)"""
        d = self.dictionary.descriptors
        numbers = {c: pa.array([x[c] for x in d], pa.int64()) for c in ("source_size", "archive_size", "archive_offset")}
        columns = {"archive_id": pa.array([0] * len(d), pa.int32()), "idx": pa.array(range(len(d)), pa.int64()), "hash": pa.array([x["hash"] for x in d], pa.binary())}
        return self.spark.createDataFrame(pa.table(columns | numbers))

    @property
    def layout(self) -> DataFrame:
        """(archive_id, pos, idx, offset, length, hash): the source, chunk by chunk."""
        order = self.dictionary.rebuild_order
        columns = {"archive_id": pa.array([0] * len(order), pa.int32()), "pos": pa.array(range(len(order)), pa.int64()), "idx": pa.array(order, pa.int64())}
        return dictionary.source_layout(self.spark.createDataFrame(pa.table(columns)), self.descriptors)

    def fetch(self, needed: DataFrame | None = None) -> DataFrame:
        """(idx, hash, data) of the chunks whose hashes are needed (all if None), verified. A damaged chunk fails the query."""
        wanted = self.descriptors if needed is None else self.descriptors.join(needed.select(hashes.truncate(F.col("hash"), self.dictionary.chunker.hash_length).alias("hash")), "hash", "left_semi")
        # chunks are read in runs that lie back to back, none of more than RUN bytes or a chunk
        run = F.floor(F.col("archive_offset") / RUN).alias("run")
        items = wanted.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("archive_offset", "idx", "hash", "source_size", "archive_size"))).alias("items"))
        reader, codec = self.reader, self.dictionary.compression.codec

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for items in batch.column(0).to_pylist():
                    for run in back_to_back(items):
                        first = run[0]["archive_offset"]
                        data = memoryview(reader.read(first, run[-1]["archive_offset"] + run[-1]["archive_size"] - first))
                        for c in run:
                            at = c["archive_offset"] - first
                            out = unpacked(bytes(data[at : at + c["archive_size"]]), c, codec)
                            yield pa.RecordBatch.from_arrays([pa.array([c["idx"]]), pa.array([c["hash"]], pa.binary()), pa.array([out], pa.binary())], names=["idx", "hash", "data"])

        return items.select("items").mapInArrow(work, "idx long, hash binary, data binary")

    def info(self) -> DataFrame:
        """(name, value): what there is to tell, in order of `place`."""
        return self.spark.createDataFrame([(k, n, v) for k, (n, v) in enumerate(describe(self.dictionary))], "place int, name string, value string")


def back_to_back(items: list[dict]) -> Iterator[list[dict]]:
    """Chunks, by offset, in runs without a gap."""
    run: list[dict] = []
    for c in items:
        if run and run[-1]["archive_offset"] + run[-1]["archive_size"] != c["archive_offset"]:
            yield run
            run = []
        run.append(c)
    if run:
        yield run


def unpacked(data: bytes, c: dict, codec: str | None) -> bytes:
    """A stored chunk's data; equal sizes mean that it is stored as it is."""
    out = codecs.expand(data, None if c["archive_size"] == c["source_size"] else codec, c["source_size"])
    if hashlib.blake2b(out).digest()[: len(c["hash"])] != bytes(c["hash"]):
        raise HashMismatchError(f"chunk at {c['archive_offset']} has another hash")
    return out


def human(n: int) -> str:
    for unit, name in ((1 << 20, "MiB"), (1 << 10, "KiB")):
        if n > unit:
            return f"{n / unit:.1f} {name} ({n} bytes)"
    return f"{n} bytes"


def describe(d: header.Dictionary) -> list[tuple[str, str]]:
    c, sizes = d.chunker, [x["source_size"] for x in d.descriptors]
    out = [
        ("Built with version", d.application_version),
        ("Archive size", human(d.header_size + sum(x["archive_size"] for x in d.descriptors))),
        ("Metadata", ", ".join(f"{k}({len(v)})" for k, v in sorted(d.metadata.items())) or "None"),
        ("Header checksum", d.header_checksum.hex()),
        ("Chunk hash length", f"{c.hash_length} bytes"),
        ("Chunk compression", str(d.compression)),
        ("Chunking algorithm", {"buzhash": "BuzHash", "rollsum": "RollSum", "fixed": "Fixed Size"}[c.algorithm]),
    ]
    if c.algorithm == "fixed":
        out.append(("Fixed chunk size", human(c.max_size)))
    else:
        out += [("Rolling hash window size", human(c.window)), ("Chunk minimum size", human(c.min_size)), ("Chunk maximum size", human(c.max_size)), ("Chunk average target size", f"{human(c.target_average)} (mask: {c.mask:#b})")]
    average = human(sum(sizes) // len(sizes)) if sizes else "None"
    return out + [("Source checksum", d.source_checksum.hex()), ("Chunks in source", f"{len(d.rebuild_order)} (unique: {len(d.descriptors)})"), ("Average chunk size", average), ("Source size", human(d.source_total_size))]


def open_archive(spark: SparkSession, source: str, table: tuple[int, ...] | None = None, **http) -> Archive:
    """Read the header of a file or URL, and nothing else. table: of the buzhash that cut it, if not the default."""
    reader = ByteReader(resolve(source), **http)
    try:
        return Archive(spark, reader, header.parse(reader.read, table))
    except EOFError as e:
        raise ArchiveError(f"no archive: {e}") from e


def _seeded(spark: SparkSession, config: header.ChunkerConfig, seeds: list[tuple[str, bytes | str | DataFrame]]) -> DataFrame:
    """(provider, rank, hash, data): the chunks of all seeds."""
    have = spark.createDataFrame([], "provider string, rank int, hash binary, data binary")
    for rank, (name, data) in enumerate(seeds):
        cut = cut_source(source_of(spark, data), config, with_data=True)
        have = have.unionByName(cut.select(F.lit(name).alias("provider"), F.lit(rank).alias("rank"), "hash", "data"))
    return have


def _file_checksum(path: str, size: int) -> bytes:
    whole = hashlib.blake2b()
    with open(path, "rb") as file:
        while size and (block := file.read(min(size, 1 << 22))):
            whole.update(block)
            size -= len(block)
    return whole.digest()


def _is_device(path: str) -> bool:
    return os.path.exists(path) and stat.S_ISBLK(os.stat(path).st_mode)


def _length(path: str) -> int:
    """Bytes of a file or a block device."""
    with open(path, "rb") as file:
        return file.seek(0, os.SEEK_END)


def _moved(archive: Archive, path: str) -> tuple[DataFrame, list[dict]]:
    """Bring what a file holds of an archive's chunks where it belongs, in the file; returns the places that are still to be filled, and what was done."""
    spark, d = archive.spark, archive.dictionary
    target = archive.layout.select("archive_id", "hash", "length", "offset")
    current = cut_source(source_of(spark, path), d.chunker).select(F.lit(0).alias("archive_id"), "hash", "length", "offset")
    current = spark.createDataFrame(current.toPandas(), current.schema)  # an index as large as the archive's own; the file is about to change
    kept = clone.in_place(current, target).agg(F.sum("places").alias("places"), F.sum("bytes").alias("bytes")).first()
    steps = reorder.reorder(current, target, d.chunker.max_size).orderBy("step").collect()
    with open(path, "r+b") as file:

        def read(offset: int, size: int) -> bytes:
            file.seek(offset)
            return file.read(size)

        def write(offset: int, data: bytes) -> None:
            file.seek(offset)
            file.write(data)

        done = reorder.carry_out(((r.op, bytes(r.hash), r.size, r.source, r.dest) for r in steps), read, write)
    moves = {bytes(r.hash) for r in steps if r.op == reorder.COPY}
    left = clone.remaining(current, target).join(current.select("archive_id", "hash").distinct(), ["archive_id", "hash"], "left_anti")
    places = sum(len(r.dest) for r in steps)
    return left, [{"provider": "in place", "chunks": kept.places or 0, "places": kept.places or 0, "bytes_fed": kept.bytes or 0, "bytes_written": 0}, {"provider": "moved", "chunks": len(moves), "places": places, "bytes_fed": sum(r.size for r in steps if r.op == reorder.COPY), "bytes_written": done}]


def clone_archive(archive: Archive, seeds: list[tuple[str, bytes | str | DataFrame]], path: str, *, verify: bool = True, expected_header: bytes | None = None, in_place: bool = False) -> list[dict]:
    """Rebuild the source of an archive in a file; seeds (see source_of) in order of precedence.

    Chunks come from the first seed that has them, the rest from the archive; the executors, which must see the path, write them
    at their offsets, and the file is put in place when it is whole. in_place: the output is the first seed and is rearranged as it lies, in
    the memory that circles of moves need, so no second copy is written; a run that is stopped then leaves a mixture. A block device, which
    must be large enough, is written as it lies, too. Returns what each provider gave.
    """
    spark, d = archive.spark, archive.dictionary
    if expected_header is not None and expected_header != d.header_checksum:
        raise HashMismatchError("the header's checksum is not the expected one")
    path, used = os.path.abspath(path), []
    needed = archive.layout.select("archive_id", "hash", "length", "offset")
    device = _is_device(path)
    if device and _length(path) < d.source_total_size:
        raise ArchiveError(f"{path} has less than {d.source_total_size} bytes")
    if in_place or device:
        part = path
        if in_place:
            needed, used = _moved(archive, path)
    else:
        part = f"{path}.{uuid.uuid4().hex}.part"
        open(part, "wb").close()
    have = _seeded(spark, d.chunker, seeds)
    placed = clone.providers(needed.withColumn("archive_id", F.lit("")), have.select("provider", "rank", "hash"))
    missing = placed.where(F.col("provider") == clone.ARCHIVE).select("hash").distinct()
    local = have.groupBy("hash").agg(F.min_by("data", "rank").alias("data"))
    pieces = needed.join(local.unionByName(archive.fetch(missing).select("hash", "data")), "hash").select("offset", "data")
    try:
        if not device:
            os.truncate(part, d.source_total_size)
        written = write_at(pieces, part) + sum(u["bytes_written"] or u["bytes_fed"] for u in used)
        if written != d.source_total_size or (verify and _file_checksum(part, d.source_total_size)[: len(d.source_checksum)] != d.source_checksum):
            raise HashMismatchError("what was rebuilt is not the source")
        if part != path:
            os.replace(part, path)
    finally:
        if part != path and os.path.exists(part):
            os.remove(part)
    return used + [r.asDict() for r in clone.counters(placed).orderBy("provider").collect()]


@dataclass
class Run(InputPartition):
    """Chunks that lie back to back."""

    items: list[dict]


class ArchiveSource(DataSource):
    """spark.read.format("chunk_archive").load(path or URL): (idx, hash, source_size, archive_offset, data), a partition for each run of `run_bytes`.

    Options: run_bytes, retries, delay, timeout, and header.NAME for HTTP headers.
    """

    @classmethod
    def name(cls) -> str:
        return "chunk_archive"

    def schema(self) -> str:
        return "idx long, hash binary, source_size long, archive_offset long, data binary"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        headers = {k[7:]: v for k, v in o.items() if k.startswith("header.")}
        timeout = float(o["timeout"]) if "timeout" in o else None
        return ArchiveRuns(ByteReader(resolve(o["path"]), int(o.get("retries", 0)), float(o.get("delay", 0)), timeout, headers), int(o.get("run_bytes", 8 << 20)))


class ArchiveRuns(DataSourceReader):
    def __init__(self, reader: ByteReader, most: int):
        self.bytes, self.most = reader, most

    def partitions(self) -> list[Run]:
        d = header.parse(self.bytes.read)
        self.codec, runs, size = d.compression.codec, [], 0
        for k, c in enumerate(d.descriptors):
            last = runs[-1].items[-1] if runs else None
            if last is None or last["archive_offset"] + last["archive_size"] != c["archive_offset"] or size + c["archive_size"] > self.most:
                runs.append(Run([]))
                size = 0
            runs[-1].items.append(c | {"idx": k, "codec": self.codec})
            size += c["archive_size"]
        return runs or [Run([])]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not partition.items:
            return
        first = partition.items[0]["archive_offset"]
        data = self.bytes.read(first, sum(c["archive_size"] for c in partition.items))
        for c in partition.items:
            at = c["archive_offset"] - first
            yield c["idx"], c["hash"], c["source_size"], c["archive_offset"], unpacked(data[at : at + c["archive_size"]], c, c["codec"])
