"""Registered queries, one for each operator at least, and their DuckDB equivalents.

Files are documents (their text as UTF-8 bytes); an archive is made of the documents of one source, in order of doc_id. All
queries read whole tables. SHA-256 stands in for BLAKE2b where there is an equivalent, as SQL engines have it.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.config import ArchiveOptions, ChunkerConfig, Compression
from chunkloom.errors import CompressionError
from chunkloom.functions import codecs, hashes, sizes
from chunkloom.operators import chunking, clone, dictionary, diff, reorder
from chunkloom.sources import archive, header
from chunkloom.sources.ranges import ByteReader, resolve
from chunkloom.sources.shared import local_path, shared_folder, write_at

#: Fixed chunk size, and small rolling chunks, for texts of a few kilobytes.
SIZE = 256
ROLL = ChunkerConfig("rollsum", 8, 64, 2048, 32, 32)
BUZ = ChunkerConfig("buzhash", 8, 64, 2048, 32, 32)
NAME = "coalesce(source, '')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.expr(NAME).alias("archive_id"), F.col("doc_id").alias("file_id"), F.col("text").alias("content"))


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archive_id, file_id, seq, offset, length, hash) of fixed-size chunks."""
    both = _files(spark, sf_dir).select(F.struct("archive_id", "file_id").alias("key"), "content")
    return chunking.fixed_chunks(both, SIZE, key="key").select("key.*", "seq", "offset", "length", "hash")


def _rolled(spark: SparkSession, sf_dir: str, config: ChunkerConfig = ROLL, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return chunking.chunks(_table(spark, sf_dir, name), config, key=key, content=text, hash_algorithm="sha256")


def _hex(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: hashes.to_hex(F.col(c)) for c in columns or ("hash",)})


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cut = _fixed(spark, sf_dir)
    numbered = dictionary.dictionary(cut)
    return cut, numbered, dictionary.source_layout(dictionary.rebuild_order(cut, numbered), numbered)


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two layouts of each source: documents by doc_id, and by the length of their text."""
    cut = _fixed(spark, sf_dir)
    n = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.octet_length("text").cast("long").alias("n"))
    by_size = cut.join(n, "file_id")
    place = lambda df, order: dictionary.running(df, ["archive_id"], order, {"at": F.col("length")}).select("archive_id", "hash", "length", F.col("at").alias("offset"))
    return place(cut.drop("offset"), ["file_id", "seq"]), place(by_size.drop("offset"), ["n", "file_id", "seq"])


def _seeds(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every source seeds all others, by name."""
    names = cut.select("archive_id").distinct()
    ranked = names.select(F.col("archive_id").alias("provider"), (F.row_number().over(Window.orderBy("archive_id")) - 1).alias("rank"))
    return ranked, cut.select(F.col("archive_id").alias("provider"), "hash").distinct().join(ranked, "provider")


def fixed_chunks(spark, sf_dir):
    return _hex(chunking.fixed_chunks(_table(spark, sf_dir, "documents"), SIZE, key="doc_id", content="text"))


def rollsum_candidates(spark, sf_dir):
    return chunking.candidates(_table(spark, sf_dir, "documents"), ROLL, key="doc_id", content="text")


def rollsum_chunks(spark, sf_dir):
    return _hex(_rolled(spark, sf_dir))


def buzhash_chunks(spark, sf_dir):
    return _hex(_rolled(spark, sf_dir, BUZ))


def split_chunks(spark, sf_dir):
    """Documents as splits of 700 bytes, cut as if whole."""
    data = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    starts = F.when(F.length("b") > 0, F.sequence(F.lit(0).cast("long"), F.length("b").cast("long") - 1, F.lit(700).cast("long")))
    splits = data.select("doc_id", "b", F.explode(starts).alias("split_offset")).select("doc_id", "split_offset", F.substr("b", F.col("split_offset").cast("int") + 1, F.lit(700)).alias("content"))
    return _hex(chunking.chunks_of_splits(splits, ROLL, key="doc_id", hash_algorithm="sha256"))


def page_chunks(spark, sf_dir):
    return _hex(_rolled(spark, sf_dir, ROLL, "pages", "page_id", "html"))


def chunk_size_stats(spark, sf_dir):
    cut = _rolled(spark, sf_dir)
    return cut.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.min("length").alias("smallest"), F.max("length").alias("largest"), F.expr("sum(length) div count(*)").alias("average"))


def dedup_summary(spark, sf_dir):
    """What rolling chunks would save in each source."""
    both = _files(spark, sf_dir).select(F.struct("archive_id", "file_id").alias("key"), "content")
    cut = chunking.chunks(both, ROLL, key="key", hash_algorithm="sha256").select("key.archive_id", "length", "hash")
    return dictionary.summary(cut)


def dedup_dictionary(spark, sf_dir):
    return _hex(dictionary.dictionary(_fixed(spark, sf_dir)))


def unique_chunks(spark, sf_dir):
    return _hex(dictionary.unique_chunks(_fixed(spark, sf_dir)))


def rebuild_order(spark, sf_dir):
    cut = _fixed(spark, sf_dir)
    return dictionary.rebuild_order(cut, dictionary.dictionary(cut))


def source_layout(spark, sf_dir):
    return _hex(_layout(spark, sf_dir)[2])


def archive_layout(spark, sf_dir):
    numbered = dictionary.dictionary(_fixed(spark, sf_dir))
    return _hex(dictionary.archive_layout(numbered, "source_size"))


def chunk_index(spark, sf_dir):
    found = dictionary.chunk_index(_layout(spark, sf_dir)[2])
    return _hex(found).withColumn("offsets", F.array_join("offsets", ","))


def truncated_identity(spark, sf_dir):
    short = _fixed(spark, sf_dir).select(hashes.truncate(F.col("hash"), 4).alias("hash"), "length")
    return _hex(short.groupBy("hash").agg(F.count("*").alias("chunks"), F.max("length").alias("largest")))


def truncation_collisions(spark, sf_dir):
    return _hex(dictionary.truncation_collisions(_fixed(spark, sf_dir), 2), "prefix")


def prefix_equality(spark, sf_dir):
    """Hashes against a prefix of the hash of the same text without its last character."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    a, b = F.unhex(F.sha2("t", 256)), F.unhex(F.sha2(F.rtrim("t"), 256))
    return d.select("doc_id", hashes.same_prefix(a, hashes.truncate(b, 4)).alias("same"), hashes.same_prefix(a, F.lit(b"")).alias("empty"))


def reassemble_verify(spark, sf_dir):
    """Documents put together from their rolling chunks: the hash is that of the text."""
    cut = chunking.chunks(_table(spark, sf_dir, "documents"), ROLL, key="doc_id", content="text", hash_algorithm="sha256", with_data=True)
    whole = clone.reassembled(cut, ["doc_id"])
    return whole.select("doc_id", "size", "whole", F.sha2("content", 256).alias("hash"))


def provider_precedence(spark, sf_dir):
    cut, _, layout = _layout(spark, sf_dir)
    placed = clone.providers(layout.select("archive_id", "hash", "length", "offset"), _seeds(cut)[1])
    return _hex(placed)


def seed_matches(spark, sf_dir):
    cut, _, layout = _layout(spark, sf_dir)
    found = clone.seed_matches(layout.select("archive_id", "hash", "length", "offset"), _seeds(cut)[1])
    return found.groupBy("archive_id").agg(F.count("*").alias("places"), F.sum("length").alias("bytes"))


def missing_chunks(spark, sf_dir):
    cut, _, layout = _layout(spark, sf_dir)
    return _hex(clone.missing(layout.select("archive_id", "hash", "length", "offset"), _seeds(cut)[1]))


def clone_counters(spark, sf_dir):
    cut, _, layout = _layout(spark, sf_dir)
    return clone.counters(clone.providers(layout.select("archive_id", "hash", "length", "offset"), _seeds(cut)[1]))


def in_place(spark, sf_dir):
    return clone.in_place(*_versions(spark, sf_dir))


def remaining_offsets(spark, sf_dir):
    return _hex(clone.remaining(*_versions(spark, sf_dir)).distinct())


def overlap_pairs(spark, sf_dir):
    current, target = _versions(spark, sf_dir)
    return _hex(clone.overlaps(current, target, SIZE), "hash", "target_hash")


def reorder_ops(spark, sf_dir):
    """Each source's documents, end to end, rearranged in place from the order of doc_id to that of their lengths, by the planned moves."""
    current, target = _versions(spark, sf_dir)
    steps = reorder.reorder(current, target, SIZE)
    plan = steps.groupBy("archive_id").agg(F.sort_array(F.collect_list(F.struct("step", "op", "hash", "size", "source", "dest"))).alias("steps"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("file_id", F.col("content").cast("binary").alias("x")))), lambda r: r["x"])
    whole = _files(spark, sf_dir).where("length(content) > 0").groupBy("archive_id").agg(texts.alias("parts")).select("archive_id", hashes.joined("parts").alias("content"))

    @F.arrow_udf("binary")
    def moved(content: pa.Array, plans: pa.Array) -> pa.Array:
        out = []
        for c, p in zip(content.to_pylist(), plans.to_pylist()):
            data = bytearray(c)
            read = lambda a, n: bytes(data[a : a + n])  # noqa: E731, B023
            write = lambda a, x: data.__setitem__(slice(a, a + len(x)), x)  # noqa: E731, B023
            reorder.carry_out(((r["op"], r["hash"], r["size"], r["source"], r["dest"]) for r in p or []), read, write)
            out.append(bytes(data))
        return pa.array(out, pa.binary())

    found = whole.join(plan, "archive_id", "left").select("archive_id", F.length("content").cast("long").alias("size"), moved("content", "steps").alias("content"))
    return found.select("archive_id", "size", F.sha2("content", 256).alias("hash"))


def range_requests(spark, sf_dir):
    """The parts of each source's archive that no other source has, in as few requests as possible."""
    cut, numbered, layout = _layout(spark, sf_dir)
    gone = clone.missing(layout.select("archive_id", "hash", "length", "offset"), _seeds(cut)[1]).select("archive_id", "hash")
    stored = dictionary.archive_layout(numbered, "source_size").join(gone, ["archive_id", "hash"], "left_semi")
    return clone.coalesced(stored.select("archive_id", "idx", F.col("archive_offset").alias("offset"), F.col("archive_size").alias("size")))


def _sides(spark, sf_dir):
    """English documents, and those in other languages."""
    cut = chunking.fixed_chunks(_table(spark, sf_dir, "documents"), SIZE, key="doc_id", content="text")
    lang = _table(spark, sf_dir, "documents").select("doc_id", (F.coalesce("lang", F.lit("")) == "en").alias("en"))
    both = cut.join(lang, "doc_id")
    return both.where("en"), both.where("not en")


def diff_classes(spark, sf_dir):
    return _hex(diff.classes(*_sides(spark, sf_dir)))


def diff_summary(spark, sf_dir):
    return diff.report(diff.classes(*_sides(spark, sf_dir)))


def set_operations(spark, sf_dir):
    a, b = (x.select("hash") for x in _sides(spark, sf_dir))
    sets = {"union": diff.union(a, b), "intersection": diff.intersection(a, b), "a_minus_b": diff.difference(a, b), "b_minus_a": diff.difference(b, a)}
    parts = [df.agg(F.count("*").alias("chunks")).select(F.lit(name).alias("operation"), "chunks") for name, df in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def info_report(spark, sf_dir):
    totals = dictionary.summary(_fixed(spark, sf_dir))
    return totals.select("archive_id", "chunks", "unique_chunks", "bytes", "unique_bytes", "average_size", sizes.human_size(F.col("bytes")).alias("size_text"))


def human_size(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    return d.select("doc_id", sizes.human_size(F.col("n")).alias("small"), sizes.human_size(F.col("n") * 1000).alias("large"))


def parse_size(spark, sf_dir):
    unit = F.get(F.array(*map(F.lit, ("", "B", "KiB", "MiB", "GiB", "kB"))), F.pmod("doc_id", F.lit(6)).cast("int"))
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.length("text").cast("string"), unit).alias("size_text"))
    return d.select("doc_id", "size_text", sizes.parse_size(F.col("size_text"), strict=False).alias("bytes"))


def hex_roundtrip(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    odd = F.expr("substring(h, 2)")
    return d.select("doc_id", hashes.to_hex(hashes.from_hex(F.col("h"))).alias("even"), hashes.to_hex(hashes.from_hex(odd)).alias("odd"))


def metadata_lookup(spark, sf_dir):
    """Metadata of each source, by key: its languages, with the documents of each as value."""
    d = _table(spark, sf_dir, "documents").select(F.expr(NAME).alias("archive_id"), F.coalesce("lang", F.lit("")).alias("key"))
    n = d.groupBy("archive_id", "key").agg(F.count("*").alias("n"))
    stored = n.groupBy("archive_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("n").cast("string").cast("binary").alias("v")))).alias("metadata"))
    listing = F.array_join(F.transform(F.array_sort(F.map_keys("metadata")), lambda k: F.concat(k, F.lit("("), F.length(F.element_at("metadata", k)), F.lit(")"))), ", ")
    return stored.select("archive_id", F.try_element_at("metadata", F.lit("en")).cast("string").alias("english"), listing.alias("listing"))


def codec_marker(spark, sf_dir):
    """Chunks compressed one by one, stored as they are where that isn't smaller, told apart by their sizes, and expanded again.

    What a codec makes of a chunk is its own affair; that the marker and the sizes agree, and what comes back, is the same for all.
    """
    how = Compression("zstd", 3)
    cut = chunking.chunks(_table(spark, sf_dir, "documents"), ROLL, key="doc_id", content="text", hash_algorithm="sha256", with_data=True)
    stored = codecs.smaller(F.col("data"), codecs.compressed(F.col("data"), how))
    kept = cut.select("doc_id", "seq", "length", stored.alias("stored")).withColumn("archive_size", F.length("stored").cast("long"))
    kept = kept.withColumn("codec", codecs.codec_of(F.col("archive_size"), F.col("length"), how.codec))
    back = codecs.expanded(F.col("stored"), F.col("codec"), F.col("length"))
    marked = F.col("codec").isNull() == (F.col("archive_size") == F.col("length"))
    return kept.select("doc_id", "seq", "length", (F.col("archive_size") <= F.col("length")).alias("not_larger"), marked.alias("marked"), F.sha2(back, 256).alias("hash"))


def compress_roundtrip(spark, sf_dir):
    """Every document compressed, stored if smaller, and expanded again, with each codec."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    parts = []
    for how in (Compression(None), Compression("brotli", 4), Compression("zstd", 3), Compression("lzma", 1)):
        stored = codecs.smaller(F.col("data"), codecs.compressed(F.col("data"), how))
        kept = d.select("doc_id", F.length("data").cast("long").alias("n"), stored.alias("stored"))
        kept = kept.withColumn("codec", codecs.codec_of(F.length("stored").cast("long"), F.col("n"), how.codec))
        back = codecs.expanded(F.col("stored"), F.col("codec"), F.col("n"))
        parts.append(kept.select("doc_id", F.lit(how.codec or "none").alias("codec"), F.sha2(back, 256).alias("hash")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def blake2_identity(spark, sf_dir):
    """Chunks by BLAKE2b: lengths, bytes of the hash, and the first chunk that has the same one."""
    cut = chunking.chunks(_table(spark, sf_dir, "documents"), ROLL, key="doc_id", content="text")
    same = cut.groupBy("hash").agg(F.min(F.struct("doc_id", "seq")).alias("first"))
    both = cut.join(same, "hash")
    return both.select("doc_id", "seq", "offset", "length", F.length("hash").cast("long").alias("hash_bytes"), F.col("first.doc_id").alias("first_doc"), F.col("first.seq").alias("first_seq"))


def archive_roundtrip(spark, sf_dir):
    """Files of all documents, archived, opened, fetched and cloned: what comes back by each way is what went in.

    files: the source, written by offset; fetched: all chunks of the archive, by its layout; cloned: with a seed; in_place: over the documents in another
    order; source: what the archive's header says that it holds, and whether its checksum is that of the file.
    """
    folder = local_path(shared_folder(spark, "archives"))
    d = _files(spark, sf_dir).where("length(content) > 0").select(F.lit(0).alias("archive_id"), "file_id", F.col("content").cast("binary").alias("data")).withColumn("n", F.length("data").cast("long"))
    size = d.agg(F.sum("n")).first()[0]
    by_id, by_size = (dictionary.running(d, ["archive_id"], order, {"offset": F.col("n")}) for order in (["file_id"], ["n", "file_id"]))
    for name, pieces in (("source", by_id), ("other", by_size)):
        with open(f"{folder}/{name}", "wb") as file:
            file.truncate(size)
        write_at(pieces, f"{folder}/{name}")
    options = ArchiveOptions(ROLL, Compression("zstd", 3)).with_metadata({"made of": "documents"})
    archive.create_archive(spark, archive.file_splits(spark, f"{folder}/source", 1 << 20), f"{folder}/a", options)
    opened = archive.open_archive(spark, f"{folder}/a")
    with open(f"{folder}/source", "rb") as file:
        archive.clone_archive(opened, [("seed", file.read(1 << 16))], f"{folder}/cloned")
    archive.clone_archive(opened, [], f"{folder}/other", in_place=True)
    rows = []
    for way, name in (("files", "source"), ("cloned", "cloned"), ("in_place", "other")):
        with open(f"{folder}/{name}", "rb") as file:
            rows.append((way, os.path.getsize(f"{folder}/{name}"), hashlib.file_digest(file, "sha256").hexdigest()))
    with open(f"{folder}/source", "rb") as file:
        checked = hashlib.file_digest(file, "blake2b").digest() == opened.dictionary.source_checksum
    rows.append(("source", opened.dictionary.source_total_size, rows[0][2] if checked and opened.dictionary.metadata_value("made of") == b"documents" else None))
    pieces = opened.layout.select("archive_id", "hash", "offset").join(opened.fetch().select("hash", "data"), "hash")
    fetched = clone.reassembled(pieces, ["archive_id"]).select(F.lit("fetched").alias("way"), "size", F.sha2("content", 256).alias("hash"))
    return spark.createDataFrame(rows, "way string, size long, hash string").unionByName(fetched)


def header_roundtrip(spark, sf_dir):
    """The archive header of each source, built and parsed again: what it then says of every chunk, and of the archive."""
    cut, numbered, _ = _layout(spark, sf_dir)
    placed = dictionary.archive_layout(numbered, "source_size").join(numbered.select("archive_id", "idx", "source_size"), ["archive_id", "idx"])
    order = dictionary.rebuild_order(cut, numbered).groupBy("archive_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"]).alias("order"))
    rows = placed.groupBy("archive_id").agg(F.sort_array(F.collect_list(F.struct("idx", "hash", "archive_size", "archive_offset", "source_size"))).alias("chunks")).join(order, "archive_id")

    @F.arrow_udf("struct<header_size:long,payload_offset:long,source_size:long,checked:boolean,chunks:array<struct<idx:long,hash:binary,archive_offset:long,archive_size:long,source_size:long,places:long>>>")
    def parsed(name: pa.Array, chunks: pa.Array, order: pa.Array) -> pa.Array:
        out = []
        for archive_id, cs, places in zip(name.to_pylist(), chunks.to_pylist(), order.to_pylist()):
            d = header.Dictionary(b"x", sum(cs[i]["source_size"] for i in places), ChunkerConfig.fixed(SIZE), Compression(None), places, cs, {"name": archive_id.encode()}, "1")
            data = header.build(d)
            back = header.parse(lambda offset, size: data[offset : offset + size])  # noqa: B023
            n = Counter(back.rebuild_order)
            found = [{"idx": k, "hash": c["hash"], "archive_offset": c["archive_offset"] - back.payload_offset, "archive_size": c["archive_size"], "source_size": c["source_size"], "places": n[k]} for k, c in enumerate(back.descriptors)]
            same = (back.chunker, back.compression, back.metadata_value("name").decode(), back.rebuild_order, data[-64:]) == (d.chunker, d.compression, archive_id, places, back.header_checksum)
            out.append({"header_size": back.header_size - len(data), "payload_offset": back.payload_offset - len(data), "source_size": back.source_total_size, "checked": same, "chunks": found})
        kind = pa.struct([("idx", pa.int64()), ("hash", pa.binary()), ("archive_offset", pa.int64()), ("archive_size", pa.int64()), ("source_size", pa.int64()), ("places", pa.int64())])
        return pa.array(out, pa.struct([("header_size", pa.int64()), ("payload_offset", pa.int64()), ("source_size", pa.int64()), ("checked", pa.bool_()), ("chunks", pa.list_(kind))]))

    found = rows.select("archive_id", parsed("archive_id", "chunks", "order").alias("x"))
    named = found.select("archive_id", F.col("x.header_size").alias("header_excess"), F.col("x.payload_offset").alias("payload_excess"), F.col("x.source_size").alias("total"), "x.checked", F.explode("x.chunks").alias("c"))
    return _hex(named.select("archive_id", "header_excess", "payload_excess", "total", "checked", "c.*"))


def range_reads(spark, sf_dir):
    """Every document read back as a byte range of one file that holds all of them."""
    folder = local_path(shared_folder(spark, "ranges"))
    d = _files(spark, sf_dir).where("length(content) > 0").select(F.lit(0).alias("g"), F.col("file_id").alias("doc_id"), F.col("content").cast("binary").alias("data")).withColumn("n", F.length("data").cast("long"))
    placed = dictionary.running(d, ["g"], ["doc_id"], {"offset": F.col("n")})
    open(f"{folder}/all", "wb").close()
    write_at(placed, f"{folder}/all")
    reader = ByteReader(resolve(f"{folder}/all"))

    @F.arrow_udf("binary")
    def read(offset: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array([reader.read(a, n) for a, n in zip(offset.to_pylist(), size.to_pylist())], pa.binary())

    return placed.select("doc_id", "offset", F.col("n").alias("size"), read("offset", "n").alias("data")).select("doc_id", "offset", "size", F.sha2("data", 256).alias("hash"))


def chunker_params(spark, sf_dir):
    """Parameters of chunkers by sizes, as archives have them and back; sizes that don't fit are refused."""
    rows = []
    for k, average in enumerate((4, 255, 256, 1000, 64 << 10, 1 << 20)):
        for algorithm in ("rollsum", "buzhash", "fixed"):
            c = ChunkerConfig.fixed(average) if algorithm == "fixed" else ChunkerConfig.rolling(algorithm, average, average // 4, average * 256, hash_length=4 + k)
            p = c.to_params()
            same = ChunkerConfig.from_params(p) == c
            rows.append((average, algorithm, p["filter_bits"], p["min_size"], p["max_size"], p["window_size"], p["hash_length"], None if algorithm == "fixed" else c.target_average, same))
    return spark.createDataFrame(rows, "average long, algorithm string, filter_bits long, min_size long, max_size long, window_size long, hash_length long, target_average long, same boolean")


def codec_levels(spark, sf_dir):
    """Which levels each codec accepts."""

    def accepted(codec: str, level: int) -> bool:
        try:
            return Compression(codec, level).level == level
        except CompressionError:
            return False

    return spark.createDataFrame([(c, n, accepted(c, n)) for c in ("brotli", "lzma", "zstd", "gzip") for n in range(-1, 25)], "codec string, level long, accepted boolean")


def streaming_dedup(spark, sf_dir):
    """Documents as a stream, deduplicated chunk by chunk as they arrive."""
    from chunkloom.streaming.arriving import deduplicate

    schema = _table(spark, sf_dir, "documents").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").select("doc_id", "text")
    path = shared_folder(spark, "stream")
    writer = deduplicate(arriving, ROLL, f"{path}/chunks", f"{path}/state", key="doc_id", content="text", hash_algorithm="sha256")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/chunks").select(hashes.to_hex(F.col("hash")).alias("hash"), "length")


def streaming_segments(spark, sf_dir):
    """Conversations as streams of turns, each cut as one text."""
    from chunkloom.streaming.arriving import chunk_segments

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    by = Window.partitionBy("conv_id").orderBy("turn")
    numbered = turns.select("conv_id", (F.row_number().over(by) - 1).alias("segment"), F.col("text").alias("content"), F.lead("turn").over(by).isNull().alias("last"))
    path = shared_folder(spark, "segments")
    numbered.write.parquet(f"{path}/in")
    arriving = spark.readStream.schema(numbered.schema).parquet(f"{path}/in")
    query = chunk_segments(arriving, ChunkerConfig.fixed(SIZE, 32), key="conv_id", hash_algorithm="sha256").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _hex(spark.read.parquet(f"{path}/out"))


QUERIES = {
    f.__name__: f
    for f in (
        fixed_chunks, rollsum_candidates, rollsum_chunks, buzhash_chunks, split_chunks, page_chunks, chunk_size_stats, dedup_summary, dedup_dictionary,
        unique_chunks, rebuild_order, source_layout, archive_layout, chunk_index, truncated_identity, truncation_collisions, prefix_equality,
        reassemble_verify, provider_precedence, seed_matches, missing_chunks, clone_counters, in_place, remaining_offsets, overlap_pairs,
        reorder_ops, range_requests, diff_classes, diff_summary, set_operations, info_report, human_size, parse_size, hex_roundtrip,
        metadata_lookup, codec_marker, compress_roundtrip, blake2_identity, archive_roundtrip, header_roundtrip, range_reads, chunker_params, codec_levels, streaming_dedup, streaming_segments,
    )
}

from chunkloom.plans.oracles import ORACLES  # noqa: E402, F401
