"""What an archive knows of its source: different chunks, the order to rebuild from, and where things lie.

Chunk tables have (archive_id, file_id, seq, length, hash): an archive's source is the chunks of its files, one after another. Payload
never goes through these; they shuffle about a hundred bytes for each chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running

PLACE = ["file_id", "seq"]


def dictionary(chunks: DataFrame) -> DataFrame:
    """(archive_id, idx, hash, source_size, occurrences): different chunks, numbered by first occurrence."""
    first = F.min(F.struct(*PLACE)).alias("first")
    distinct = chunks.groupBy("archive_id", "hash").agg(first, F.first("length").alias("source_size"), F.count("*").alias("occurrences"))
    flat = distinct.select("archive_id", "hash", "source_size", "occurrences", *[F.col(f"first.{c}").alias(c) for c in PLACE])
    return running(flat, ["archive_id"], PLACE, {"idx": F.lit(1)}).select("archive_id", "idx", "hash", "source_size", "occurrences")


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """The first occurrence of each different chunk of an archive."""
    columns = [c for c in chunks.columns if c not in ("archive_id", "hash")]
    picked = F.min_by(F.struct(*columns), F.struct(*PLACE)).alias("x")
    return chunks.groupBy("archive_id", "hash").agg(picked).select("archive_id", "hash", *[F.col(f"x.{c}").alias(c) for c in columns]).select(*chunks.columns)


def rebuild_order(chunks: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(archive_id, pos, idx): the numbers of the chunks that make up the source, in order."""
    placed = running(chunks.select("archive_id", *PLACE, "hash"), ["archive_id"], PLACE, {"pos": F.lit(1)})
    return placed.join(descriptors.select("archive_id", "hash", "idx"), ["archive_id", "hash"]).select("archive_id", "pos", "idx")


def source_layout(order: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(archive_id, pos, idx, offset, length, hash): where each chunk of the source starts."""
    sized = order.join(descriptors.select("archive_id", "idx", "hash", F.col("source_size").alias("length")), ["archive_id", "idx"])
    return running(sized, ["archive_id"], ["pos"], {"offset": F.col("length")}).select("archive_id", "pos", "idx", "offset", "length", "hash")


def archive_layout(descriptors: DataFrame, size: str = "archive_size") -> DataFrame:
    """(archive_id, idx, hash, archive_offset, archive_size, archive_end): stored chunks lie back to back, by number."""
    placed = running(descriptors.select("archive_id", "idx", "hash", F.col(size).alias("archive_size")), ["archive_id"], ["idx"], {"archive_offset": F.col("archive_size")})
    return placed.select("archive_id", "idx", "hash", "archive_offset", "archive_size", (F.col("archive_offset") + F.col("archive_size")).alias("archive_end"))


def chunk_index(locations: DataFrame, owner: str = "archive_id") -> DataFrame:
    """(owner, hash, size, offsets): every different chunk with all places where it lies, ascending."""
    return locations.groupBy(owner, "hash").agg(F.first("length").alias("size"), F.sort_array(F.collect_set("offset")).alias("offsets"))


def truncation_collisions(hashes: DataFrame, length: int) -> DataFrame:
    """(prefix, hashes): prefixes of `length` bytes that stand for different hashes; an archive must not have any."""
    cut = hashes.select("hash", F.substring("hash", 1, length).alias("prefix")).distinct()
    return cut.groupBy("prefix").agg(F.count("*").alias("hashes")).where("hashes > 1")


def summary(chunks: DataFrame, by: str = "archive_id") -> DataFrame:
    """(by, chunks, unique_chunks, bytes, unique_bytes, average_size): what deduplication saves; the average is of different chunks, rounded down.

    Two partial sums: first of each different chunk, then of the groups; no distinct count over wide rows.
    """
    each = chunks.groupBy(by, "hash").agg(F.count("*").alias("n"), F.first("length").alias("length"))
    totals = each.groupBy(by).agg(
        F.sum("n").alias("chunks"),
        F.count("*").alias("unique_chunks"),
        F.sum(F.col("n") * F.col("length")).alias("bytes"),
        F.sum("length").alias("unique_bytes"),
    )
    return totals.withColumn("average_size", F.expr("unique_bytes div nullif(unique_chunks, 0)"))
