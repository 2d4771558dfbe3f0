"""Plans to rebuild a source from what is at hand: who supplies which chunk, what is in place, what must be fetched.

needed: (archive_id, hash, length, offset), the places of every chunk in the target. A chunk is the same whoever supplies
it, so the shrinking set of what is still missing becomes one minimum over the ranks of providers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.hashes import joined

from .order import running, stretches

ARCHIVE = "archive"


def providers(needed: DataFrame, seeds: DataFrame) -> DataFrame:
    """(archive_id, hash, length, offset, provider): who supplies each place; the archive itself where no seed does.

    seeds: (provider, rank, hash), rank ascending by precedence. A seed with the archive's own name doesn't count for it. The two best of
    each hash suffice for that, so the join is on the hash alone, with one row for each.
    """
    ranked = seeds.groupBy("hash", "provider").agg(F.min("rank").alias("rank"))
    by = Window.partitionBy("hash").orderBy("rank", "provider")  # no more than two of a hash leave a task, before and after the exchange
    best = ranked.withColumn("place", F.row_number().over(by)).where("place <= 2")
    two = best.groupBy("hash").agg(*[F.max(F.when(F.col("place") == k, F.col("provider"))).alias(f"p{k}") for k in (1, 2)])
    own = F.when(F.col("p1") != F.col("archive_id"), F.col("p1")).otherwise(F.col("p2"))
    return needed.join(two, "hash", "left").select("archive_id", "hash", "length", "offset", F.coalesce(own, F.lit(ARCHIVE)).alias("provider"))


def counters(placed: DataFrame) -> DataFrame:
    """(archive_id, provider, chunks, places, bytes_fed, bytes_written): a chunk is fed once and written at each of its places."""
    each = placed.groupBy("archive_id", "provider", "hash").agg(F.count("*").alias("places"), F.first("length").alias("length"))
    return each.groupBy("archive_id", "provider").agg(F.count("*").alias("chunks"), F.sum("places").alias("places"), F.sum("length").alias("bytes_fed"), F.sum(F.col("length") * F.col("places")).alias("bytes_written"))


def seed_matches(needed: DataFrame, seeds: DataFrame) -> DataFrame:
    """The needed places that some seed can fill (its own archive aside)."""
    return providers(needed, seeds).where(F.col("provider") != ARCHIVE)


def missing(needed: DataFrame, seeds: DataFrame) -> DataFrame:
    """(archive_id, hash, length): different chunks that no seed has."""
    return providers(needed, seeds).where(F.col("provider") == ARCHIVE).select("archive_id", "hash", "length").distinct()


def in_place(current: DataFrame, target: DataFrame) -> DataFrame:
    """(archive_id, places, bytes): target places that hold their chunk already."""
    same = target.join(current.select("archive_id", "hash", "offset").distinct(), ["archive_id", "hash", "offset"], "left_semi")
    return same.groupBy("archive_id").agg(F.count("*").alias("places"), F.sum("length").alias("bytes"))


def remaining(current: DataFrame, target: DataFrame) -> DataFrame:
    """Target places that are still to be filled."""
    return target.join(current.select("archive_id", "hash", "offset").distinct(), ["archive_id", "hash", "offset"], "left_anti")


def overlaps(current: DataFrame, target: DataFrame, widest: int) -> DataFrame:
    """(archive_id, target_offset, target_hash, offset, length, hash): what a write to a target place would destroy.

    That is every current chunk of another hash that the place touches. Places are dealt into bins of `widest` bytes (no chunk
    is longer), so that the interval join is an equality with a filter.
    """
    bins = lambda o, n: F.explode(F.sequence(F.floor(o / widest), F.floor((o + F.greatest(n, F.lit(1)) - 1) / widest))).alias("bin")
    t = target.select("archive_id", F.col("offset").alias("target_offset"), F.col("length").alias("n"), F.col("hash").alias("target_hash"), bins(F.col("offset"), F.col("length")))
    c = current.select("archive_id", "offset", "length", "hash", bins(F.col("offset"), F.col("length")))
    touch = (F.col("offset") < F.col("target_offset") + F.col("n")) & (F.col("target_offset") < F.col("offset") + F.col("length"))
    start = F.floor(F.greatest("offset", "target_offset") / widest)  # a pair is met in each bin that both touch, and kept in the first
    found = t.join(c, ["archive_id", "bin"]).where(touch & (F.col("bin") == start) & (F.col("hash") != F.col("target_hash")))
    return found.select("archive_id", "target_offset", "target_hash", "offset", "length", "hash")


def coalesced(ranges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(archive_id, first_idx, ranges, offset, size): runs of ranges (archive_id, idx, offset, size) that lie back to back, as one request each."""
    group = group or ["archive_id"]
    parts = stretches(ranges)
    if parts == 1:
        before = F.lag(F.col("offset") + F.col("size")).over(Window.partitionBy(*group).orderBy("idx"))
        marked = ranges.select(*group, "idx", "offset", "size", before.alias("end"))
    else:  # as many tasks as the table asks for: the range before is found by its number
        placed = running(ranges.select(*group, "idx", "offset", "size"), group, ["idx"], {"pos": F.lit(1)}, parts)
        last = placed.select(*group, (F.col("pos") + 1).alias("pos"), (F.col("offset") + F.col("size")).alias("end"))
        marked = placed.join(last, [*group, "pos"], "left").drop("pos")
    new = F.coalesce((F.col("end") != F.col("offset")).cast("int"), F.lit(1))
    counted = running(marked.select(*group, "idx", "offset", "size", new.alias("new")), group, ["idx"], {"before": F.col("new")}, parts)
    runs = counted.select(*group, "idx", "offset", "size", (F.col("before") + F.col("new")).alias("island"))
    return runs.groupBy(*group, "island").agg(F.min("idx").alias("first_idx"), F.count("*").alias("ranges"), F.min("offset").alias("offset"), F.sum("size").alias("size")).drop("island")


def reassembled(pieces: DataFrame, group: list[str]) -> DataFrame:
    """(group, size, content, whole): values put together from (offset, data); whole tells whether the pieces tile them.

    A value must fit in memory, as must any binary value; larger files are written piece by piece (see sources.archive).
    """
    one = pieces.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("offset", "data"))).alias("parts"))
    tiles = F.aggregate("parts", F.lit(0).cast("long"), lambda at, x: F.when(at == x["offset"], at + F.length(x["data"])).otherwise(F.lit(-1).cast("long")))
    content = joined(F.transform("parts", lambda x: x["data"]))
    return one.select(*group, tiles.alias("size"), content.alias("content"), (tiles >= 0).alias("whole"))
