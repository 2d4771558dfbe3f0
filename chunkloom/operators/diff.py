"""What two sides share: sets of chunks, and sums over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classes(a: DataFrame, b: DataFrame, compressed: bool = False) -> DataFrame:
    """(hash, size[, packed], occurrences_a, occurrences_b, class): every different chunk of either side: a, b or both.

    One grouped pass over both sides; a chunk's occurrences in all are the sum of both.
    """
    extra = ["packed"] if compressed else []
    sides = [d.select("hash", "length", *extra, F.lit(k).alias("side")) for k, d in enumerate((a, b))]
    count = lambda k: F.count(F.when(F.col("side") == k, 1))
    found = sides[0].unionByName(sides[1]).groupBy("hash").agg(F.first("length").alias("size"), *[F.first(c).alias(c) for c in extra], count(0).alias("occurrences_a"), count(1).alias("occurrences_b"))
    kind = F.when(F.col("occurrences_b") == 0, "a").when(F.col("occurrences_a") == 0, "b").otherwise("both")
    return found.withColumn("class", kind)


def report(classes: DataFrame, packed: str | None = None) -> DataFrame:
    """(class, chunks, occurrences, bytes, stored_bytes): sums for chunks only in a, only in b, in both, and in either.

    bytes counts every occurrence; stored_bytes does so with the compressed size (the plain size where there is none).
    """
    times = F.col("occurrences_a") + F.col("occurrences_b")
    stored = F.coalesce(F.col(packed), F.col("size")) if packed else F.col("size")
    each = classes.select("*", F.explode(F.array("class", F.lit("either"))).alias("set"))
    return each.groupBy(F.col("set").alias("class")).agg(F.count("*").alias("chunks"), F.sum(times).alias("occurrences"), F.sum(F.col("size") * times).alias("bytes"), F.sum(stored * times).alias("stored_bytes"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("hash").union(b.select("hash")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("hash").intersect(b.select("hash"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("hash").distinct().join(b.select("hash"), "hash", "left_anti")
