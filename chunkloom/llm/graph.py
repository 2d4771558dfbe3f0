"""Connected components of a table of links, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> Table:
    """(node, root): every node of links (u, v) that is not the smallest of its component, with that smallest node.

    Each round hangs neighbours onto smaller ones; the rounds grow with the logarithm of a component's
    diameter. Only minima and joins on a node are used, so no neighbourhood is gathered in one place.
    Every round is written to the shared folder; the one before it goes.
    """
    edge = lambda df, a, b: df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = Table(edge(links.where("u <> v"), "u", "v").distinct(), "links")
    seen = _state(now.df)
    while seen[0]:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new = Table(small.where("u <> v").distinct(), "links")
        now.drop()
        now, state = new, _state(new.df)
        if state == seen:
            break
        seen = state
    roots = Table(now.df.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
    now.drop()
    return roots
