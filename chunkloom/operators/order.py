"""Running sums over long sequences, without one task for each sequence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of input for each stretch that sequences are cut into; rows, where the size of the input isn't known; stretches at most.
STRETCH, ROWS, MOST = 256 << 20, 1_000_000, 4096


def stretches(df: DataFrame) -> int:
    """As many as the tables that a plan reads ask for, by their statistics: no job runs for it if they have any."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    except Exception:  # a session that doesn't show its plans
        sizes = [1 << 60]
    if max(sizes, default=0) >= 1 << 60:
        return max(1, min(-(-df.count() // ROWS), MOST))
    return max(1, min(-(-sum(sizes) // STRETCH), MOST))


def stretch_of(order: Column, bounds: list) -> Column:
    """How many of the bounds, ascending, are smaller: in the JVM for a few, else by binary search over Arrow batches."""
    if len(bounds) <= 64:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < order))
    edges = np.array(bounds)

    @F.arrow_udf("int")
    def search(x: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, x.to_numpy(zero_copy_only=False), "left").astype(np.int32))

    return search(order)


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """The table with a column for each of `values`: the sum of the group's rows before this one, by the order.

    The first order column (a number, without nulls) cuts sequences into stretches by quantiles of the whole table, as many
    as the input's size asks for. Sums within a stretch and sums of the stretches before it are taken apart, so no task holds a whole
    sequence unless it is short.
    """
    parts = stretches(df) if parts is None else parts
    stretch = F.lit(0)
    if parts > 1:
        bounds = df.agg(F.percentile_approx(order[0], [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
        stretch = stretch_of(F.col(order[0]), sorted(set(bounds)))
    named = df.select("*", stretch.alias("stretch_"), *[v.alias(f"{k}_in") for k, v in values.items()])
    inside = Window.partitionBy(*group, "stretch_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = named.select("*", *[F.coalesce(F.sum(f"{k}_in").over(inside), F.lit(0)).alias(k) for k in values])
    if parts > 1:
        totals = named.groupBy(*group, "stretch_").agg(*[F.sum(f"{k}_in").alias(f"{k}_t") for k in values])
        before = Window.partitionBy(*group).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select(*group, "stretch_", *[F.coalesce(F.sum(f"{k}_t").over(before), F.lit(0)).alias(f"{k}_b") for k in values])
        sums = sums.join(base, [*group, "stretch_"]).select("*", *[(F.col(k) + F.col(f"{k}_b")).alias(f"{k}_s") for k in values])
        sums = sums.drop(*values).withColumnsRenamed({f"{k}_s": k for k in values})
    return sums.select(*df.columns, *[F.col(k).cast("long").alias(k) for k in values])
