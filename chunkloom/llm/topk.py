"""Exact top-k inner products: every query against every row, a term at a time.

Vectors become whole numbers, and a block of rows an inverted index: for each component (a term) the rows where it
isn't zero, with their values. A query adds, for each of its own terms, the postings times its value into a dense
array of scores; the best k of the array are selected by partition, and the selections of all blocks merged.
Rows and queries are dealt into blocks, and queries copied to each block of rows: that product is
what exhaustive search is; it is shared out evenly, and nothing is broadcast or collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .substrings import list_lengths

#: Rows in a block, at most; queries in a packet.
ROWS, QUERIES = 1 << 16, 1 << 12


def whole_numbers(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows without key or vector, or with a null or non-finite component, are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _packed(rows: DataFrame, most: int, prefix: str) -> DataFrame:
    """Rows of one partition as packets: ids, dimensions, and values padded with zeros."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packet() -> pa.RecordBatch:
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            sizes = np.concatenate([list_lengths(b.column(1)) for b in held])
            flat = np.concatenate([b.column(1).flatten().to_numpy() for b in held])
            dims = int(sizes.max(initial=0))
            values = np.zeros((len(ids), dims), np.int64)
            values[np.arange(dims) < sizes[:, None]] = flat
            order = np.lexsort((*values.T[::-1], ids))
            kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not flat.size or (np.iinfo(t).min <= flat.min() and flat.max() <= np.iinfo(t).max))
            cells = [TaskContext.get().partitionId(), ids[order].tobytes(), dims, np.dtype(kind).str, values[order].astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["bucket", f"{prefix}ids", f"{prefix}dims", f"{prefix}kind", f"{prefix}values"])

        count = 0
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                if count and count + part.num_rows > most:
                    yield packet()
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if held:
            yield packet()

    return rows.mapInArrow(work, f"bucket long, {prefix}ids binary, {prefix}dims long, {prefix}kind string, {prefix}values binary")


def best_of_block(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and ids and scores of the best k rows of a block whose ids ascend; ties to smaller ids."""
    dims = min(values.shape[1], queries.shape[1])
    top = lambda x: int(np.abs(x).max(initial=0))
    bound = top(values) * top(queries) * dims
    if bound >= 1 << 63:
        raise OverflowError("scores don't fit 64 bits")
    exact = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    postings = []
    for t in range(dims):
        where = np.flatnonzero(values[:, t])
        weights = values[where, t].astype(exact)
        postings.append((slice(None) if len(where) == len(values) else where, weights))
    n = len(ids)
    scores, step = np.zeros(n, exact), np.empty(n, exact)
    for place in range(len(query_ids)):
        scores[:] = 0
        row = queries[place]
        for t in np.flatnonzero(row[:dims]).tolist():
            where, weights = postings[t]
            scores[where] += np.multiply(weights, exact(row[t]), out=step[: len(weights)])
        a, b = np.searchsorted(ids, query_ids[place], "left"), np.searchsorted(ids, query_ids[place], "right")
        own = np.delete(scores, slice(a, b)) if b > a else scores
        rest = np.delete(ids, slice(a, b)) if b > a else ids
        if len(own) > k:
            edge = np.partition(own, len(own) - k)[len(own) - k]
            above = np.flatnonzero(own > edge)
            chosen = np.concatenate([above, np.flatnonzero(own == edge)[: k - len(above)]])
        else:
            chosen = np.arange(len(own))
        yield place, rest[chosen], own[chosen].astype(np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of highest integer inner product, ties to the smaller id.

    Components are floor(scale * x), those beyond 64 bits the largest or smallest number of 64 bits (whose products then are an error); a shorter vector counts as padded with zeros. Rows without an id or a vector, or with a null or
    non-finite component, take no part. A row is no candidate for a query of its own id. Equal query rows count once; queries with
    one id and different vectors are ranked apart. Only key and vector are read, so other columns' names don't matter. Rows that repeat are candidates each. Where there are fewer than k candidates, all are returned.
    """
    spark = rows.sparkSession
    candidates = whole_numbers(rows, key, vector, scale)
    asked = whole_numbers(queries, key, vector, scale).distinct()
    small_batches(spark)
    n = candidates.count()
    buckets = max(1, -(-n // ROWS), min(-(-n // 2048), 2 * spark.sparkContext.defaultParallelism))
    blocks = _packed(candidates.repartition(buckets, F.xxhash64("id", "v")), ROWS, "c")
    packets = _packed(asked, QUERIES, "q").drop("bucket").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                read = lambda p: (np.frombuffer(r[f"{p}ids"], np.int64), np.frombuffer(r[f"{p}values"], r[f"{p}kind"]).reshape(-1, r[f"{p}dims"]) if r[f"{p}dims"] else np.zeros((len(r[f"{p}ids"]) // 8, 0), np.int8))  # noqa: E731, B023
                (ids, values), (query_ids, asked_values) = read("c"), read("q")
                found = list(best_of_block(ids, values, query_ids, asked_values, k))
                sizes = [len(x[1]) for x in found]
                tag = [zlib.crc32(asked_values[p].astype(np.int64).tobytes().rstrip(b"\0")) for p, _, _ in found] if len(set(query_ids.tolist())) < len(query_ids) else [0] * len(found)
                columns = [np.repeat(query_ids[[x[0] for x in found]], sizes), np.repeat(np.array(tag, np.int64), sizes), np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["query_id", "tag", "vec_id", "score"])

    pairs = packets.join(blocks, "bucket")
    # a pair is much work and few bytes, so tasks are as many as pairs ask for, not bytes; a packet's pairs go to tasks one after another
    tasks = max(buckets, 2 * spark.sparkContext.defaultParallelism)
    pairs = pairs.repartitionById(tasks, F.pmod(F.col("bucket") + F.xxhash64("qids"), F.lit(tasks)).cast("int")).drop("bucket")
    found = pairs.mapInArrow(search, "query_id long, tag long, vec_id long, score long")
    order = Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
