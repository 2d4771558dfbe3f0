"""Data that arrives: files to be deduplicated against all before, and pieces of streams to be cut as one."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunkloom.config import ChunkerConfig
from chunkloom.functions.hashes import digest
from chunkloom.operators.chunking import chunks
from chunkloom.operators.kernels import Scanner


def deduplicate(files: DataFrame, config: ChunkerConfig, table: str, checkpoint: str, *, key: str = "file_id", content: str = "content", hash_algorithm: str = "blake2b"):
    """Cut arriving files and add to the Parquet table (batch, hash, length, key, seq) the chunks that it doesn't have.

    Known chunks are the table itself, so no state grows in memory, and a batch that is run again gives the same table: rows of its number
    are not counted as known, and replaced. Returns the started query's writer, to be given a trigger.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = chunks(batch, config, key=key, content=content, hash_algorithm=hash_algorithm)
        first = new.groupBy("hash").agg(F.min_by(F.struct("length", F.col(key).alias("key"), "seq"), F.struct(key, "seq")).alias("x")).select("hash", "x.*")
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema("hash binary, length long, key string, seq long, batch long").parquet(table).where(F.col("batch") < number)
            first = first.join(known.select("hash"), "hash", "left_anti")
        first.select("hash", "length", F.col("key").cast("string").alias("key"), "seq").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def chunk_segments(segments: DataFrame, config: ChunkerConfig, *, key: str = "file_id", hash_algorithm: str = "blake2b") -> DataFrame:
    """(key, seq, offset, length, hash) of streams that arrive as rows (key, segment, content, last): any segmentation gives the same chunks.

    The state of a stream is the chunk that has begun, what the hash looks back to, and segments that came before their turn. `last` marks the
    end, after which the state goes. Late segments are told by their number; there is no event time.
    """
    def cut(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scanner, turn, seq, waiting = pickle.loads(state.get[0]) if state.exists else (Scanner(config), 0, 0, {})
        for part in parts:
            for r in part.itertuples():
                if r.segment >= turn:
                    waiting[int(r.segment)] = (bytes(r.content or b""), bool(r.last))
        out, done = [], False
        while turn in waiting and not done:
            data, done = waiting.pop(turn)
            for offset, chunk in scanner.feed(data, last=done):
                out.append((k[0], seq, offset, len(chunk), digest(chunk, hash_algorithm)[: config.hash_length]))
                seq += 1
            turn += 1
        if done:
            state.remove()
        else:
            state.update((pickle.dumps((scanner, turn, seq, waiting)),))
        if out:
            yield pd.DataFrame(out, columns=[key, "seq", "offset", "length", "hash"])

    kind = segments.schema[key].dataType.simpleString()
    rows = segments.select(key, "segment", F.col("content").cast("binary").alias("content"), "last")
    return rows.groupBy(key).applyInPandasWithState(cut, f"{key} {kind}, seq long, offset long, length long, hash binary", "state binary", "append", GroupStateTimeout.NoTimeout)
