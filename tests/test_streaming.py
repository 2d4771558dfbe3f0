"""Arriving files and segments, in several batches."""

import random

import pytest

from chunkloom.config import ChunkerConfig
from chunkloom.operators.chunking import chunks
from chunkloom.streaming.arriving import chunk_segments, deduplicate

ROLL = ChunkerConfig("rollsum", 5, 8, 200, 8, 32)


def rows(df):
    return sorted((r.file_id, r.seq, r.offset, r.length, bytes(r.hash)) for r in df.collect())


def test_only_new_chunks_are_added(spark, tmp_path):
    rng = random.Random(2)
    files = [(k, bytearray(rng.randbytes(600))) for k in range(4)]
    files += [(k + 4, d) for k, d in files]  # the same again, in later batches
    for k, f in enumerate(files):
        spark.createDataFrame([f], "file_id long, content binary").write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("file_id long, content binary").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in" / "*"))
    for _ in range(2):  # the second run finds nothing new
        query = deduplicate(stream, ROLL, str(tmp_path / "chunks"), str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        stored = spark.read.parquet(str(tmp_path / "chunks"))
        want = chunks(spark.createDataFrame(files, "file_id long, content binary"), ROLL).select("hash").distinct().count()
        assert stored.count() == stored.select("hash").distinct().count() == want


@pytest.mark.parametrize("config", [ROLL, ChunkerConfig("buzhash", 5, 8, 200, 8, 32), ChunkerConfig.fixed(100, 32)])
def test_segments_in_any_order_give_the_same_chunks(spark, tmp_path, config):
    rng = random.Random(3)
    files = [(k, bytearray(bytes(rng.choice([0, 0, 1, 7, 200]) for _ in range(700)))) for k in range(3)]
    segments = []
    for k, d in files:
        edges = [0, *sorted(rng.sample(range(700), 5)), 700]
        segments += [(k, n, d[a:b], b == 700) for n, (a, b) in enumerate(zip(edges, edges[1:]))]
    rng.shuffle(segments)
    schema = "file_id long, segment long, content binary, last boolean"
    for k in range(0, len(segments), 6):
        spark.createDataFrame(segments[k : k + 6], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = chunk_segments(stream, config).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(chunks(spark.createDataFrame(files, "file_id long, content binary"), config))
