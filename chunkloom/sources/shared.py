"""Folders and files that the driver and the executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the application ends; where that isn't set, a temporary one, if the session runs on one machine."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.gettempdir()
    path = f"{top.rstrip('/')}/chunkloom-{tag}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def local_path(path: str) -> str:
    """The path of a file: URI or path, as the operating system has it."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is not in a mounted file system")
    return path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path


def write_at(pieces: DataFrame, path: str) -> int:
    """Write rows (offset, data) at their offsets into an existing file that all executors see; returns the bytes written. A task that runs again writes the same."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out = 0, None
        try:
            for batch in batches:
                out = os.open(path, os.O_WRONLY) if out is None else out
                for offset, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    left = memoryview(data.as_buffer())
                    while len(left):
                        n = os.pwrite(out, left, offset)
                        left, offset, done = left[n:], offset + n, done + n
        finally:
            if out is not None:
                os.close(out)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    return pieces.select("offset", "data").mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0
