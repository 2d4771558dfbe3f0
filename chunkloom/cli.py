"""Command line: compress, clone, info and diff, on one machine's files (python -m chunkloom.cli ...)."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chunkloom.config import ArchiveOptions, ChunkerConfig, Compression, parse_size
from chunkloom.operators import diff
from chunkloom.sources import archive

log = logging.getLogger("chunkloom")


def session() -> SparkSession:
    return SparkSession.builder.appName("chunkloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _table(path: str) -> tuple[int, ...]:
    with open(path, encoding="ascii") as file:
        return tuple(int(x, 0) for x in file.read().replace(",", " ").split())


def _chunker(p: argparse.ArgumentParser) -> None:
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("--fixed-size", type=parse_size, help="cut every so many bytes")
    kind.add_argument("--hash-chunking", choices=("RollSum", "BuzHash"), default="RollSum", help="cut where a rolling hash says so")
    p.add_argument("--avg-chunk-size", type=parse_size, default=64 << 10)
    p.add_argument("--min-chunk-size", type=parse_size, default=16 << 10)
    p.add_argument("--max-chunk-size", type=parse_size, default=16 << 20)
    p.add_argument("--buzhash-table", type=_table, metavar="FILE", help="256 numbers that BuzHash uses instead of the default ones, in a text file")
    p.add_argument("--rolling-window-size", type=parse_size, help="64 bytes for RollSum, 16 for BuzHash")
    p.add_argument("--hash-length", type=int, default=64)
    p.add_argument("--compression", choices=("brotli", "zstd", "lzma", "none"), default="brotli")
    p.add_argument("--compression-level", type=int, default=6)


def _http(p: argparse.ArgumentParser) -> None:
    p.add_argument("--http-retry-count", type=int, default=0)
    p.add_argument("--http-retry-delay", type=float, default=0)
    p.add_argument("--http-timeout", type=float)
    p.add_argument("--http-header", action="append", default=[], metavar="NAME:VALUE")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chunkloom")
    out.add_argument("-v", "--verbose", action="count", default=0, help="say more; twice: Spark's messages, too")
    commands = out.add_subparsers(dest="command", required=True)
    p = commands.add_parser("compress", help="make an archive")
    p.add_argument("--input", "-i", help="a file; standard input if absent")
    p.add_argument("output")
    p.add_argument("--force-create", "-f", action="store_true")
    p.add_argument("--metadata-value", nargs=2, action="append", default=[], metavar=("KEY", "VALUE"))
    p.add_argument("--metadata-file", nargs=2, action="append", default=[], metavar=("KEY", "PATH"))
    _chunker(p)
    p = commands.add_parser("clone", help="rebuild a source from an archive and seeds")
    p.add_argument("archive")
    p.add_argument("output")
    p.add_argument("--seed", action="append", default=[], help="a file that may share chunks; - for standard input")
    p.add_argument("--seed-output", action="store_true", help="use what the output file holds")
    p.add_argument("--force-create", "-f", action="store_true")
    p.add_argument("--verify-output", action="store_true")
    p.add_argument("--buzhash-table", type=_table, metavar="FILE", help="the numbers that the archive was cut with, if not the default ones")
    p.add_argument("--verify-header", type=lambda x: bytes.fromhex(x if len(x) % 2 == 0 else "0" + x))
    _http(p)
    p = commands.add_parser("info", help="describe an archive")
    p.add_argument("archive")
    p.add_argument("--metadata-key")
    _http(p)
    p = commands.add_parser("diff", help="compare the chunks of two files")
    p.add_argument("a")
    p.add_argument("b")
    _chunker(p)
    return out


def _config(a: argparse.Namespace) -> ChunkerConfig:
    if a.fixed_size:
        return ChunkerConfig.fixed(a.fixed_size, a.hash_length)
    config = ChunkerConfig.rolling(a.hash_chunking.lower(), a.avg_chunk_size, a.min_chunk_size, a.max_chunk_size, a.rolling_window_size, a.hash_length)
    return replace(config, table=a.buzhash_table)


def _options(a: argparse.Namespace) -> dict:
    return {"retries": a.http_retry_count, "delay": a.http_retry_delay, "timeout": a.http_timeout, "headers": dict(h.split(":", 1) for h in a.http_header)}


def _read(path: str | None) -> bytes:
    if path in (None, "-"):
        if sys.stdin.isatty():
            raise SystemExit("Missing input")
        return sys.stdin.buffer.read()
    with open(path, "rb") as file:
        return file.read()


def _source(path: str | None) -> bytes | str:
    """Standard input is read here, a file where it is cut."""
    return _read(path) if path in (None, "-") else path


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    logging.basicConfig(level=(logging.WARNING, logging.INFO, logging.DEBUG)[min(a.verbose, 2)], format="%(message)s")
    spark = spark or session()
    if a.verbose > 1:
        spark.sparkContext.setLogLevel("INFO")
    if a.command == "compress":
        files = {k: _read(path) for k, path in a.metadata_file}
        options = ArchiveOptions(_config(a), Compression(a.compression, a.compression_level)).with_metadata(dict(a.metadata_value), files)
        log.info("cutting %s by %s, compression %s", a.input or "standard input", options.chunker, options.compression)
        d = archive.create_archive(spark, _source(a.input), a.output, options, overwrite=a.force_create)
        print("\n".join(f"{k}: {v}" for k, v in archive.describe(d)))
    elif a.command == "info":
        opened = archive.open_archive(spark, a.archive, **_options(a))
        if a.metadata_key:
            sys.stdout.buffer.write(opened.dictionary.metadata_value(a.metadata_key))
        else:
            print("\n".join(f"{k}: {v}" for k, v in archive.describe(opened.dictionary)))
    elif a.command == "clone":
        if os.path.isfile(a.output) and not (a.force_create or a.seed_output):
            raise SystemExit(f"{a.output} exists")
        opened = archive.open_archive(spark, a.archive, a.buzhash_table, **_options(a))
        log.info("%d chunks to place, header %s", len(opened.dictionary.rebuild_order), opened.dictionary.header_checksum.hex())
        seeds = [(s, _source(s)) for s in sorted(a.seed, key=lambda s: s != "-")]
        in_place = a.seed_output and os.path.exists(a.output)
        for r in archive.clone_archive(opened, seeds, a.output, verify=a.verify_output, expected_header=a.verify_header, in_place=in_place):
            print(f"{r['provider']}: {r['chunks']} chunks, {archive.human(r['bytes_written'] or r['bytes_fed'])}")
    else:
        sides = [archive.cut_source(archive.source_of(spark, path), _config(a), with_data=True) for path in (a.a, a.b)]
        from chunkloom.functions.codecs import compressed

        packed = [s.select("hash", "length", F.length(compressed(F.col("data"), Compression(a.compression, a.compression_level))).cast("long").alias("packed")) for s in sides]
        names = {"a": a.a, "b": a.b, "both": "both", "either": "either"}
        for r in diff.report(diff.classes(*packed, compressed=True), "packed").orderBy("class").collect():
            print(f"{names[r['class']]}: {r.chunks} chunks, {archive.human(r.bytes)}, compressed {archive.human(r.stored_bytes)}")


if __name__ == "__main__":
    main()
