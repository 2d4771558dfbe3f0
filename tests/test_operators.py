"""Operators on small tables with known results."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chunkloom.config import ArchiveOptions, ChunkerConfig, Compression, filter_bits, parse_size
from chunkloom.errors import CompressionError, ConfigError, SizeError
from chunkloom.functions import codecs, hashes, sizes
from chunkloom.operators import chunking, clone, dictionary, diff, order, reorder
from chunkloom.operators.kernels import chunk_ends
from chunkloom.sources import archive


def index(spark, rows, archive=0):
    """rows: (hash number, size, offsets)"""
    flat = [(archive, bytearray([h]), n, o) for h, n, offsets in rows for o in offsets]
    return spark.createDataFrame(flat, "archive_id int, hash binary, length long, offset long")


CASES = [
    # current, target, what remains
    ([(1, 10, [0])], [(1, 10, [0])], []),
    ([(1, 10, [20, 0])], [(1, 10, [0, 20])], []),
    ([(1, 10, [0, 20])], [(1, 10, [20, 30])], [(1, 30)]),
    ([(1, 10, [0]), (2, 20, [20]), (3, 20, [30, 50]), (4, 5, [70, 80])], [(1, 10, [10]), (2, 20, [20]), (3, 20, [30, 50]), (4, 5, [80, 90])], [(1, 10), (4, 90)]),
]


@pytest.mark.parametrize("current,target,left", CASES)
def test_in_place_and_remaining(spark, current, target, left):
    a, b = index(spark, current), index(spark, target)
    assert sorted((r.hash[0], r.offset) for r in clone.remaining(a, b).collect()) == left
    places = sum(len(o) for *_, o in target) - len(left)
    assert [r.places for r in clone.in_place(a, b).collect()] == ([places] if places else [])


def test_in_place_counts_what_both_have(spark):
    for current, target in (([(1, 10, [0, 20])], [(1, 10, [40])]), ([(1, 10, [0])], [(1, 10, [10, 20])])):
        assert clone.in_place(index(spark, current), index(spark, target)).collect() == []


def test_reorder_of_overlaps_and_loops(spark):
    current = index(spark, [(1, 10, [0]), (2, 20, [10]), (3, 20, [30, 50])])
    target = index(spark, [(1, 10, [60]), (2, 20, [50]), (3, 20, [10, 30]), (4, 5, [0, 5])])
    steps = reorder.reorder(current, target, 20).orderBy("step").collect()
    copies = {r.hash[0]: (r.source, r.dest) for r in steps if r.op == "copy"}
    assert copies == {1: (0, [60]), 2: (10, [50]), 3: (30, [10])}  # 3 is in place at 30 already
    steps = reorder.reorder(current, target, 20, strip=False).orderBy("step").collect()
    assert [(r.op, r.hash[0], r.source, r.dest) for r in steps] == [("copy", 1, 0, [60]), ("copy", 2, 10, [50]), ("copy", 3, 30, [10, 30])]
    one = reorder.reorder(index(spark, [(1, 10, [0, 20])]), index(spark, [(1, 10, [20, 40])]), 10).collect()
    assert [(r.op, r.source, r.dest) for r in one] == [("copy", 0, [40])]


def test_reorder_moves_data_without_loss(spark):
    rng = random.Random(4)
    for trial in range(12):
        chunks = {h: rng.randbytes(rng.randrange(1, 9)) for h in range(1, 12)}
        lay = lambda: [rng.choice(list(chunks)) for _ in range(rng.randrange(1, 16))]  # noqa: E731, B023
        old, new = lay(), lay()

        def layout(hs):
            out, at = {}, 0
            for h in hs:
                out.setdefault(h, []).append(at)
                at += len(chunks[h])  # noqa: B023
            return [(h, len(chunks[h]), o) for h, o in out.items()]  # noqa: B023

        buffer = bytearray(b"".join(chunks[h] for h in old)) + bytearray(200)
        steps = reorder.reorder(index(spark, layout(old)), index(spark, layout(new)), 8).orderBy("step").collect()
        write = lambda a, x: buffer.__setitem__(slice(a, a + len(x)), x)  # noqa: E731, B023
        reorder.carry_out(((r.op, bytes(r.hash), r.size, r.source, r.dest) for r in steps), lambda a, n: bytes(buffer[a : a + n]), write)  # noqa: B023
        at = 0
        for h in new:
            if h in old:
                assert bytes(buffer[at : at + len(chunks[h])]) == chunks[h], (trial, old, new)
            at += len(chunks[h])


def test_overlaps(spark):
    layout = [(k, n, [o]) for k, (o, n) in enumerate([(0, 10), (10, 5), (15, 7), (30, 10), (40, 10)])]
    for (o, n), want in (((10, 30), [10, 15, 30]), ((23, 6), []), ((0, 1), [0]), ((9, 2), [0, 10])):
        found = clone.overlaps(index(spark, layout), index(spark, [(99, n, [o])]), 30).collect()
        assert sorted(r.offset for r in found) == want
    even = index(spark, [(k, 5, [5 * k]) for k in range(4)])
    for (o, n), want in (((5, 5), [5]), ((5, 6), [5, 10]), ((4, 6), [0, 5]), ((20, 10), [])):
        assert sorted(r.offset for r in clone.overlaps(even, index(spark, [(99, n, [o])]), 6).collect()) == want


def test_ranges_that_touch_are_one_request(spark):
    for ranges, first in (([(0, 1), (10, 1)], 1), ([(0, 1), (1, 3), (10, 3)], 2), ([(0, 1), (1, 3), (4, 3), (7, 3), (50, 3)], 4)):
        df = spark.createDataFrame([(0, k, o, n) for k, (o, n) in enumerate(ranges)], "archive_id int, idx long, offset long, size long")
        runs = clone.coalesced(df).orderBy("first_idx").collect()
        assert runs[0].ranges == first and sum(r.ranges for r in runs) == len(ranges)
        assert (runs[0].offset, runs[0].size) == (0, sum(n for _, n in ranges[:first]))


def test_running_sums_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(order, "STRETCH", 100)
    monkeypatch.setattr(order, "ROWS", 7)
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(60)]
    got = order.running(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], ["k"], {"n": F.lit(1), "s": F.col("v")}).collect()
    for g in "ab":
        at = n = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.k):
            assert (r.n, r.s) == (n, at)
            n, at = n + 1, at + r.v


def test_diff_adds_occurrences_of_both_sides(spark):
    side = lambda rows: spark.createDataFrame([(bytearray([h]), n) for h, n, times in rows for _ in range(times)], "hash binary, length long")
    a, b = side([(1, 10, 2), (2, 5, 1)]), side([(1, 10, 3), (3, 7, 1)])
    found = {r.hash[0]: (r["class"], r.occurrences_a, r.occurrences_b) for r in diff.classes(a, b).collect()}
    assert found == {1: ("both", 2, 3), 2: ("a", 1, 0), 3: ("b", 0, 1)}
    report = {r["class"]: (r.chunks, r.occurrences, r.bytes) for r in diff.report(diff.classes(a, b)).collect()}
    assert report == {"both": (1, 5, 50), "a": (1, 1, 5), "b": (1, 1, 7), "either": (3, 7, 62)}
    assert [sorted(r.hash[0] for r in f(a, b).collect()) for f in (diff.union, diff.intersection, diff.difference)] == [[1, 2, 3], [1], [2]]


def test_providers_prefer_low_ranks_and_not_themselves(spark):
    needed = spark.createDataFrame([("x", bytearray([h]), 4, 4 * h) for h in range(4)], "archive_id string, hash binary, length long, offset long")
    seeds = spark.createDataFrame([("x", 0, bytearray([0])), ("s1", 1, bytearray([1])), ("s2", 2, bytearray([1])), ("s2", 2, bytearray([0])), ("s2", 2, bytearray([2])), ("s2", 2, bytearray([2]))], "provider string, rank int, hash binary")
    assert {r.hash[0]: r.provider for r in clone.providers(needed, seeds).collect()} == {0: "s2", 1: "s1", 2: "s2", 3: "archive"}


def test_collisions_of_short_hashes(spark):
    df = spark.createDataFrame([(bytearray(b"aab"),), (bytearray(b"aac"),), (bytearray(b"xyz"),), (bytearray(b"xyz"),)], "hash binary")
    assert [(bytes(r.prefix), r.hashes) for r in dictionary.truncation_collisions(df, 2).collect()] == [(b"aa", 2)]


def test_sizes_as_text(spark):
    df = spark.createDataFrame([(100,), (1024,), (10000,), (100000000,), (10000000000,), (None,)], "n long")
    want = ["100 bytes", "1024 bytes", "9.8 KiB (10000 bytes)", "95.4 MiB (100000000 bytes)", "9536.7 MiB (10000000000 bytes)", None]
    assert [r.t for r in df.select(sizes.human_size(F.col("n")).alias("t")).collect()] == want
    texts = {"134MiB": 140509184, "134KiB": 137216, "134B": 134, "134": 134, "1GiB": 1 << 30}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(sizes.parse_size(F.col("t")).alias("n")).collect()] == list(texts.values())
    assert [parse_size(t) for t in texts] == list(texts.values())
    for wrong in ("1.5KiB", "12 MiB", "12MB", "", "KiB"):
        with pytest.raises(SizeError):
            parse_size(wrong)
        with pytest.raises(PySparkException):
            spark.createDataFrame([(wrong,)], "t string").select(sizes.parse_size(F.col("t"))).collect()


def test_hashes(spark):
    df = spark.createDataFrame([(bytearray(b"abc"), "1234ef", "f12")], "d binary, even string, odd string")
    r = df.select(hashes.hash_of(F.col("d")).alias("b"), hashes.hash_of(F.col("d"), "sha256").alias("s"), hashes.from_hex(F.col("even")).alias("e"), hashes.from_hex(F.col("odd")).alias("o")).first()
    assert bytes(r.b) == hashlib.blake2b(b"abc").digest() and bytes(r.s) == hashlib.sha256(b"abc").digest()
    assert bytes(r.e) == bytes([0x12, 0x34, 0xEF]) and bytes(r.o) == bytes([0x0F, 0x12])
    long = bytes(range(13))
    pairs = [(b"", bytes(5), True), (long, long[:5], True), (long, long[:5] + b"\0", False)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b), w) for a, b, w in pairs], "a binary, b binary, w boolean")
    assert all(r.same == r.w for r in df.select("w", hashes.same_prefix(F.col("a"), F.col("b")).alias("same")).collect())
    with pytest.raises(PySparkException):
        df.select(hashes.from_hex(F.lit("1234efy1"))).collect()


@pytest.mark.parametrize("how", [Compression(None), Compression("brotli", 11), Compression("zstd", 22), Compression("lzma", 9)])
def test_codecs(how):
    for data in (b"", b"a" * 5000, random.Random(1).randbytes(500)):
        assert codecs.expand(codecs.squeeze(data, how), how.codec, len(data)) == data
    if how.codec:
        with pytest.raises(CompressionError):
            codecs.expand(b"not compressed", how.codec, 100)


def test_parameters_are_checked():
    assert Compression("none", 9).codec is None and str(Compression("zstd", 22)) == "zstd (level 22)"
    for codec, level in (("brotli", 0), ("brotli", 12), ("zstd", 23), ("lzma", 10), ("zip", 1)):
        with pytest.raises(CompressionError):
            Compression(codec, level)
    assert filter_bits(64 << 10) == 15 and ChunkerConfig.rolling().bits == 15 and ChunkerConfig.rolling().window == 64
    assert ChunkerConfig.rolling("buzhash").window == 16 and ChunkerConfig(bits=15).target_average == 64 << 10
    for wrong in (dict(average=1), dict(average=8, minimum=16), dict(average=64 << 20), dict(hash_length=3), dict(hash_length=65)):
        with pytest.raises(ConfigError):
            ChunkerConfig.rolling(**wrong)
    for wrong in (("sum", 5), ("rollsum", 0), ("buzhash", 5, 3, 4, 9), ("rollsum", 5, 10, 5), ("fixed", 0, 0, 0)):
        with pytest.raises(ConfigError):
            ChunkerConfig(*wrong)
    for c in (ChunkerConfig(), ChunkerConfig.fixed(64), ChunkerConfig("buzhash", 5, 3, 640, 5, 20)):
        assert ChunkerConfig.from_params(c.to_params()) == c
    options = ArchiveOptions().with_metadata({"a": "text", "b": "x"}, {"a": b"file"})
    assert options.metadata == {"a": b"file", "b": b"x"}


@pytest.mark.parametrize("config", [ChunkerConfig.fixed(50, 20), ChunkerConfig("rollsum", 5, 10, 200, 8, 20), ChunkerConfig("buzhash", 5, 10, 200, 8, 20)])
def test_chunks_of_tables_and_of_splits(spark, config):
    rng = random.Random(3)
    files = [(k, bytearray(bytes(rng.randrange(1, 256) for _ in range(n)))) for k, n in enumerate([0, 1, 49, 50, 51, 700, 3000])] + [(9, None)]
    df = spark.createDataFrame(files, "file_id long, content binary").repartition(3)
    got = chunking.chunks(df, config, with_data=True).collect()
    import numpy as np

    want = []
    for k, d in files:
        a = 0
        for seq, b in enumerate(chunk_ends(np.frombuffer(bytes(d or b""), np.uint8), np.array([0, len(d or b"")]), config)[0].tolist()):
            want.append((k, seq, a, b - a, hashlib.blake2b(d[a:b]).digest()[:20], bytes(d[a:b])))
            a = b
    assert sorted((r.file_id, r.seq, r.offset, r.length, bytes(r.hash), bytes(r.data)) for r in got) == want
    splits = [(k, o, d[o : o + 60]) for k, d in files if d for o in range(0, len(d), 60)]
    found = chunking.chunks_of_splits(spark.createDataFrame(splits, "file_id long, split_offset long, content binary"), config).collect()
    assert sorted((r.file_id, r.seq, r.offset, r.length, bytes(r.hash)) for r in found) == [w[:5] for w in want]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "file_id long, content binary")
    assert chunking.chunks(none, ChunkerConfig()).count() == chunking.fixed_chunks(none, 9).count() == 0
    cut = spark.createDataFrame([], "archive_id int, file_id long, seq long, length long, hash binary")
    numbered = dictionary.dictionary(cut)
    assert numbered.count() == dictionary.summary(cut).count() == dictionary.source_layout(dictionary.rebuild_order(cut, numbered), numbered).count() == 0


def test_many_stretches_and_ranges_over_them(spark, monkeypatch):
    monkeypatch.setattr(order, "STRETCH", 1)
    monkeypatch.setattr(order, "ROWS", 2)
    rng = random.Random(5)
    rows, at = [], 0
    for k in range(200):
        at += rng.choice([0, 0, 0, 7])
        rows.append((k % 2, k, at, 3))
        at += 3 * (k % 2)
    df = spark.createDataFrame(rows, "archive_id int, idx long, offset long, size long")
    assert order.stretches(df) > 64  # beyond what is compared one by one
    got = clone.coalesced(df).collect()
    monkeypatch.undo()
    assert sorted(map(str, got)) == sorted(map(str, clone.coalesced(df).collect())) and len(got) > 20


def test_ties_of_sizes_go_to_the_even_digit(spark):
    sizes_ = [1280, 3328, 1331, 1332, 5 << 18, 7 << 19, (1 << 20) + (1 << 18), 1025, (1 << 50) + (1 << 18)]
    df = spark.createDataFrame([(n,) for n in sizes_], "n long")
    assert [r.t for r in df.select(sizes.human_size(F.col("n")).alias("t")).collect()] == [archive.human(n) for n in sizes_]
    assert archive.human(1280) == "1.2 KiB (1280 bytes)" and archive.human(3328) == "3.2 KiB (3328 bytes)"


def test_joined_values(spark):
    rows = [([b"ab", b"", None, b"c"],), ([],), (None,), ([b"xyz"],)]
    df = spark.createDataFrame(rows, "x array<binary>").repartition(2)
    assert sorted(bytes(r.y) for r in df.select(hashes.joined("x").alias("y")).collect()) == [b"", b"", b"abc", b"xyz"]


def test_splits_shorter_than_the_window_are_refused(spark):
    df = spark.createDataFrame([(0, k * 10, bytearray(range(10))) for k in range(9)], "file_id long, split_offset long, content binary")
    with pytest.raises(PySparkException):
        chunking.chunks_of_splits(df, ChunkerConfig("rollsum", 5, 16, 256, 32)).collect()
