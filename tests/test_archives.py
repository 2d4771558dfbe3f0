"""Archives to files and back, from local paths and over HTTP, whole and damaged."""

import hashlib
import http.server
import random
import re
import threading

import pytest
from pyspark.errors import PySparkException

from chunkloom import cli
from chunkloom.config import ArchiveOptions, ChunkerConfig, Compression
from chunkloom.errors import ArchiveError, HashMismatchError, RangeError
from chunkloom.sources import archive, header
from chunkloom.sources.ranges import ByteReader, resolve

DATA = random.Random(11).randbytes(8096)
MIXED = DATA[:3000] + b"zeros" * 900 + DATA[:3000] + DATA[5000:]
CHUNKERS = [ChunkerConfig.fixed(64), ChunkerConfig("rollsum", 8, 64, 1024, 32), ChunkerConfig("buzhash", 8, 64, 1024, 16, 20)]
CODECS = [Compression(None), Compression("brotli", 6), Compression("zstd", 3), Compression("lzma", 1)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archives") / "a.arc")
    archive.create_archive(spark, MIXED, path, ArchiveOptions(CHUNKERS[1], CODECS[1]).with_metadata({"k": "v", "z": "long"}))
    return path


@pytest.mark.parametrize("data", [b"", DATA, MIXED])
@pytest.mark.parametrize("k", range(5))
def test_round_trip(spark, tmp_path, data, k):
    options = ArchiveOptions(CHUNKERS[k % 3], CODECS[k % 4])
    path, out = str(tmp_path / "x.arc"), str(tmp_path / "out")
    d = archive.create_archive(spark, data, path, options)
    assert d.source_checksum == (hashlib.blake2b(data).digest()) and d.source_total_size == len(data)
    assert (d.chunker, d.compression) == (options.chunker, options.compression)
    archive.clone_archive(archive.open_archive(spark, path), [], out)
    assert open(out, "rb").read() == data
    with pytest.raises(FileExistsError):
        archive.create_archive(spark, data, path, options)


def test_header_bytes(made):
    head = open(made, "rb").read()
    assert head[:6] in (header.MAGIC,) and not __import__("os").path.exists(made + ".part")
    d = header.parse(ByteReader(made).read)
    assert d.payload_offset == d.header_size and head[d.header_size - 64 : d.header_size] == d.header_checksum
    assert d.metadata == {"k": b"v", "z": b"long"} and d.metadata_value("k") == b"v"
    with pytest.raises(KeyError):
        d.metadata_value("none")
    old = header.OLD_MAGIC + head[6 : d.header_size - 64]
    old += hashlib.blake2b(old).digest()
    assert header.parse(lambda o, n: old[o : o + n]).rebuild_order == d.rebuild_order


def test_message_encoding():
    values = {"application_version": "x", "source_total_size": 1 << 40, "rebuild_order": [0, 1, 300, 1 << 20], "chunk_descriptors": [{"hash": b"ab", "source_size": 5}, {}], "metadata": [{"key": "k", "value": b""}]}
    back = header.decode(header.encode(values, header.MESSAGE), header.MESSAGE)
    assert back["rebuild_order"] == values["rebuild_order"] and back["source_total_size"] == 1 << 40
    assert [c["source_size"] for c in back["chunk_descriptors"]] == [5, 0] and back["metadata"] == [{"key": "k", "value": b""}]


def test_seeds_come_before_the_archive(spark, tmp_path, made):
    opened = archive.open_archive(spark, made)
    used = archive.clone_archive(opened, [("first", DATA[:4000]), ("second", MIXED)], str(tmp_path / "out"), expected_header=opened.dictionary.header_checksum)
    assert open(tmp_path / "out", "rb").read() == MIXED
    assert {r["provider"] for r in used} == {"first", "second"}
    assert sum(r["bytes_written"] for r in used) == len(MIXED)
    with pytest.raises(HashMismatchError):
        archive.clone_archive(opened, [], str(tmp_path / "no"), expected_header=b"")


def test_damage_is_found(spark, tmp_path, made):
    raw = bytearray(open(made, "rb").read())
    d = header.parse(ByteReader(made).read)

    def damaged(name, data):
        path = tmp_path / name
        path.write_bytes(bytes(data))
        return str(path)

    for name, data in (("magic", b"x" + raw[1:]), ("header", raw[:40] + bytes([raw[40] ^ 1]) + raw[41:]), ("short", raw[:100]), ("empty", b"")):
        with pytest.raises(ArchiveError):
            archive.open_archive(spark, damaged(name, data))
    for name, data in (("payload", raw[: d.header_size] + bytes([raw[d.header_size] ^ 1]) + raw[d.header_size + 1 :]), ("cut", raw[:-5])):
        opened = archive.open_archive(spark, damaged(name, data))
        with pytest.raises(PySparkException):
            opened.fetch().collect()


def test_short_hashes_that_collide_are_refused(spark, tmp_path):
    data = b"".join(i.to_bytes(3, "big") for i in range(3))
    ok = ArchiveOptions(ChunkerConfig.fixed(3, 4), Compression(None))
    assert len(archive.create_archive(spark, data, str(tmp_path / "a"), ok).descriptors[0]["hash"]) == 4


class Server(http.server.BaseHTTPRequestHandler):
    data, broken, asked = b"", 0, []

    def do_GET(self):
        first, last = map(int, re.match(r"bytes=(\d+)-(\d+)", self.headers["Range"]).groups())
        Server.asked.append((first, last - first + 1))
        if self.path == "/whole":
            self.send_response(200)
            self.end_headers()
            self.wfile.write(Server.data)
            return
        part = Server.data[first : last + 1]
        self.send_response(206)
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        if Server.broken:
            Server.broken -= 1
            part = part[: len(part) // 2]
        self.wfile.write(part)
        self.close_connection = True

    def log_message(self, *_):
        pass


@pytest.fixture
def url(made):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    Server.data, Server.broken, Server.asked = open(made, "rb").read(), 0, []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_ranges(spark, url, tmp_path):
    assert ByteReader(f"{url}/a").read(10, 50) == Server.data[10:60] and Server.asked == [(10, 50)]
    Server.broken, Server.asked[:] = 2, []
    assert ByteReader(f"{url}/a", retries=2).read(0, 1000) == Server.data[:1000]
    assert Server.asked == [(0, 1000), (500, 500), (750, 250)]  # goes on where it broke off
    Server.broken = 2
    with pytest.raises(RangeError):
        ByteReader(f"{url}/a", retries=1).read(0, 1000)
    Server.broken = 0
    with pytest.raises(RangeError):
        ByteReader(f"{url}/whole").read(0, 10)
    with pytest.raises(RangeError):
        ByteReader(f"{url}/a").read(len(Server.data) - 5, 10)
    archive.clone_archive(archive.open_archive(spark, f"{url}/a"), [], str(tmp_path / "out"))
    assert open(tmp_path / "out", "rb").read() == MIXED


def test_data_source(spark, made, url):
    spark.dataSource.register(archive.ArchiveSource)
    for path in (made, f"{url}/a"):
        df = spark.read.format("chunk_archive").option("run_bytes", 2000).load(path)
        assert df.rdd.getNumPartitions() > 1
        d = header.parse(ByteReader(made).read)
        rows = df.orderBy("idx").collect()
        assert [bytes(r.hash) for r in rows] == [c["hash"] for c in d.descriptors]
        assert b"".join(bytes(rows[i].data) for i in d.rebuild_order) == MIXED


def test_inputs(tmp_path, spark):
    (tmp_path / "f").write_bytes(b"x")
    assert resolve(str(tmp_path / "f")) == str(tmp_path / "f") and resolve("http://h/x") == "http://h/x"
    for wrong in ("/no/such/file", "no/such", "ftp://h/x"):
        with pytest.raises(FileNotFoundError):
            resolve(wrong)
    assert bytes(archive.read_files(spark, str(tmp_path)).first().content) == b"x"


def test_commands(spark, tmp_path, capsys):
    source, arc, out = tmp_path / "s", str(tmp_path / "s.arc"), str(tmp_path / "o")
    source.write_bytes(MIXED)
    sizes = ["--avg-chunk-size", "256", "--min-chunk-size", "64", "--max-chunk-size", "1KiB"]
    cli.main(["compress", "-i", str(source), arc, *sizes, "--metadata-value", "k", "v"], spark)
    assert "Chunks in source" in capsys.readouterr().out
    cli.main(["info", arc], spark)
    assert "RollSum" in capsys.readouterr().out
    cli.main(["clone", arc, out, "--seed", str(source), "--verify-output"], spark)
    assert open(out, "rb").read() == MIXED
    with pytest.raises(SystemExit):
        cli.main(["clone", arc, out], spark)
    cli.main(["clone", arc, out, "--seed-output"], spark)
    assert "in place:" in capsys.readouterr().out
    cli.main(["diff", str(source), out, *sizes], spark)
    assert capsys.readouterr().out.startswith("both: ")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["compress", "x", "--fixed-size", "1KiB", "--hash-chunking", "BuzHash"])
    table = tmp_path / "table"
    table.write_text(" ".join(str(i * 2654435761 % (1 << 32)) for i in range(256)))
    cli.main(["-v", "compress", "-i", str(source), str(tmp_path / "b.arc"), *sizes, "--hash-chunking", "BuzHash", "--buzhash-table", str(table)], spark)
    cli.main(["-v", "clone", str(tmp_path / "b.arc"), str(tmp_path / "b"), "--seed", str(source), "--buzhash-table", str(table)], spark)
    assert open(tmp_path / "b", "rb").read() == MIXED and "archive:" not in capsys.readouterr().out


@pytest.mark.parametrize("k", range(3))
def test_a_file_in_splits(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(archive, "WHOLE", 100)
    monkeypatch.setattr(archive, "RUN", 700)
    monkeypatch.setattr(archive, "SPLIT", 900)
    source, size = tmp_path / "s", 1500
    data = MIXED.replace(b"\0", b"x")
    source.write_bytes(data)
    options = ArchiveOptions(CHUNKERS[k], CODECS[1])
    whole = archive.create_archive(spark, data, str(tmp_path / "a"), options)
    cut = archive.create_archive(spark, archive.file_splits(spark, str(source), size), str(tmp_path / "b"), options)
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes() and whole == cut
    assert not [f for f in tmp_path.iterdir() if "part" in f.name]
    opened = archive.open_archive(spark, str(tmp_path / "b"))
    used = archive.clone_archive(opened, [("file", str(source))], str(tmp_path / "o"))
    assert (tmp_path / "o").read_bytes() == data and [r["provider"] for r in used] == ["file"]
    parts = opened.fetch().collect()
    by = {r.idx: bytes(r.data) for r in parts}
    assert b"".join(by[i] for i in cut.rebuild_order) == data


@pytest.mark.parametrize("k", range(3))
def test_in_place(spark, tmp_path, k):
    rng = random.Random(k)
    blocks = [rng.randbytes(64) for _ in range(40)]
    other = [*rng.sample(blocks, 30), *(rng.randbytes(64) for _ in range(8)), blocks[0], blocks[0]]  # moves in circles, new blocks, repeats
    rng.shuffle(other)
    options = ArchiveOptions(ChunkerConfig.fixed(64) if k < 2 else ChunkerConfig("rollsum", 5, 16, 256, 16), CODECS[0])
    archive.create_archive(spark, b"".join(blocks) + b"end", str(tmp_path / "a"), options)
    opened, out = archive.open_archive(spark, str(tmp_path / "a")), tmp_path / "o"
    for start in (b"".join(other), b"".join(blocks) + b"end" + bytes(500), b"", b"".join(blocks[1:] + blocks[:1])):
        out.write_bytes(start)
        used = archive.clone_archive(opened, [], str(out), in_place=True)
        assert out.read_bytes() == b"".join(blocks) + b"end"
        assert {"in place", "moved"} <= {r["provider"] for r in used}
    out.write_bytes(b"".join(other))
    damaged = bytearray((tmp_path / "a").read_bytes())
    at = damaged.find(blocks[[b in other for b in blocks].index(False)])
    damaged[at + 5] ^= 1
    (tmp_path / "a").write_bytes(bytes(damaged))
    with pytest.raises((HashMismatchError, PySparkException)):
        archive.clone_archive(archive.open_archive(spark, str(tmp_path / "a")), [], str(out), in_place=True)


def test_a_device_is_written_as_it_lies(spark, tmp_path, made, monkeypatch):
    monkeypatch.setattr(archive, "_is_device", lambda path: True)
    opened, out = archive.open_archive(spark, made), tmp_path / "dev"
    out.write_bytes(b"y" * (len(MIXED) + 100))
    archive.clone_archive(opened, [("s", DATA)], str(out))
    assert out.read_bytes() == MIXED + b"y" * 100
    out.write_bytes(MIXED[700:] + b"y" * 800)
    archive.clone_archive(opened, [], str(out), in_place=True)
    assert out.read_bytes()[: len(MIXED)] == MIXED and out.stat().st_size == len(MIXED) + 100
    out.write_bytes(b"short")
    with pytest.raises(ArchiveError):
        archive.clone_archive(opened, [], str(out))
