import heapq
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from chunkloom.llm import token_files as tf


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (2, 3, 17, 500):
        counts = rng.integers(1, 10**6, n) ** 2
        bits = tf.code_lengths(counts, 60)
        assert (counts * bits).sum() == huffman_cost(counts.tolist())
    bits = tf.code_lengths(2 ** np.arange(40), 8)
    assert bits.max() <= 8 and (0.5**bits).sum() <= 1
    assert tf.code_lengths(np.array([5])).tolist() == [1]
    with pytest.raises(ValueError):
        tf.code_lengths(np.ones(5, int), 2)


def test_code_round_trip():
    rng = np.random.default_rng(2)
    used = np.unique(rng.integers(0, 5000, 900))
    counts = rng.integers(1, 1000, len(used)) ** 3
    code = tf.Code(used, tf.code_lengths(counts, 12))
    n = np.array([0, 1, 255, 256, 257, 0, 5000, 3, 512])
    ids = rng.choice(used, int(n.sum()), p=counts / counts.sum())
    data, sizes, marks = code.encode(ids, n)
    assert code.decode(data, n, sizes, marks).tolist() == ids.tolist()


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_query_like_whole_texts(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(tf, "BLOCK", block)
    monkeypatch.setattr(tf, "SHARD", 400)
    rng = random.Random(4)
    texts = ["", None, "a", "Hello wörld 's €5", "x y " * 900, "日本", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "日 <|endoftext|>", "<|endoftext|> <|endof", "text|>", "<|endoftext|"] + [" ".join(rng.choices(["the", "in", "on\n", "étre"], k=rng.randrange(60))) for _ in range(40)]
    rows = [(i * 7 % 101, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids int").write.parquet(str(tmp_path / "documents.parquet"))
    whole, start, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for k, t, _ in sorted(rows):
        ids = np.asarray([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tf.op5_token_files(spark, str(tmp_path)).collect())) == want


def test_null_and_repeated_keys_and_empty_tables(spark, tmp_path):
    definition = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    df = spark.createDataFrame([(None, "b"), (1, "x y"), (1, "x y"), (None, None)], "doc_id long, text string")
    tf.write_tokens(df, str(tmp_path / "a"), definition, P.PATTERN, 2)
    got = sorted(tf.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 1] and [r.n_tokens for r in got][2:] == [3, 3]
    tf.write_tokens(df.limit(0), str(tmp_path / "b"), definition, P.PATTERN, 2)
    assert tf.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_a_hot_key_is_split_and_order_is_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SHARD", 300)
    definition = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, "other") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tf.write_tokens(df, str(tmp_path / "a"), definition, P.PATTERN, 2)
    blocks = spark.read.parquet(str(tmp_path / "a" / "blocks")).collect()
    assert len({b.shard for b in blocks if 7 in b["keys"]}) > 2 and len({b.shard for b in blocks if None in b["keys"]}) > 2
    got = sorted(tf.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_added_tokens_as_ordinary_text(spark, tmp_path):
    definition = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    for added, want in ((True, [64, 220, 50256, 275, 2]), (False, [64, 1279, 91, 437, 1659, 5239, 91, 29, 275, 2])):
        tf.write_tokens(df, str(tmp_path / str(added)), definition, P.PATTERN, 2, added=added)
        assert np.frombuffer(tf.read_tokens(spark, str(tmp_path / str(added))).first().ids, "<u4").tolist() == want
