import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from chunkloom.llm import bpe

TEXTS = [
    "Hello world, it's  two  spaces\n\n\tand tabs", "", None, "a", "é", "naïve ​ zero width", "日本語 text 한국어",
    "12345 67 8", "<|endoftext|> is ordinary", "\U0001f600 smile 's", "՘'s odd letter", "x" * 3000, " " * 50 + "y",
]


@pytest.fixture(scope="module")
def definition():
    return bpe.tokenizer_json(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_same_ids_as_the_rank_library(definition, encoding):
    rng = random.Random(7)
    pool = [chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x250), rng.randrange(0x20, 0xD7FF), 10, 32, 39])) for _ in range(800)]
    texts = ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choices("abetinshe ing'", k=30)) for _ in range(2000)] + [t or "" for t in TEXTS]
    ids, counts = bpe.Coder(definition, P.PATTERN).encode(texts)
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends):
        assert ids[end - n : end].tolist() == encoding.encode_ordinary(text)
    assert bpe.Decoder(definition).decode(ids).tobytes() == "".join(texts).encode()


def test_forgetting_changes_nothing(definition, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Coder(definition, P.PATTERN)
    first = [coder.encode([t])[0].tolist() for t in TEXTS]
    assert first == [coder.encode([t])[0].tolist() for t in TEXTS]


def test_round_trip_with_nulls_repeats_and_clashing_columns(spark, definition, encoding):
    rows = [(i if i % 5 else None, t, 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[0], 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumnRenamed("ids", "n_tokens")
    got = bpe.round_trip(df, definition, P.PATTERN, positions=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for k, t, _ in rows)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    for r in got:
        text, ids = bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist()
        ends = np.cumsum([len(encoding.decode_single_token_bytes(i)) for i in ids]).tolist()
        assert np.frombuffer(r.byte_ends, "<i8").tolist() == ends
        starts = np.cumsum([1] + [len(c.encode()) for c in text])[:-1] - 1 if text else []
        assert np.frombuffer(r.char_ends, "<i8").tolist() == [int(np.sum(np.asarray(starts) < e)) for e in ends]
    back = bpe.decode(bpe.round_trip(df, definition, P.PATTERN, decoded=False), definition).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted(x[2] for x in want)


def test_stream_decoder_holds_back_split_characters(definition, encoding):
    text = "a 日本語 \U0001f600 é"
    decoder, out = bpe.StreamDecoder(definition), []
    for i in encoding.encode_ordinary(text):
        out.append(decoder.feed([i]))
    assert "".join(out) + decoder.feed([], last=True) == text
    assert not any("�" in x for x in out)


def test_query_digests(spark, tmp_path, encoding):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in bpe.op9_byte_bpe(spark, str(tmp_path)).collect():
        text = TEXTS[r.doc_id] or ""
        ids = np.asarray(encoding.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(spark, definition):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), definition, P.PATTERN).count() == 0
