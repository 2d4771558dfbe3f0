"""run() against a plain version of every stage, on planted cases."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from chunkloom.llm.bpe import read_ranks
from tests.llm import test_lines, test_mixing, test_near_copies, test_quality


def planted():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghiklmnorstuéü", k=rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: "\n".join(" ".join(rng.choices(words, k=25)).capitalize() + "." for _ in range(n))
    texts = [prose(rng.randrange(3, 9)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[1]]  # exact copies
    for t in texts[2:12]:  # near copies: a word of each second line changed
        split = t.split("\n")
        for i in range(0, len(split), 2):
            w = split[i].split()
            w[7] = rng.choice(words)
            split[i] = " ".join(w)
        texts.append("\n".join(split))
    texts += [t.replace(".\n", "!\n") for t in texts[20:24]]  # one edit in each line
    texts += ["Home | News | About | Contact\n" * 20, "BUY!! NOW!! " * 60, "too short", "", None, "go " * 100]
    texts += [prose(4) + "\nAll rights reserved.\nShare this page with your friends today.\n" + prose(2) for _ in range(6)]
    return [(i, t, "xx", rng.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]


def plain(rows):
    kept = [(i, "\n".join(x for x in t.split("\n") if not test_quality.fails(x)), s) for i, t, _, s, _ in rows if test_quality.brute(t)[-1]]
    yield kept
    deduped = {k: t for k, t, *_ in test_lines.brute([(i, t) for i, t, _ in kept])}
    kept = [(i, deduped[i], s) for i, _, s in kept]
    yield kept
    stay = {kept[k][0] for k in test_near_copies.kept([(i, t) for i, t, _ in kept])[0]}
    kept = [r for r in kept if r[0] in stay]
    yield kept


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rows = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    docs, out = spark.read.parquet(str(path / "documents.parquet")), []
    columns = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(path)).write.parquet(str(path / f"out{k}"))
        docs = spark.read.parquet(str(path / f"out{k}"))
        out.append(docs.collect())
        assert k == 4 or docs.columns == columns
    return rows, out, str(path)


def test_filtering_stages_like_the_plain_version(stages):
    rows, out, _ = stages
    for want, got in zip(plain(rows), out):
        assert sorted((r.doc_id, r.text, str(r.source), r.n_chars) for r in got) == sorted((i, t, str(s), len(t)) for i, t, s in want)


def test_planted_cases(stages):
    rows, out, _ = stages
    left = {r.doc_id for r in out[2] if r.text}
    assert not left & {60, 61, 62}  # exact copies
    assert not left & set(range(73, 77))  # copies with one edit in each line
    assert not left & set(range(77, 83))  # junk
    assert set(range(60)) <= left  # clean documents
    assert set(range(83, 89)) <= left
    assert not any("All rights reserved" in (r.text or "") for r in out[0])
    assert sum("Share this page" in (r.text or "") for r in out[1]) == 0  # boilerplate went with the quality rules


def test_mix_near_targets(stages):
    _, out, _ = stages
    sizes, taken = Counter(), Counter()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in out[2]:
        sizes[r.source] += count(r.text)
    for r in out[3]:
        taken[r.source] += count(r.text)
    assert max(Counter(r.doc_id for r in out[3]).values()) <= 3
    for s, t in test_mixing.targets(sizes).items():
        assert abs(taken[s] - t) <= 0.05 * t


def test_ids_and_run(spark, stages):
    _, out, path = stages
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((r.doc_id, r.text) for r in out[4]) == sorted((r.doc_id, r.text or "") for r in out[3])
    for r in out[4]:
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(r.text) and r.n_tokens == len(r.ids) // 4
    assert sorted(map(tuple, cp.run(spark, path).collect())) == sorted(map(tuple, out[4]))


@pytest.mark.parametrize("k", range(5))
def test_stages_with_nulls_clashing_names_and_empty_tables(spark, k):
    rng = random.Random(1)
    text = lambda: "\n".join(" ".join("".join(rng.choices("abcdefghik", k=5)) for _ in range(30)) + "." for _ in range(4))
    rows = [(None, text(), None, None, None), (1, None, "xx", "a", 0), (1, "", "xx", "a", 0), (2, " \n", None, "b", 3), (None, None, None, None, None)]
    rows += [(3, text(), "xx", "b", 9)] * 3 + [(4, "\n".join(text() for _ in range(300)), "xx", None, 9), (4, text(), "yy", "b", None)]
    taken = ["quality", "n_lines", "N_REMOVED", "cldoc", "fp", "rank", "mix", "mixplan", "mix_shard", "key", "ids", "hash", "node", "u"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in taken})
    stage = cp.STAGES[k][1]
    got = stage(spark, docs, "").collect()
    if k == 0:
        assert sorted((r.doc_id or 0) for r in got) == [0, 3, 3, 3, 4, 4]
    if k == 1:
        assert len(got) == len(rows) and sum(r.text is None for r in got) == 2
    if k == 2:
        assert sorted((r.doc_id or 0, r.text is None) for r in got) == [(0, False), (1, False), (3, False), (4, False), (4, False)]
    if k == 3:
        assert {r.doc_id for r in got if r.text and r.text.strip()} <= {None, 3, 4}
    if k == 4:
        assert len(got) == len(rows) and all(r.text is not None for r in got)
    else:
        assert got[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    assert stage(spark, docs.limit(0), "").count() == 0
