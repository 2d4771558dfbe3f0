import random
import re

import numpy as np
import pytest
import xxhash

from chunkloom.llm import simhash as sh
from chunkloom.llm.common import text_bytes


def brute_fp(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, n=3, radius=2):
    fps = [brute_fp(t, n) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    keys = {p: min((rows[i][0] for i in range(len(rows)) if parent[i] == p and rows[i][0] is not None), default=None) for p in parent}
    return [(rows[i][0], fps[i], keys[parent[i]]) for i in range(len(rows))]


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß", k=rng.randrange(1, 9))) for _ in range(60)]
    texts = [None, "", " \n\t", "One", "one", "Two words", "x" * 900, "É é"]
    for _ in range(n):
        base = rng.choices(words, k=rng.randrange(1, 300))
        texts.append(rng.choice([" ", "\n", "  "]).join(base))
        if rng.random() < 0.5:
            for _ in range(rng.randrange(1, 4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base).upper())
    return [(i, t) for i, t in enumerate(texts)]


def test_xxh64_of_all_lengths():
    data = np.frombuffer(random.Random(1).randbytes(4000), np.uint8)
    lengths = np.arange(0, 300)
    starts = np.arange(300) * 7
    want = [xxhash.xxh64(data[s : s + n].tobytes(), seed=42).intdigest() for s, n in zip(starts, lengths)]
    assert sh.xxh64(data, starts, lengths).tolist() == want


@pytest.mark.parametrize("n", [3, 5])
def test_fingerprints(n):
    import pyarrow as pa

    rows = corpus()
    assert sh.simhash(*text_bytes(pa.array([t for _, t in rows])), n).tolist() == [brute_fp(t, n) for _, t in rows]


def test_trees_find_all_within_the_radius():
    rng = random.Random(2)
    groups = [sorted({rng.getrandbits(12) for _ in range(n)}) for n in (300, 1, 2, 40)]
    values = np.array([v for g in groups for v in g], np.uint64)
    starts = np.cumsum([0, *map(len, groups)])[:-1]
    group = np.repeat(np.arange(4), [len(g) for g in groups])
    forest = sh.BKForest(values, starts)
    for r in (0, 1, 2, 4):
        got = sorted((int(a), int(b)) for x, y in forest.near(np.arange(len(values)), r) for a, b in zip(x, y))
        d = np.bitwise_count(values[:, None] ^ values[None, :])
        a, b = np.nonzero((d <= r) & (group[:, None] == group[None, :]) & ~np.eye(len(values), dtype=bool))
        assert got == sorted(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("shard", [1000, 2])
def test_components_like_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(sh, "SHARD", shard)
    rows = corpus() + [(None, "Two words"), (5, "One")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, fp int, component int")
    got = sh.near_duplicates(df).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in got), key=key) == sorted(brute_components(rows), key=key)


def test_one_row_of_each_component_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, rank string")
    want = sorted({c for _, _, c in brute_components(rows)})
    assert sorted(r.doc_id for r in sh.drop_near_duplicates(df).collect()) == want
    odd = df.union(df.where("doc_id < 20")).union(spark.createDataFrame([(None, "only here", "y")] * 2, df.schema))
    got = sh.drop_near_duplicates(odd)
    assert got.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == [-1, *want]


def test_empty_table(spark):
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
