"""The near-dedup stage of the pipeline against brute force over the true similarity of five-word shingles."""

import random
from itertools import combinations

import corpus_pipeline as cp
from chunkloom.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghiklmnorstu", k=rng.randrange(2, 9))) for _ in range(2000)]
    texts = [None, "", " ", "two words", "Two  words"]
    for k in range(60):
        base = rng.choices(words, k=rng.randrange(150, 400))
        texts.append(" ".join(base))
        for _ in range(k % 3 + 1):  # a word in 30 to 70 replaced: 0.65 to 0.9 of the shingles stay shared
            copy = list(base)
            for i in range(rng.randrange(20), len(copy), rng.randrange(30, 70)):
                copy[i] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(words, k=6000))]
    texts += [texts[-1] + " and so on and on"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def kept(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    pairs = [(a, b, jaccard(sets[a], sets[b])) for a, b in combinations(range(len(rows)), 2)]
    for a, b, j in pairs:
        if j >= 0.8 and part[a] != part[b]:
            low, high = sorted((part[a], part[b]))
            part = [low if p == high else p for p in part]
    return sorted(set(part)), pairs


def test_pairs_at_the_similarity_go_and_others_stay(spark):
    rows = corpus()
    want, pairs = kept(rows)
    assert sum(0.8 <= j < 0.85 for *_, j in pairs) > 10 and sum(0.7 <= j < 0.8 for *_, j in pairs) > 10
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect()) == want
    odd = docs.union(docs.where("doc_id < 9"))  # repeated keys
    assert sorted(r.doc_id for r in cp.near_dedup(spark, odd, "").collect()) == want


def test_recall_by_band_of_similarity_in_a_hot_group(spark, capsys):
    """Hundreds of copies of one text, most of them less alike to each other than to it; links found, by true similarity."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghiklmnorstu", k=rng.randrange(2, 9))) for _ in range(3000)]
    rows = [rng.choices(words, k=300) for _ in range(100)]
    base = rng.choices(words, k=300)
    for k in range(300):
        copy = list(base)
        for i in rng.sample(range(300), rng.randrange(2, 18)):
            copy[i] = rng.choice(words)
        rows.append(copy)
    for k in range(60):  # pairs of their own, too
        copy = list(rows[k])
        for i in rng.sample(range(300), rng.randrange(1, 8)):
            copy[i] = rng.choice(words)
        rows.append(copy)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    want, pairs = kept(rows)
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    found = simhash.near_duplicates(docs, shingle=cp.SHINGLE, radius=cp.RADIUS, similarity=cp.SIMILARITY)
    part = {r.doc_id: r.component for r in found.collect()}
    with capsys.disabled():
        print()
        for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
            linked = [part[a] == part[b] for a, b, j in pairs if low <= j < high]
            print(f"similarity {low} to {min(high, 1)}: {sum(linked)} of {len(linked)} pairs in one group")
            assert sum(linked) >= 0.99 * len(linked)
    assert set(want) <= set(part.values()) and len(set(part.values())) <= len(want) + 2  # no unrelated pair in one group
    assert {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()} == set(part.values())


def test_second_level_of_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 20)  # a shard beyond it is dealt anew
    rng = random.Random(3)
    low = [rng.getrandbits(16) for _ in range(3)]
    fps = sorted({(rng.getrandbits(48) << 16 | rng.choice(low)) - (1 << 63) for _ in range(300)})
    fps = sorted({f ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for f in fps[:60]} | set(fps))
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3).collect()
    part = {f: f for f in fps}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for r in links:
        a, b = top(r.u), top(r.v)
        part[max(a, b)] = min(a, b)
    got = {f: top(f) for f in fps}
    part = {f: f for f in fps}
    for a, b in combinations(fps, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 and top(a) != top(b):
            x, y = sorted((top(a), top(b)))
            part[y] = x
    assert got == {f: top(f) for f in fps}
