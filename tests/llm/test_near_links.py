"""Near-dedup by shingle similarity loses no link: classes are those of all pairs, by brute force."""

import random
from itertools import combinations

import pytest

import corpus_pipeline as cp
from chunkloom.llm import simhash
from tests.llm.test_near_copies import jaccard, shingles


def classes(rows, similarity):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if part[a] != part[b] and jaccard(sets[a], sets[b]) >= similarity:
            low, high = sorted((part[a], part[b]))
            part = [low if p == high else p for p in part]
    return dict(zip((i for i, _ in rows), part))


def hot_group(rng, words, copies, most):
    """Copies of one text, which isn't there itself; many are just alike enough to one or two of the others."""
    base, out = rng.choices(words, k=300), []
    for _ in range(copies):
        copy = list(base)
        for i in rng.sample(range(300), rng.randrange(most // 3, most)):
            copy[i] = rng.choice(words)
        out.append(copy[rng.randrange(20) :])
    return out


@pytest.mark.parametrize("similarity, most", [(0.8, 12), (0.6, 24)])
def test_no_link_is_lost(spark, similarity, most):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghiklmnorstu", k=rng.randrange(2, 9))) for _ in range(3000)]
    texts = [None, "", " \n"]
    texts += [" ".join(x) for _ in range(2) for x in hot_group(rng, words, 150, most)]
    often = rng.choices(words, k=30)  # a passage that unrelated texts share
    texts += [" ".join(rng.choices(words, k=rng.randrange(200)) + often) for _ in range(60)]
    texts += [" ".join(rng.choices(words[:3], k=rng.randrange(1, 12))) for _ in range(80)]  # of one shingle to eight
    texts += texts[3:20]  # exact copies
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs, shingle=cp.SHINGLE, radius=cp.RADIUS, similarity=similarity)
    assert {r.doc_id: r.component for r in found.collect()} == classes(rows, similarity)


def test_texts_that_may_link(spark):
    """None that has a partner is left out, however long; most that share a little with others are."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghiklmnorstu", k=rng.randrange(2, 9))) for _ in range(3000)]
    often, texts = rng.choices(words, k=30), []
    for n in (1, 3, 5, 9, 40, 200, 900, 3000) * 3:  # pairs, the smaller as small as it may be
        longer = rng.choices(words, k=n)
        texts += [longer, longer[: max(min(n, 5), n - (n - 4) // 5)]]
    planted = len(texts)
    texts += [rng.choices(words, k=300) + often for _ in range(100)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    alive = simhash._may_link(docs, "text", 5, 0.8, 42)
    nodes = docs.select("doc_id", simhash.sketch(5)("text")["hash"].alias("node")).join(alive, "node").collect()
    sets = [shingles(" ".join(t)) for t in texts]
    linked = {x for a, b in combinations(range(planted), 2) if a // 2 == b // 2 and sets[a] != sets[b] and jaccard(sets[a], sets[b]) >= 0.8 for x in (a, b)}
    got = {r.doc_id for r in nodes}
    assert len(linked) >= 18 and linked <= got and sum(i >= planted for i in got) < 20
