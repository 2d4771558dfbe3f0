import random
import re

import pytest

from chunkloom.llm import substrings as ss

W, G = 12, 4


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [float("inf") if k is None else k for k, _ in rows]
    first = {}
    for k, w in zip(order, words):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, k), k)
    out = []
    for (key, _), k, w in zip(rows, order, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, vocabulary, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(vocabulary)
    shared = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    rows = [(None, None), (-1, ""), (500, " \n "), (501, "one")]
    for i in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [word() for _ in range(rng.randrange(0, 25))]
            if rng.random() < 0.6:
                w += rng.choice(shared)
        if rng.random() < 0.2 and len(rows) > 6:
            w = rng.choice(rows[4:])[1].split()
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = word()
        rows.append((rng.choice([i, i, i, None, i - 1]), rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + rows[10:14]


@pytest.mark.parametrize("tree", [20_000, 3])
@pytest.mark.parametrize("seed,vocabulary", [(1, ["a", "b"]), (2, [f"wört{i}" for i in range(40)]), (3, ["x"]), (4, list("abcdefgh"))])
def test_like_brute_force(spark, monkeypatch, tree, seed, vocabulary):
    monkeypatch.setattr(ss, "TREE", tree)
    rows = corpus(seed, vocabulary)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, row int")
    key = lambda x: (str(x[0]), *x[1:])
    got = [tuple(r) for r in ss.drop_repeats(df, window=W, gram=G).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, W), key=key)


def test_windows_of_fifty_words_and_a_long_text(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, short = text(50), text(49)
    rows = [(1, f"{text(30)} {passage} {text(30)}"), (2, f"{text(9)} {passage}"), (3, f"{short} {text(20)}"), (4, f"{text(70)} {short}"), (5, text(40_000))]
    rows.append((6, rows[4][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ss.drop_repeats(df).collect())) == sorted(brute(rows, 50))


def test_empty_table(spark):
    assert ss.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_of_other_types(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [("b", f"x {text}"), ("a", f"{text} y"), (None, text), ("", "short")]
    got = {r.doc_id: r.n_removed for r in ss.drop_repeats(spark.createDataFrame(rows, "doc_id string, text string"), window=W, gram=G).collect()}
    assert got == {"b": 20, "a": 0, None: 20, "": 0}
