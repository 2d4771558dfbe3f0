import random

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import lines as ln


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """rows with different keys"""
    seen, out = [], []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept, n, gone = [], 0, 0
        for line in (text or "").split("\n"):
            if not line.strip(" \t\n\r\x0b\x0c"):
                kept.append(line)
                continue
            n += 1
            if any(near(line, x) for x in seen):
                gone += 1
            else:
                kept.append(line)
            seen.append(line)
        out.append((key, None if text is None else "\n".join(kept), n, gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé 日") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 18, 20, 24, 30, 47, 48, 49, 120]))) for _ in range(25)] + ["a" * n for n in (1, 2, 4, 19, 20, 21, 22, 40, 41)]

    def edit(x):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(x) + 1)
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("abz") + x[i:], x[:i] + rng.choice("abz") + x[i + 1 :]])
        return x

    rows = [(0, None), (1, ""), (2, "\n \n"), (3, "x\nx\n\nx")]
    return rows + [(i if i != 30 else None, "\n".join(edit(rng.choice(base)) for _ in range(rng.randrange(1, 12)))) for i in range(4, 60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, n_lines string").repartition(3)
    got = ln.drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_removed"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.text, r.n_lines_, r.n_removed) for r in got.collect()], key=key) == brute(rows)


def test_equal_rows_keep_the_same_lines(spark):
    df = spark.createDataFrame([(1, "one line\ntwo"), (1, "one line\ntwo"), (2, "two\nthree" * 9000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in ln.drop_repeated_lines(df).collect()) == [(1, 0), (1, 0), (2, 8999)]


def test_empty_table(spark):
    assert ln.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_of_other_types_and_clashing_names(spark):
    rows = [("b", "same line here\nx y"), ("a", "same line here"), (None, "same line here\nother"), ("", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(1) for c in ("cldoc", "CLrow", "cl_drop")})
    got = ln.drop_repeated_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert {(r.doc_id, r.text) for r in got.collect()} == {("b", "x y"), ("a", "same line here"), (None, "other"), ("", None)}
