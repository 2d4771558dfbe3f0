import math
import random

import numpy as np
import pytest
from pyspark.sql.functions import lit

from chunkloom.llm import topk


def brute(rows, queries, k):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in ok if i in queries}):
        found = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def vectors(seed, n=300, dims=12, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, rng.gauss(0, scale)]) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[20][1]) for i in range(30)] + [(n + 40, [0.0] * dims), (n + 41, []), (n + 42, [1.0, -1.0])]
    rows += [(None, rows[1][1]), (n + 50, None), (n + 60, [None] * dims), (n + 80, [float("nan")] * dims), (n + 100, [float("inf")] * dims)]
    return rows + rows[18:24]


@pytest.mark.parametrize("seed,scale,most", [(1, 1.0, 1 << 16), (2, 300.0, 40), (3, 1e5, 40)])
def test_like_brute_force(spark, monkeypatch, seed, scale, most):
    monkeypatch.setattr(topk, "ROWS", most)
    monkeypatch.setattr(topk, "QUERIES", min(most, 7))
    rows = vectors(seed, scale=scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 20)
    want = brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    assert sorted(map(tuple, got.collect())) == want


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 20 = 0"), 20).collect())) == [(0, 1, 1, 8192), (0, 2, 20, -4096), (20, 1, 0, -4096), (20, 2, 1, -8192)]
    assert topk.top_k(df.limit(0), df.limit(0), 20).count() == 0


def test_scores_that_do_not_fit_are_an_error():
    big = np.full((2, 2), 1 << 40)
    with pytest.raises(OverflowError):
        list(topk.best_of_block(np.array([1, 2]), big, np.array([5]), big[:1], 3))


def test_clashing_columns(spark):
    rows = vectors(4, n=60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    extra = df.withColumns({c: lit("x") for c in ("id", "v", "bucket", "score", "rank", "query_id", "cids")})
    run = lambda df: sorted(map(tuple, topk.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()))
    assert run(extra) == run(df)


def test_huge_components(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits|out of range|OVERFLOW"):
        topk.top_k(df, df.where("vec_id = 0"), 5).collect()
