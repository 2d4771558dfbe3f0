import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import mixing as mx


def targets(sizes, repeats=3):
    """Share by weight, take what is over from those above their cap, share it among the rest, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        room = total - sum(capped.values())
        share = {s: room * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: repeats * sizes[s] for s in free if share[s] > repeats * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def corpus(seed, n=1500):
    rng = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "tiny", "void", ""]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60])), "a" if rng.random() < 0.4 else rng.choice(names[:5])) for i in range(n)]
    rows += [(n + i, "x y z", "tiny") for i in range(3)] + [(n + 9, None, "void"), (n + 10, " ", "void"), (n + 11, "one\ntwo", "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_draws(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.draws(df, shards=8).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        m = r.mix
        assert (m.size, m.source_size) == (len((r.text or "").split()), sizes[r.source])
        assert m.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= m.copies <= 3 and len(m.shards) == m.copies and all(0 <= s < 8 for s in m.shards)
        taken[r.source] += m.copies * m.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30, (s, taken[s], want[s])
    again = mx.draws(df.repartition(5), shards=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_are_even_and_hold_the_rows(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix", F.lit("taken name"))
    mixed = mx.mix(df, shards=4)
    assert mixed.columns == df.columns
    parts = mixed.withColumn("p", F.spark_partition_id()).collect()
    want = Counter({r.doc_id: r.mix_.copies for r in mx.draws(df, shards=4).collect()})
    assert Counter(r.doc_id for r in parts) == +want
    by = Counter()
    for r in parts:
        by[r.p] += len((r.text or "").split())
    assert len(by) == 4 and max(by.values()) < 1.3 * min(by.values())


def test_splits_are_hypergeometric(spark):
    tree = spark.createDataFrame([(n, [30, 0, 10]) for n in range(2000)], "node long, quotas array<long>")
    left = [r.quotas for r in mx._split(tree, 5).where("node % 2 = 0").collect()]
    assert all(sum(q) == 20 and q[1] == 0 for q in left)
    mean = sum(q[2] for q in left) / len(left)
    var = sum((q[2] - mean) ** 2 for q in left) / len(left)
    assert mean == pytest.approx(5, abs=0.15) and var == pytest.approx(20 * 0.25 * 0.75 * 20 / 39, rel=0.15)


def test_repeated_rows_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 4 + [(None, None, None)], "doc_id long, text string, source string")
    assert sorted(r.mix.copies * r.mix.size for r in mx.draws(df).collect()) == [0, 2, 2, 2, 2]
    assert mx.draws(df.limit(0)).count() == 0 and mx.mix(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "", "s"), (2, None, "t")], df.schema)
    assert {(r.mix.target, r.mix.copies) for r in mx.draws(nothing).collect()} == {(0.0, 0)}


def test_large_shards_have_parts_and_taken_names_dont_matter(spark):
    rows = corpus(5)
    taken = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = taken.withColumns({c: F.lit(0) for c in ("mixplan", "MixCopy", "mix_order", "mixshard", "mixpart", "mixsource")})
    whole, cut = (mx.mix(df, shards=2, part_words=n) for n in (1 << 24, 3000))
    assert whole.columns == df.columns
    pieces = cut.withColumn("p", F.spark_partition_id()).collect()
    by = Counter()
    for r in pieces:
        by[r.p] += len((r.text or "").split())
    assert len(by) > 8 and max(by.values()) < 4500
    # the same rows in the same order, shard after shard
    ordered = lambda df: [r.doc_id for p in range(df.rdd.getNumPartitions()) for r in df.where(F.spark_partition_id() == p).collect()]
    assert [r.doc_id for r in sorted(pieces, key=lambda r: r.p)] == ordered(whole)
    assert mx.draws(df).columns[-1] == "mix__"


def test_draws_by_an_independent_walk(spark):
    """Blocks, sub-blocks and rows of the last pass, walked in plain Python over the same hashes."""
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = mx._row_hash(42, F.col("doc_id"), F.col("text"))
    hashed = df.select("source", "text", u.alias("u"), mx._part(u).alias("part")).collect()
    got = {(r.u): r.mix for r in mx.draws(df, shards=8).select(u.alias("u"), "mix").collect()}
    sizes = Counter()
    for r in hashed:
        sizes[r.source] += len((r.text or "").split())
    want, total = targets(sizes), sum(sizes.values())
    for s, target in want.items():
        own = {r.u: (len((r.text or "").split()), r.part) for r in hashed if r.source == s}
        passes = min(int(target // sizes[s]), 3) if sizes[s] else 0
        blocks = max(1, int(1024 * sizes[s] / max(total, 1) + 0.5))
        room = target - passes * sizes[s] if passes < 3 else 0.0
        block = lambda u: (u >> 17) % blocks  # noqa: E731, B023
        order = sorted(range(blocks), key=lambda b: spark_hash(spark, s, blocks)[b])
        drawn, left = set(), room
        for b in order if room > 0 else []:
            members = [u for u in own if block(u) == b]
            w = sum(own[u][0] for u in members)
            if w > left:
                for p in sorted({own[u][1] for u in members}):
                    inside = [u for u in members if own[u][1] == p]
                    w = sum(own[u][0] for u in inside)
                    if w > left:
                        for x in sorted(inside):
                            if own[x][0] > left:
                                break
                            drawn.add(x)
                            left -= own[x][0]
                        break
                    drawn |= set(inside)
                    left -= w
                break
            drawn |= set(members)
            left -= w
        while True:  # what is left is made up by rows that fit, by hash
            fits = [u for u in sorted(own) if 0 < own[u][0] <= left and u not in drawn][:256] if room > 0 else []
            if not fits:
                break
            for x in fits:
                if own[x][0] <= left:
                    drawn.add(x)
                    left -= own[x][0]
        near = [(abs(own[u][0] - left), u) for u in own if u not in drawn and own[u][0] and abs(own[u][0] - left) < left and own[u][0] < 2 * left] if room > 0 else []
        if near:
            drawn.add(min(near)[1])
        for x in own:
            assert got[x].copies == passes + (x in drawn), (s, x)


def spark_hash(spark, source, blocks, seen={}):
    """The permutation of a source's blocks, as the plan has it."""
    if (source, blocks) not in seen:
        h = F.xxhash64(F.lit(42), F.lit("block"), F.lit(source).cast("string"), F.col("id"))
        seen[source, blocks] = {r.id: (r.p, r.id) for r in spark.range(blocks).select("id", h.alias("p")).collect()}
    return seen[source, blocks]
