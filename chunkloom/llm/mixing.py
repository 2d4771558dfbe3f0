"""Mixing sources to target weights: exact block quotas, split over output shards by a hypergeometric tree.

1. Targets. Sources share the words of the mix by weight; a source stops at REPEATS times its own words, and
   what is over is shared by weight among the others.
2. Blocks. A source is cut into blocks of about equal words by a hash of its rows. Its target is so many whole
   passes over all blocks, and a part of one more: blocks in a permuted order until the next doesn't fit, of that
   block sub-blocks, and of that sub-block rows.
   What is then missing is made up by rows not drawn in that pass: all that fit, then the one whose size is nearest to what is left.
3. Quotas. A source has as many tickets as it draws blocks. A binary tree deals all tickets to the shards: each node halves
   its number of tickets, and how many of each source go left is a multivariate hypergeometric draw.
4. Draws. Shard k takes, of each source, the tickets after those of shards before it: disjoint stretches of
   the permuted blocks, pass after pass. Each shard is shuffled where it lies, a large one in parts: stretches of its random order.

A row is drawn by its hash and its source's plan alone, so documents are joined with nothing but one row for each source.
All of it is column expressions; the same rows and seed give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Table, fresh_root, let

#: Weights by the sources' order, most passes over a row, blocks of all sources (each has one at least), sub-blocks of a block, shards.
WEIGHTS, REPEATS, BLOCKS, PARTS, SHARDS = (5, 2, 1), 3, 1024, 1024, 16
#: Sources up to which their plans (with BLOCKS entries in all, and one each at least) are broadcast.
BROADCAST = 50_000
#: Rows of a source that are tried at a time to make up the rest of its target. Words that a task shuffles (more, beyond so many tasks).
TOPS, PART_WORDS, TASKS = 256, 1 << 22, 1 << 18


def n_words(text: Column) -> Column:
    """Runs of other than the six ASCII blanks; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(source, rank, source_size, target): sources by code point, null last; a row for each source is all that is sorted."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.select("source", "source_size", (F.row_number().over(order) - 1).alias("rank"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    caps = ranked.select("*", weight.alias("weight"), (F.col("source_size") * repeats).alias("cap"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    capped = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - capped("cap")) / (F.sum("weight").over(everything) - capped("weight"))
    filled = caps.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "level"))
    filled = filled.withColumn("level", F.min(fits).over(everything)["level"])
    return filled.select("source", "rank", "source_size", F.least(F.coalesce(F.col("weight") * F.col("level"), F.col("cap")), F.col("cap").cast("double")).alias("target"))


def _stop(parts: Column, room: Column) -> Column:
    """Walk over (order..., at, w) until the words don't fit: full (how many do), before (their words), at and last taken at."""
    start = F.struct(F.lit(0).alias("full"), F.lit(0.0).alias("before"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        more = acc["before"] + x["w"]
        over = more > room
        on = F.struct((acc["full"] + 1).alias("full"), more.alias("before"), F.lit(None).cast("long").alias("at"), x["at"].alias("last"))
        end = F.struct(acc["full"].alias("full"), acc["before"].alias("before"), x["at"].alias("at"), acc["last"].alias("last"))
        return F.when(acc["at"].isNotNull(), acc).when(over, end).otherwise(on)

    return F.aggregate(parts, start, step)


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null with null."""
    b = b.withColumnRenamed("source", "source_")
    return a.join(b, F.col("source").eqNullSafe(F.col("source_")), how).drop("source_")


def _row_hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _block(u: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftright(u, 17), blocks)


def _part(u: Column) -> Column:
    return F.pmod(F.xxhash64(u), F.lit(PARTS)).cast("long")


def _split(tree: DataFrame, seed: int) -> DataFrame:
    """The children of each node (node, quotas): halves of its tickets, drawn without replacement."""

    def chance(node: Column, left: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("tree"), node, left), 11) / float(1 << 53)

    def draw(node: Column, quotas: Column, total: Column) -> Column:
        def ticket(acc: Column, _: Column) -> Column:  # selection sampling: each ticket with what is still to be chosen, of what is left
            take = F.when(chance(node, acc["left"]) * acc["left"] < acc["need"], 1).otherwise(0)
            return F.struct((acc["need"] - take).alias("need"), (acc["left"] - 1).alias("left"), (acc["got"] + take).alias("got"))

        def source(acc: Column, q: Column) -> Column:
            begin = F.struct(acc["need"].alias("need"), acc["left"].alias("left"), F.lit(0).cast("long").alias("got"))
            tickets = F.when(q > 0, F.sequence(F.lit(1).cast("long"), q)).otherwise(F.array().cast("array<long>"))
            end = F.aggregate(tickets, begin, ticket)
            return let(end, lambda e: F.struct(e["need"].alias("need"), e["left"].alias("left"), F.concat(acc["out"], F.array(e["got"])).alias("out")))

        start = F.struct(F.floor(total / 2).cast("long").alias("need"), total.alias("left"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(quotas, start, source, lambda acc: acc["out"])

    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
    halves = tree.withColumn("left", let(total, lambda n: draw(F.col("node"), F.col("quotas"), n)))
    right = F.zip_with("quotas", "left", lambda q, x: q - x)
    children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
    return halves.select(F.explode(children).alias("x")).select("x.*")


def _extra(p, u: Column) -> Column:
    """Whether a row of hash u is in the last, partial pass; p gives the fields of its source's plan."""
    block = _block(u, p("blocks"))
    rank, part = F.get(p("ranks"), block.cast("int")), _part(u)
    here = (p("block") == block) & (p("part").isNull() | (part < p("part")) | ((part == p("part")) & (u <= p("last"))))
    return (p("room") > 0) & ((rank < p("full")) | F.coalesce(here, F.lit(False)))


def plan(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """One row for each source of rows (source, size, u): its targets, where its draws stop, and its tickets' shards."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = _targets(sources, weights, repeats)
    total = F.sum("source_size").over(Window.partitionBy())
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    blocks = F.greatest(F.lit(1), F.round(F.lit(BLOCKS) * F.col("source_size") / F.greatest(total, F.lit(1)))).cast("int")
    base = targets.select("*", F.least(passes, F.lit(repeats)).alias("passes"), blocks.alias("blocks"))
    base = Table(base.withColumn("room", F.when(F.col("passes") < repeats, F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))).otherwise(0.0)), "targets").df
    # permuted blocks, and the one where the last pass stops
    placed = _same(sized, base.select("source", "blocks"))
    sums = placed.groupBy("source", _block(F.col("u"), F.col("blocks")).cast("long").alias("at")).agg(F.sum("size").alias("w")).withColumnRenamed("source", "source_")
    every = base.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("at_"))
    each = every.join(sums, F.col("source").eqNullSafe(F.col("source_")) & (F.col("at_") == F.col("at")), "left")
    entry = F.struct(F.xxhash64(F.lit(seed), F.lit("block"), "source", "at_").alias("p"), F.col("at_").alias("at"), F.coalesce("w", F.lit(0)).cast("double").alias("w"))
    permuted = each.groupBy("source").agg(F.sort_array(F.collect_list(entry)).alias("parts"))
    ranks = F.transform(F.sort_array(F.transform("parts", lambda x, i: F.struct(x["at"].alias("at"), i.alias("i")))), lambda x: x["i"])
    one = _same(base, permuted).withColumn("stop", _stop(F.col("parts"), F.col("room"))).withColumn("ranks", ranks).drop("parts")
    one = Table(one.select("*", F.col("stop.full").alias("full"), F.col("stop.at").alias("block"), (F.col("room") - F.col("stop.before")).alias("room1")).drop("stop"), "blocks").df
    # sub-blocks of that block, rows of that sub-block
    inside = _same(sized, one.where("room > 0").select("source", "blocks", "block", "room1")).where(_block(F.col("u"), F.col("blocks")) == F.col("block"))
    parts = inside.groupBy("source", _part(F.col("u")).alias("at")).agg(F.sum("size").cast("double").alias("w"), F.first("room1").alias("room1"))
    two = parts.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("parts"), F.first("room1").alias("room1"))
    two = two.withColumn("stop", _stop(F.col("parts"), F.col("room1"))).select("source", F.col("stop.at").alias("part"), (F.col("room1") - F.col("stop.before")).alias("room2"))
    two = Table(two, "parts").df
    last = _same(inside.select("source", "u", "size"), two).where(_part(F.col("u")) == F.col("part"))
    rows = last.groupBy("source", F.col("u").alias("at")).agg(F.sum("size").cast("double").alias("w"), F.first("room2").alias("room2"))
    three = rows.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("parts"), F.first("room2").alias("room2"))
    three = three.withColumn("stop", _stop(F.col("parts"), F.col("room2"))).select("source", F.col("stop.last").alias("last"), (F.col("room2") - F.col("stop.before")).alias("room3"))
    drawn = _same(_same(one, two, "left"), three, "left").withColumn("rest", F.coalesce("room3", "room2", "room1"))
    drawn = Table(drawn.drop("room1", "room2", "room3"), "draws").df
    # rows to make up the rest: those that fit, by hash, then the one nearest to what is left
    def not_drawn(now: DataFrame) -> DataFrame:
        free = _same(sized.where("size > 0"), now.where("rest > 0")).where("size < 2 * rest").where(~_extra(F.col, F.col("u")))
        free = free.where(~F.array_contains("tops", F.col("u")))
        return free.groupBy("source", "u").agg(F.sum("size").cast("double").alias("w"), F.first("rest").alias("rest"))

    now = Table(drawn.withColumn("tops", F.array().cast("array<long>")), "draws").df
    while True:
        by_hash = Window.partitionBy("source").orderBy("u")
        fits = not_drawn(now).where("w <= rest").withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= TOPS)
        fits = Table(fits.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("u", "w"))).alias("fits")), "fits").df
        if fits.isEmpty():
            break
        start = F.struct(F.col("tops").alias("tops"), F.col("rest").alias("rest"))
        take = lambda acc, x: F.when(x["w"] <= acc["rest"], F.struct(F.array_append(acc["tops"], x["u"]).alias("tops"), (acc["rest"] - x["w"]).alias("rest"))).otherwise(acc)
        filled = _same(now, fits, "left").withColumn("x", F.when(F.col("fits").isNull(), start).otherwise(F.aggregate("fits", start, take)))
        now = Table(filled.withColumn("tops", F.col("x.tops")).withColumn("rest", F.col("x.rest")).drop("x", "fits"), "draws").df
    left = not_drawn(now).where("abs(w - rest) < rest")
    nearest = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("w") - F.col("rest")).alias("d"), "u")).alias("x")).select("source", F.array("x.u").alias("top"))
    whole = _same(now, nearest, "left").withColumn("tops", F.when(F.col("top").isNull(), F.col("tops")).otherwise(F.concat("tops", "top"))).drop("top")
    whole = Table(whole, "draws").df
    # tickets and the tree
    begun = F.col("full") + F.when(F.col("block").isNull(), 0).otherwise(1)
    tickets = F.col("passes") * F.col("blocks") + F.when(F.col("room") > 0, F.greatest(begun, F.lit(1))).otherwise(0)
    root = whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", tickets.cast("long").alias("q")))), lambda x: x["q"]).alias("quotas"))
    tree = root.select(F.lit(1).cast("long").alias("node"), "quotas")
    for _ in range((shards - 1).bit_length()):
        tree = _split(tree, seed)
    leaves = tree.select("node", F.posexplode("quotas").alias("rank", "q")).groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("node", "q"))).alias("leaves"))
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(acc, -1), F.lit(0).cast("long")) + x["q"]))
    ends = leaves.select("rank", F.aggregate("leaves", F.array().cast("array<long>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x["q"])).otherwise(add(acc, x))).alias("ends"))
    return Table(whole.join(ends, "rank"), "plan").df


def _planned(df: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], repeats: int, shards: int, seed: int) -> DataFrame:
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    sized = df.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"), _row_hash(seed, F.col(key), F.col(text)).alias("u"))
    return plan(Table(sized, "sized").df, weights=weights, repeats=repeats, shards=shards, seed=seed)


ENDINGS = ("plan", "source", "copy", "shard", "part", "order")


def draws(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, shards: int = SHARDS, seed: int = 42, into: str = "mix") -> DataFrame:
    """The table with a struct `into` (underscores if taken): size, source_size, target, copies, shards (of each copy).

    size: words of the text. copies: how often the mix takes the row, from 0 to `repeats`. Null is a source like others, the last one. A source
    without words has target 0 and isn't taken; a row without words may be. Equal rows share one hash and are drawn alike. shards must be a power of two.
    """
    return _drawn(df, _planned(df, key, text, source, weights, repeats, shards, seed), fresh_root(df, into, *ENDINGS), key, text, source, seed)


def _drawn(df: DataFrame, found: DataFrame, name: str, key: str, text: str, source: str, seed: int) -> DataFrame:
    found = found.select(F.struct(*[c for c in found.columns if c != "source"]).alias(f"{name}plan"), F.col("source").alias(f"{name}source"))
    if found.count() <= BROADCAST:
        found = F.broadcast(found)
    joined = df.join(found, F.col(source).eqNullSafe(F.col(f"{name}source")))
    p, u = F.col(f"{name}plan"), _row_hash(seed, F.col(key), F.col(text))

    def drawn(u: Column) -> Column:
        rank = F.get(p["ranks"], _block(u, p["blocks"]).cast("int"))
        top = F.array_contains(p["tops"], u)
        copies = p["passes"] + (_extra(lambda c: p[c], u) | top).cast("int")
        last = F.coalesce(F.element_at(p["ends"], -1), F.lit(0)) - 1
        ticket = lambda j: F.least(j * p["blocks"] + rank, last)  # noqa: E731  the rows that make up the rest go with the last ticket
        shard = lambda t: F.size(F.filter(p["ends"], lambda e: e <= t))
        where = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), lambda j: shard(ticket(j)))).otherwise(F.array().cast("array<int>"))
        return F.struct(n_words(F.col(text)).alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), copies.alias("copies"), where.alias("shards"))

    return joined.select(*[F.col(f"`{c}`") for c in df.columns], let(u, drawn).alias(name))


def mix(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, shards: int = SHARDS, seed: int = 42, part_words: int = PART_WORDS) -> DataFrame:
    """The mixed rows, each as often as it is drawn (columns as they were), shard after shard, shuffled within each.

    A shard has as many partitions as its words ask for at `part_words` each (but no more than TASKS in all), so none grows with the
    input: a row's place in the shard's order is random, and each partition is a stretch of that order. Rows are drawn as draws() says.
    """
    found = _planned(df, key, text, source, weights, repeats, shards, seed)
    words = found.agg(F.sum("target")).first()[0] or 0
    parts = max(1, min(-(-int(words) // (shards * part_words)), TASKS // shards))
    name = fresh_root(df, "mix", *ENDINGS)
    drawn = _drawn(df, found, name, key, text, source, seed)
    copies = drawn.where(F.col(name)["copies"] > 0).select("*", F.posexplode(F.col(name)["shards"]).alias(f"{name}copy", f"{name}shard"))
    order = F.xxhash64(F.lit(seed), F.lit("order"), F.col(key), F.col(f"{name}copy"), F.xxhash64(text))
    stretch = F.floor((F.shiftright(F.col(f"{name}order"), 32) + F.lit(1 << 31)) * F.lit(parts).cast("long") / float(1 << 32))
    part = (F.col(f"{name}shard") * parts + F.least(stretch, F.lit(parts - 1))).cast("int")
    placed = copies.withColumn(f"{name}order", order).withColumn(f"{name}part", part).repartitionById(shards * parts, F.col(f"{name}part"))
    return placed.sortWithinPartitions(f"{name}order").select(*[F.col(f"`{c}`") for c in df.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    found = draws(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    m = F.col("mix")
    return found.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["copies"] * m["size"]).alias("taken"), m["copies"].alias("copies"), F.array_join(m["shards"], ",").alias("shards"))
