"""SimHash near-duplicates: fingerprints of word shingles, linked by radius search in BK-trees.

A BK-tree is searched near its whole width when it holds unrelated fingerprints, and a broadcast one
grows with the corpus. So the fingerprints are dealt into shards that links cannot leave: the bits
are cut into radius + 1 blocks, and two fingerprints that differ in `radius` bits agree in one block at
least (pigeonhole). A shard holds the distinct fingerprints that agree in one block; its tree is built
where the shard lies, in place of a broadcast, and asked for each of its members. A shard that is
still too large is cut anew, by the same rule, over the bits in which its members may differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, fresh, mix64, ragged, slices, small_batches, text_bytes, word_spans
from .graph import components

#: Distinct fingerprints in a shard beyond which it is cut anew, and how often that is done.
SHARD, LEVELS = 2000, 4
#: MinHash bands and the minima in each. Two texts that share 0.8 of their shingles agree in no band once in 14,000 times.
BANDS, ROWS = 24, 5
#: One more of a text's least shingles is asked for with every so many that it has, and two texts must then share the more of these.
MORE = 32

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of data, all spans abreast: one step for each eight bytes of the longest."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    n = len(starts)
    seed, begin = np.uint64(seed), [np.uint64((seed + x) & (1 << 64) - 1) for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
    h = np.full(n, seed + P5, np.uint64)
    at, left = starts.astype(np.int64), lengths.astype(np.int64)
    if len(long := np.flatnonzero(lengths >= 32)):
        order = long[np.argsort(-left[long], kind="stable")]
        acc = [np.full(len(order), x, np.uint64) for x in begin]
        stripes = left[order] // 32
        pos = at[order]
        for k in range(int(stripes[0])):
            m = int(np.searchsorted(-stripes, -k, "left"))
            for j in range(4):
                acc[j][:m] = _round(acc[j][:m], eight[pos[:m] + (32 * k + 8 * j)])
        total = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            total = (total ^ _round(np.zeros_like(a), a)) * P1 + P4
        h[order] = total
        at = at + (lengths // 32) * 32
        left = lengths % 32
    h += lengths.astype(np.uint64)
    for _ in range(3):
        i = np.flatnonzero(left >= 8)
        if len(i):
            h[i] = _rotl(h[i] ^ _round(np.zeros(len(i), np.uint64), eight[at[i]]), 27) * P1 + P4
            at[i] += 8
            left[i] -= 8
    i = np.flatnonzero(left >= 4)
    if len(i):
        h[i] = _rotl(h[i] ^ (four[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
        at[i] += 4
        left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(left > 0)
        if len(i):
            h[i] = _rotl(h[i] ^ (data[at[i]].astype(np.uint64) * P5), 11) * P1
            at[i] += 1
            left[i] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def shingles(raw: np.ndarray, offsets: np.ndarray, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The XXH64 of every shingle, where each row's begin, and the rows that have any."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    starts, stops, words = word_spans(raw, offsets)
    counts = np.diff(words)
    full = np.flatnonzero(counts)
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), full
    keep = np.zeros(len(raw) + 1, np.int8)  # +1 where a word starts, -1 where it stops: its bytes
    keep[starts] += 1
    keep[stops] -= 1
    keep = np.cumsum(keep, dtype=np.int8).astype(bool)[:-1]
    gaps = stops[stops < len(raw)]
    gaps = gaps[~keep[gaps]]
    keep[gaps] = True  # one blank after each word that has any
    text = raw.copy()
    text[gaps] = 0x20
    moved = np.cumsum(keep)
    text = text[keep]
    starts, stops = moved[starts] - 1, moved[stops - 1]
    per = np.maximum(counts[full] - shingle + 1, 1)
    edges = np.cumsum(per) - per
    first = np.repeat(words[full] - edges, per) + np.arange(int(per.sum()))
    last = np.minimum(first + shingle, np.repeat(words[full + 1], per)) - 1
    return xxh64(text, starts[first], stops[last] - starts[first], seed), edges, full


def majority(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bits that more than half of each row's hashes have."""
    per = np.diff(np.append(edges, len(hashes)))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > per[:, None], axis=1).reshape(-1).view(np.uint64)


def simhash(raw: np.ndarray, offsets: np.ndarray, shingle: int, seed: int = 42) -> np.ndarray:
    """The fingerprint of each row of text bytes."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    hashes, edges, full = shingles(raw, offsets, shingle, seed)
    if len(full):
        out[full] = majority(hashes, edges)
    return out


def different(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each row, ascending, and where each row's begin."""
    row = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(hashes))))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(edges)))


def fingerprint(shingle: int = 3, seed: int = 42):
    """A column function: the 64-bit SimHash of a whole text, as a signed number.

    A to Z count as a to z. Words are runs of other than the six ASCII blanks; shingles are `shingle` words
    in a row, repeats counted, joined by one space (a shorter text has one shingle, all its words). A
    bit is set if more than half of the shingles' XXH64 have it. Null, empty and blank texts: zero.
    """

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [simhash(*text_bytes(x.column(0)), shingle, seed) for x in slices(iter([batch]), 0)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return of


def sketch(shingle: int, seed: int = 42):
    """A column function: fp (as fingerprint), n and hash of the set of different shingles, and a hash for each MinHash band.

    Texts without words have n = 0, hash 0 and no bands.
    """
    numbers = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(seed << 20))
    salts, factors = numbers[::2], numbers[1::2] | np.uint64(1)

    @F.arrow_udf("struct<fp:long,n:long,hash:long,bands:array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = []
        for x in slices(iter([batch]), 0):
            hashes, edges, full = shingles(*text_bytes(x.column(0)), shingle, seed)
            rows = x.num_rows
            fp, n, whole, keys = np.zeros(rows, np.uint64), np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                fp[full] = majority(hashes, edges)
                hashes, edges = different(hashes, edges)
                n[full] = np.diff(np.append(edges, len(hashes)))
                whole[full] = np.add.reduceat(mix64(hashes), edges)
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        key = mix64(key * factors[0] ^ np.minimum.reduceat((hashes ^ salts[k]) * factors[k], edges))
                    keys[:, b] = key
            many = np.zeros(rows, np.int64)
            many[full] = BANDS
            offsets = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))
            parts.append(pa.StructArray.from_arrays([pa.array(fp.view(np.int64)), pa.array(n), pa.array(whole.view(np.int64)), bands], ["fp", "n", "hash", "bands"]))
        kind = pa.struct([("fp", pa.int64()), ("n", pa.int64()), ("hash", pa.int64()), ("bands", pa.list_(pa.int64()))])
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return of


def _needed(n, similarity: float):
    """The shingles that a text of n must share with any that is so similar: as many are the least that the larger of two can share."""
    return (n * round(similarity * 1_000_000) + 999_999) // 1_000_000


def least_hashes(shingle: int, similarity: float, seed: int = 42):
    """A column function: node (the hash of sketch), the least hashes of the different shingles, and how many of these a similar text must have, too.

    If two sets share o, the l-th that they share, in any one order, stands among the first |set| - o + l of both. Here o is at least
    _needed of either, and l may grow with the smaller of the two, which has _needed(n) or more itself.
    """

    @F.arrow_udf("struct<node:long,must:int,least:array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        kind = pa.struct([("node", pa.int64()), ("must", pa.int32()), ("least", pa.list_(pa.int64()))])
        parts = []
        for x in slices(iter([batch]), 0):
            hashes, edges, full = shingles(*text_bytes(x.column(0)), shingle, seed)
            node, must, many = np.zeros(x.num_rows, np.int64), np.zeros(x.num_rows, np.int32), np.zeros(x.num_rows, np.int64)
            if len(full):
                hashes, edges = different(hashes, edges)
                n = np.diff(np.append(edges, len(hashes)))
                node[full] = np.add.reduceat(mix64(hashes), edges).view(np.int64)
                needed = _needed(n, similarity)
                must[full] = 1 + needed // MORE
                many[full] = np.minimum(n, n - needed + 1 + n // MORE)
                hashes = hashes[ragged(edges, many[full])]
            least = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(hashes.view(np.int64)))
            parts.append(pa.StructArray.from_arrays([pa.array(node), pa.array(must), least], ["node", "must", "least"]))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return of


def shingle_set(shingle: int, seed: int = 42):
    """A column function: the hashes of the different shingles of a text."""

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = []
        for x in slices(iter([batch]), 0):
            hashes, edges, full = shingles(*text_bytes(x.column(0)), shingle, seed)
            many = np.zeros(x.num_rows, np.int64)
            if len(full):
                hashes, edges = different(hashes, edges)
                many[full] = np.diff(np.append(edges, len(hashes)))
            parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(hashes.view(np.int64))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return of


class BKForest:
    """A BK-tree for each group of different fingerprints: a child hangs from its parent by their Hamming distance.

    values: group after group; starts: where each group starts. All trees grow together, a level a step: of the values
    that go down the same edge, the first becomes its node and the others go on from there.
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        n = len(values)
        self.values = values
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        rest, edges, nodes = np.setdiff1d(np.arange(n), starts), [], []
        at = self.root[rest]
        while len(rest):
            way = at * 65 + np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            ways, first, which = np.unique(way, return_index=True, return_inverse=True)
            edges.append(ways)
            nodes.append(rest[first])
            going = np.ones(len(rest), bool)
            going[first] = False
            rest, at = rest[going], rest[first][which][going]
        edges = np.concatenate([np.zeros(0, np.int64), *edges])
        order = np.argsort(edges)
        self.edges, self.nodes = edges[order], np.concatenate([np.zeros(0, np.int64), *nodes])[order]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, other value of its group within the radius), both by place; only edges that can lead to one are followed."""
        asking, at = queries, self.root[queries]
        while len(asking):
            d = np.bitwise_count(self.values[asking] ^ self.values[at]).astype(np.int64)
            hit = (d <= radius) & (asking != at)
            yield asking[hit], at[hit]
            low = np.searchsorted(self.edges, at * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.edges, at * 65 + np.minimum(d + radius, 64), "right") - low
            asking, at = np.repeat(asking, many), self.nodes[ragged(low, many)]


def tree_links(values: np.ndarray, starts: np.ndarray, radius: int, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each group: a value, and the smallest that links lead to from it."""
    forest = BKForest(values, starts)
    label = np.arange(len(values))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([label[a], label[b]], axis=1), axis=0)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if up:
            move = np.arange(len(values))
            move[list(up)] = [top(x) for x in up]
            label[:] = move[label]

    sizes = np.diff(np.append(starts, len(values)))
    asking = np.arange(len(values))[np.repeat(sizes > 1, sizes)]
    step = max(1, at_once // int(sizes.max(initial=1)))
    for k in range(0, len(asking), step):
        for a, b in forest.near(asking[k : k + step], radius):
            if len(a):
                join(a, b)
    smallest = values.copy()
    np.minimum.at(smallest, label, values)
    linked = np.flatnonzero(smallest[label] != values)
    return values[linked], smallest[label][linked]


def _masks(level: int, radius: int) -> dict[str, int]:
    """The bits that the members of a shard share, by the blocks chosen so far."""
    if level == 0:
        return {"": 0}
    out = {}
    for path, mask in _masks(level - 1, radius).items():
        free = [b for b in range(64) if not mask >> b & 1]
        for j, part in enumerate(np.array_split(free, radius + 1)):
            out[f"{path}{j:x}"] = mask | sum(1 << int(b) for b in part)
    return out


def _dealt(df: DataFrame, level: int, radius: int) -> DataFrame:
    """(path, value, fp): the shards of the next level that each row of the one before it goes to."""
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    masks = _masks(level, radius)
    parts = None
    for parent in _masks(level - 1, radius):
        choice = F.array(*[F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(signed(m)).alias("value")) for p, m in masks.items() if p[:-1] == parent])
        parts = F.when(F.col("path") == parent, choice) if parts is None else parts.when(F.col("path") == parent, choice)
    return df.select("fp", F.explode(parts).alias("x")).select("x.path", "x.value", "fp")


def near_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp) that join all that are within the radius, directly or not."""
    spark = distinct.sparkSession
    small_batches(spark)
    rows = _dealt(distinct.select("fp", F.lit("").alias("path")), 1, radius)
    done = []
    for level in range(2, (LEVELS if radius < 4 else LEVELS - 1) + 1):
        large = rows.groupBy("path", "value").count().where(F.col("count") > SHARD).drop("count")
        if large.isEmpty():
            break
        done.append(rows.join(large, ["path", "value"], "left_anti"))
        rows = Table(_dealt(rows.join(large, ["path", "value"], "left_semi"), level, radius), "shards").df
    for part in done:
        rows = rows.unionByName(part)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(path: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(fp), bool)
            new[1:] = (path[1:] != path[:-1]) | (value[1:] != value[:-1])
            u, v = tree_links(fp.view(np.uint64), np.flatnonzero(new), radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held: list[list[np.ndarray]] = []  # what has come of one group, which may go on in the next batch
        for batch in batches:
            path, value, fp = columns = [c.to_numpy() for c in batch.columns]
            other = np.flatnonzero((path != path[-1]) | (value != value[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or held[-1][0][-1] != path[0] or held[-1][1][-1] != value[0]):
                yield linked(*map(np.concatenate, zip(*held, [c[:cut] for c in columns])))
                held = []
            elif cut:
                yield linked(path[:cut], value[:cut], fp[:cut].copy())
            held.append([c[cut:] for c in columns])
        if held:
            yield linked(*map(np.concatenate, zip(*held)))

    numbered = rows.select(F.xxhash64("path").alias("path"), "value", "fp")
    return numbered.repartition("path", "value").sortWithinPartitions("path", "value", "fp").mapInArrow(work, "u long, v long")


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component) of rows (key, fp): the smallest fingerprint and the smallest key that links lead to."""
    distinct = Table(rows.groupBy("fp").agg(F.min("key").alias("first")), "distinct").df
    roots = components(near_links(distinct, radius)).df
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return linked.join(linked.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "root", "component")


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, similarity: float | None = None, seed: int = 42) -> DataFrame:
    """(key, fp long, component): each row with the smallest key among all rows that links lead to.

    Two rows link if their fingerprints differ in `radius` bits or fewer; all texts without words have
    fingerprint zero and link like others. With a similarity, rows link if they share so much of their different shingles (Jaccard),
    whatever their fingerprints; all texts without words link. Rows come back one for one. Repeated keys are separate
    rows; a null key is never the smallest unless the component has no other (then it is null). Equal
    fingerprints (or sets of shingles) are merged first, so copies cost one row however many there are.
    """
    small_batches(df.sparkSession)
    if similarity is not None:
        named = _sketched(df, key, text, shingle, seed)
        found = _similar(df, named, key, text, shingle, radius, similarity, seed).drop("root")
        return named.select("key", "fp", "node").join(found, "node").select(F.col("key").alias(key), "fp", "component")
    rows = Table(df.select(F.col(key).alias("key"), fingerprint(shingle, seed)(text).alias("fp")), "fingerprints").df
    return rows.join(_classes(rows, radius).drop("root"), "fp").select(F.col("key").alias(key), "fp", "component")


def _sketched(df: DataFrame, key: str, text: str, shingle: int, seed: int) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("text"), sketch(shingle, seed)(text).alias("s"))
    return Table(rows.select("key", "text", F.col("s.hash").alias("node"), "s.n", "s.fp", "s.bands"), "sketches").df


def _sets(df: DataFrame, nodes: DataFrame, wanted: DataFrame, key: str, text: str, shingle: int, seed: int) -> DataFrame:
    """(node, set): the different shingles of the wanted nodes, taken from one text of each."""
    where = nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("place.key").alias("key_"), F.col("place.text").alias("text_"))
    texts = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    found = where.join(texts, F.col("key_").eqNullSafe(F.col("key")) & (F.col("text_") == F.col("hash"))).dropDuplicates(["node"])
    return Table(found.select("node", shingle_set(shingle, seed)("text").alias("set")), "sets").df


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut only where the first column changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        other = np.flatnonzero(columns[0] != columns[0][-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or held[-1][0][-1] != columns[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns])]
            held = []
        elif cut:
            yield [c[:cut] for c in columns]
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def _may_link(df: DataFrame, text: str, shingle: int, similarity: float, seed: int) -> DataFrame:
    """node: those that may be so similar to any other. The rest share too few of their least shingles with all others together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, node, must in _whole_groups(batches):
            once = np.append(True, (hashes[1:] != hashes[:-1]) | (node[1:] != node[:-1]))  # copies of a text count as one
            hashes, node, must = hashes[once], node[once], must[once]
            many = np.diff(np.append(_starts(hashes), len(hashes)))
            met = np.repeat(many > 1, many)
            yield pa.RecordBatch.from_arrays([pa.array(node[met]), pa.array(must[met])], names=["node", "must"])

    rows = df.select(least_hashes(shingle, similarity, seed)(text).alias("s")).select(F.explode("s.least").alias("hash"), "s.node", "s.must")
    met = rows.repartition("hash").sortWithinPartitions("hash", "node").mapInArrow(work, "node long, must int")
    return Table(met.groupBy("node", "must").agg(F.count("*").alias("met")).where("met >= must").select("node"), "alive").df


def _left_pairs(sets: DataFrame, roots: DataFrame, similarity: float, at_once: int = 1 << 20) -> DataFrame:
    """(u, v): the pairs of nodes of different roots that may be so similar, none of those that are left out.

    Only shingles that nodes of different roots have can be shared. Each node's are put in order, the rarest first (others before
    all). The first that two nodes share stands where so many follow in both, itself included, as they must share; so only
    nodes that meet there are paired, each with the larger ones (or as large) of its group that its own place allows.
    """
    s = round(similarity * 1_000_000)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, node, root, n in _whole_groups(batches):
            starts = _starts(hashes)
            many = np.diff(np.append(starts, len(hashes)))
            on = np.repeat(np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts), many)
            times = np.repeat(many, many)
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (hashes, node, root, n, times)], names=["hash", "node", "root", "n", "times"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, n, rest, node, root in _whole_groups(batches):
            starts = _starts(hashes)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes)))) << 32
            largest = np.minimum(n * 1_000_000 // s, rest * (1_000_000 + s) // s - n)
            after = np.arange(1, len(n) + 1)
            many = np.maximum(np.searchsorted(group + n, group + np.maximum(largest, 0), "right") - after, 0)
            asking = np.flatnonzero(many)
            part = np.cumsum(many[asking]) // at_once
            for some in np.split(asking, np.flatnonzero(np.diff(part)) + 1):
                a, b = np.repeat(some, many[some]), ragged(after[some], many[some])
                ok = (root[a] != root[b]) & (rest[b] * (1_000_000 + s) >= s * (n[a] + n[b]))
                pairs = np.unique(np.stack([np.maximum(node[a[ok]], node[b[ok]]), np.minimum(node[a[ok]], node[b[ok]])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    rows = sets.join(roots, "node", "left").select(F.explode("set").alias("hash"), "node", F.coalesce("root", "node").alias("root"), F.size("set").cast("long").alias("n"))
    rows = rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(shared, "hash long, node long, root long, n long, times long")
    own = Window.partitionBy("node")
    rows = rows.withColumns({"many": F.count("*").over(own), "place": F.row_number().over(own.orderBy("times", "hash"))})
    needed = F.expr(f"(n * {s} + 999999) div 1000000")
    rows = rows.withColumn("rest", F.col("many") - F.col("place") + 1).where(F.col("rest") >= needed)  # those from the place on
    rows = rows.select("hash", "n", "rest", "node", "root").repartition("hash").sortWithinPartitions("hash", "n")
    return Table(rows.mapInArrow(paired, "u long, v long").distinct(), "left").df


def _same_shingles(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes that share so much of their shingles, counted on the shingles themselves."""
    u, v = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "uv")
    shared = F.size(F.array_intersect("set_u", "set_v")).cast("long")
    # in whole numbers where similarity is a decimal of up to six digits
    enough = shared * 1_000_000 >= (F.size("set_u") + F.size("set_v") - shared) * F.lit(round(similarity * 1_000_000)).cast("long")
    return Table(pairs.join(u, "u").join(v, "v").where(enough).select("u", "v"), "similar").df


def _similar(df: DataFrame, rows: DataFrame, key: str, text: str, shingle: int, radius: int, similarity: float, seed: int) -> DataFrame:
    """(node, root, component) of rows (key, text, node, n, fp, bands): what links of at least that similarity join.

    Candidates are the links of SimHash within the radius, and texts that agree in a MinHash band; only what the shingles
    themselves confirm is a link. A band isn't searched pair by pair: its members are held against one of them, those that
    aren't joined to it yet in the next round against another, until a round finds no link. First comes the member that
    meets most others in all its bands, as the text that copies were made from does. These rounds join most, not all; every pair
    that is left in two components and may be so similar is held against each other at the end, so no link is lost.
    """
    least = F.min(F.struct("key", "text"))
    nodes = rows.groupBy("node").agg(F.min("key").alias("first"), least.alias("place"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = Table(nodes, "nodes").df
    fps = Table(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("top")), "distinct").df
    by_bits = near_links(fps.select("fp"), radius)
    tops = [fps.select(F.col("fp").alias(x), F.col("top").alias(f"top_{x}")) for x in "uv"]
    by_bits = by_bits.join(tops[0], "u").join(tops[1], "v").select(F.col("top_u").alias("u"), F.col("top_v").alias("v"))
    equal_bits = nodes.where("n > 0").join(fps, "fp").select(F.col("node").alias("u"), F.col("top").alias("v"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    tried = Table(ordered(by_bits.unionByName(equal_bits)), "pairs").df
    alive = _may_link(df, text, shingle, similarity, seed)
    banded = nodes.join(alive, "node", "left_semi").select("node", "n", F.explode("bands").alias("band"))
    several = Table(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "several").df
    banded = Table(banded.join(several, "band"), "bands").df
    banded = banded.join(banded.groupBy("node").agg(F.sum("m").alias("meets")), "node").drop("m")
    sets = _sets(df, nodes, alive, key, text, shingle, seed)
    roots, turn = components(_same_shingles(tried, sets, similarity)).df, 0
    while True:
        named = Table(banded.join(roots, "node", "left").select("band", "node", "n", "meets", F.coalesce("root", "node").alias("root")), "named")
        rank = F.xxhash64(F.lit(turn), "band", "node") if turn else F.col("meets")
        centre = F.max(F.struct(rank.alias("rank"), "node", "n", "root")).alias("c")
        centres = named.df.groupBy("band").agg(centre, F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band", "c")
        centres = Table(centres, "centres")  # so that both sides of the join are exchanged anew, and a hot band can be split
        alike = F.least("n", "c.n") >= similarity * F.greatest("n", "c.n") - 1e-6
        pairs = named.df.join(centres.df, "band").where((F.col("root") != F.col("c.root")) & alike).select(F.col("node").alias("u"), F.col("c.node").alias("v"))
        pairs = Table(ordered(pairs).join(tried, ["u", "v"], "left_anti"), "pairs").df
        new = _same_shingles(pairs, sets, similarity)
        named.drop()
        centres.drop()
        turn += 1
        if not new.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new)).df
        elif turn > 1:
            break
        tried = tried.unionByName(pairs)
    new = _same_shingles(_left_pairs(sets, roots, similarity), sets, similarity)
    if not new.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new)).df
    linked = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    return linked.join(linked.groupBy("root").agg(F.min("first").alias("component")), "root").select("node", "root", "component")


def drop_near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, similarity: float | None = None, seed: int = 42) -> DataFrame:
    """One row of each component of near_duplicates: that of the smallest key (all columns as they were).

    Where some keys are null or repeated, the row with the smallest key (null last), then
    the smallest hash of its text stays, and one of several equal rows.
    """
    small_batches(df.sparkSession)
    if similarity is None:
        node = fingerprint(shingle, seed)
        rows = Table(df.select(F.col(key).alias("key"), node(text).alias("fp")), "fingerprints").df
        found = lambda: _classes(rows, radius).withColumnRenamed("fp", "node")
        named = rows.withColumnRenamed("fp", "node")
    else:
        node = lambda t: sketch(shingle, seed)(t)["hash"]
        named = _sketched(df, key, text, shingle, seed)
        found = lambda: _similar(df, named, key, text, shingle, radius, similarity, seed)
    if named.agg(F.count("*") == F.count_distinct("key")).first()[0]:
        keep = named.select("key", "node").join(found(), "node").where("key = component").select(F.col("key").alias(key))
        return df.join(keep, key, "left_semi").select(*df.columns)
    name, rank = fresh(df, "fp"), fresh(df, "rank")
    classes = found().select(F.col("node").alias(name), F.col("root").alias(rank))
    order = Window.partitionBy(rank).orderBy(F.col(key).asc_nulls_last(), F.xxhash64(text))
    marked = df.withColumn(name, node(text)).join(classes, name)
    return marked.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*df.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
