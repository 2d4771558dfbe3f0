"""Substring deduplication: repeats of WINDOW words, found in suffix trees that are split by prefixes.

Not every suffix is needed. Of the GRAM-word prefixes that start in a window, the one with the least hash (the first, if
several) is the window's anchor; equal windows have equal anchors at equal places, so a repeat is
seen from suffixes that start at anchors, about one in twenty. A suffix comes with the words before it that windows
around its anchor can reach.

1. Suffixes with the same words around are merged to one, with the smallest document; copies end here.
2. Suffixes are split by prefix. A prefix that only one document has is dropped.
3. A group that fits in memory becomes a suffix tree of the words from the anchor on, and one of the words
   before it, read backwards. Each tree is kept as the sorted order with the longest common prefixes of
   neighbours: its nodes at depth d are the runs whose common prefixes are d or longer. A node of
   depth r of the first and one of depth WINDOW - r of the second meet in the suffixes that share a window.
4. A group that doesn't fit is split by longer prefixes: one for each place of the anchor in the window, as long as the window.
   What shares such a prefix needs no tree: only its smallest document counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, binary_rows, gram_hashes, mix64, ragged, run_hashes, run_sums, slices, small_batches, span_hashes, text_bytes, with_place, word_spans

#: Words in a repeat, words in an anchor, suffixes in a tree.
WINDOW, GRAM, TREE = 50, 8, 20_000


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all rows, and the words before each row."""
    raw, offsets = text_bytes(column)
    starts, stops, edges = word_spans(raw, offsets)
    return span_hashes(raw, starts, stops), edges


def anchors(words: np.ndarray, edges: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows that lie in one row, and the hashes of their prefixes."""
    grams = gram_hashes(words, gram)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = window - gram + 1
    low, at, have = grams, np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        later = low[step:] < low[: len(low) - step]
        low, at = np.where(later, low[step:], low[: len(low) - step]), np.where(later, at[step:], at[: len(at) - step])
        have += step
    sizes = np.diff(edges)
    starts = ragged(edges[:-1], np.maximum(sizes - window + 1, 0))
    places = np.unique(at[starts])
    return places, grams[places]


def around(words: np.ndarray, edges: np.ndarray, places: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words of its row, up to what windows around it reach, lie before each place and from it on."""
    row = np.searchsorted(edges, places, "right") - 1
    return np.minimum(places - edges[row], window - gram), np.minimum(edges[row + 1] - places, window)


def shared_by_earlier(right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes of whole groups, the least and most words from the anchor on, in windows that a smaller document shares; 0: none.

    right: words from the anchor on; left: words before it, backwards; a row each, padded.
    """
    n = len(doc)

    def tree(rows: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in order, and the common prefix of each with the one before it."""
        order = np.argsort(np.ascontiguousarray(rows.astype(">u8")).view(f"V{8 * rows.shape[1]}").reshape(-1), kind="stable")
        a, b = rows[order[1:]], rows[order[:-1]]
        differ = np.concatenate([a != b, np.ones((len(a), 1), bool)], axis=1)
        common = np.minimum(differ.argmax(axis=1), np.minimum(have[order[1:]], have[order[:-1]]))
        return order, common

    def nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.concatenate([[0], np.cumsum(common < depth)])
        return out

    forward, backward = tree(right, n_right), tree(left, n_left)
    least, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in range(gram, window + 1):
        i = np.flatnonzero((n_right >= r) & (n_left >= window - r))
        if len(i) < 2:
            continue
        both = nodes(*forward, r)[i] * n + (nodes(*backward, window - r)[i] if r < window else 0)
        order = np.lexsort((doc[i], both))
        first = np.ones(len(i), bool)
        first[1:] = both[order[1:]] != both[order[:-1]]
        smallest = doc[i][order][np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))]
        late = i[order[doc[i][order] > smallest]]
        least[late] = np.where(least[late] == 0, r, least[late])
        most[late] = r
    return least, most


def list_lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)


def _suffixes(df: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, row, place, n_left, n_right, prefix, around): every anchored suffix; row tells texts with one doc apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            words, edges = hashed_words(part.column(2))
            places, prefix = anchors(words, edges, window, gram)
            n_left, n_right = around(words, edges, places, window, gram)
            row = np.searchsorted(edges, places, "right") - 1
            signature = mix64(run_hashes(words, places - n_left, places + n_right) + (n_left * 1000 + n_right).astype(np.uint64))
            doc, key = (part.column(k).to_numpy()[row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, key, places - edges[row], n_left.astype(np.int16), n_right.astype(np.int16), prefix.view(np.int64), signature.view(np.int64))], names=["doc", "row", "place", "n_left", "n_right", "prefix", "around"])

    return df.mapInArrow(work, "doc long, row long, place long, n_left short, n_right short, prefix long, around long")


def _contexts(texts: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """(prefix, around, doc, n_left, n_right, words binary or null, windows array or null) of the wanted suffixes."""
    before = window - gram

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            words, edges = hashed_words(part.column(0))
            items = part.column(2)
            row = np.repeat(np.arange(part.num_rows), list_lengths(items))
            place, prefix, near, hot = (items.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
            place = place + edges[row]
            doc = part.column(1).to_numpy()[row]
            n_left, n_right = around(words, edges, place, window, gram)
            padded = np.concatenate([np.zeros(before, np.uint64), words, np.zeros(window, np.uint64)])
            sums = run_sums(words)
            for a in range(0, len(place), 2000):
                s = slice(a, a + 2000)
                p, nl, nr, h = place[s], n_left[s], n_right[s], hot[s].astype(bool)
                right = padded[p[:, None] + before + np.arange(window)] * (np.arange(window) < nr[:, None])
                left = padded[p[:, None] + before - 1 - np.arange(before)] * (np.arange(before) < nl[:, None])
                both = np.concatenate([right, left], axis=1).astype(np.uint64)
                whole = np.arange(gram, window + 1)
                start = p[:, None] - window + whole
                fits = (window - whole <= nl[:, None]) & (whole <= nr[:, None]) & h[:, None]
                keys = np.zeros(start.shape, np.uint64)
                if fits.any():
                    keys[fits] = sums(start[fits], start[fits] + window)
                windows = pa.array([[None if not f else int(x) for f, x in zip(fs, xs)] if q else None for q, fs, xs in zip(h, fits, keys.view(np.int64))], pa.list_(pa.int64()))
                tree = pa.array([None if q else x.tobytes() for q, x in zip(h, both)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(prefix[s]), pa.array(near[s]), pa.array(doc[s]), pa.array(nl.astype(np.int16)), pa.array(nr.astype(np.int16)), tree, windows], names=["prefix", "around", "doc", "n_left", "n_right", "words", "windows"])

    items = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("place", "prefix", "around", "hot")).alias("items"))
    rows = texts.join(items, ["doc", "row"]).select("text", "doc", "items")
    return rows.mapInArrow(work, "prefix long, around long, doc long, n_left short, n_right short, words binary, windows array<long>")


def _trees(contexts: DataFrame, window: int, gram: int) -> DataFrame:
    """(prefix, around, least, most) of suffixes that share a window with a smaller document; groups that fit in memory."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        prefix, near, doc, nl, nr = (table.column(k).to_numpy().astype(np.int64) for k in range(5))
        raw, _ = text_bytes(table.column(5).combine_chunks() if isinstance(table.column(5), pa.ChunkedArray) else table.column(5))
        words = np.frombuffer(raw.tobytes(), np.uint64).reshape(len(doc), -1)
        least, most = shared_by_earlier(words[:, :window], words[:, window:], nr, nl, doc, window, gram)
        i = np.flatnonzero(least)
        return pa.RecordBatch.from_arrays([pa.array(x[i]) for x in (prefix, near, least, most)], names=["prefix", "around", "least", "most"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, 5):
            prefix = part.column(0).to_numpy()
            cut = int(np.searchsorted(prefix, prefix[-1])) if prefix[0] != prefix[-1] else 0
            if cut and size + cut >= TREE // 4:  # whole groups only
                yield solve([*held, part.slice(0, cut)])
                held, size, part = [], 0, part.slice(cut)
            elif size >= TREE // 4 and held[-1].column(0)[-1].as_py() != prefix[0]:
                yield solve(held)
                held, size = [], 0
            held.append(part)
            size += part.num_rows
        if held:
            yield solve(held)

    rows = contexts.select("prefix", "around", "doc", "n_left", "n_right", "words").repartition("prefix").sortWithinPartitions("prefix")
    return rows.mapInArrow(work, "prefix long, around long, least long, most long")


def repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Texts (doc, row, key, text) and spans (doc, row, from, to): words of windows that a document with a smaller key has too.

    Each span is a union of such windows that touch. Rows with one key are one document; null keys count as the largest (and so does 2^63 - 1).
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts = with_place(rows, "key", "doc").select("doc", F.xxhash64("text").alias("row"), "key", "text")
    suffixes = Table(_suffixes(texts.select("doc", "row", "text"), window, gram), "suffixes").df
    same = suffixes.groupBy("prefix", "around").agg(F.min(F.struct("doc", "row", "place")).alias("first"), F.max("doc").alias("last"))
    kept = Table(same.select("prefix", "around", "first", (F.col("last") > F.col("first.doc")).alias("copied")), "same")
    same = kept.df
    groups = same.groupBy("prefix").agg(F.count("*").alias("n"), F.min("first.doc").alias("a"), F.max("first.doc").alias("b")).where("n > 1 and a < b")
    groups = Table(groups.select("prefix", "n"), "groups").df  # so that a hot prefix can be split in the join
    wanted = same.join(groups, "prefix").select("first.*", "prefix", "around", (F.col("n") > TREE).alias("hot"))
    around_ = Table(_contexts(texts.select("doc", "row", "text"), wanted, window, gram), "contexts")
    contexts = around_.df
    parts = _trees(contexts.where("words is not null"), window, gram)
    hot = contexts.where("windows is not null").select("prefix", "around", "doc", F.posexplode("windows").alias("at", "key")).where("key is not null")
    smallest = hot.groupBy("key").agg(F.min("doc").alias("smallest"), F.max("doc").alias("largest")).where("smallest < largest").select("key", "smallest")
    smallest = Table(smallest, "smallest").df  # as below: a hot window can be split
    at = (F.col("at") + gram).cast("long")
    long_prefix = hot.join(smallest, "key").where("doc > smallest").groupBy("prefix", "around").agg(F.min(at).alias("least"), F.max(at).alias("most"))
    found = same.join(parts.unionByName(long_prefix), ["prefix", "around"], "left").where("copied or least is not null")
    found = found.select("prefix", "around", F.col("first.doc").alias("smallest"), F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("most", F.lit(0)).alias("most"))
    found = Table(found, "found").df  # so that both sides of the next join are exchanged anew, and a hot context can be split
    kept.drop()
    around_.drop()
    here = suffixes.join(found, ["prefix", "around"])
    later = F.col("doc") > F.col("smallest")
    spans = here.where((later & (F.col("n_left") + F.col("n_right") >= window)) | (~later & (F.col("least") > 0)))
    return texts, spans.select("doc", "row", F.when(later, F.col("place") - F.col("n_left")).otherwise(F.col("place") - window + F.col("least")).alias("from"), F.when(later, F.col("place") + F.col("n_right")).otherwise(F.col("place") + F.col("most")).alias("to"))


def drop_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, n_words long, n_removed long, kept string): each text without the words of repeats, the rest joined by one space.

    A word goes if it lies in `window` words in a row that also stand in a document with a smaller key;
    that is judged on the input. Words are runs of other than the six ASCII blanks. A null or blank text has
    no words. Texts of fewer than `window` words stay whole. Rows come back one for one: rows with one key count as one document (no repeat
    within it), null keys as the largest (2^63 - 1 counts as null). Keys may be of any type that can be sorted. Only key and text are read.
    """
    texts, spans = repeats(df, key=key, text=text, window=window, gram=gram)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, offsets = text_bytes(part.column(1))
            starts, stops, edges = word_spans(raw, offsets)
            lists = part.column(2)
            row = np.repeat(np.arange(part.num_rows), list_lengths(lists))
            begin, end = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) + edges[row] for k in (0, 1))
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
            stays = np.cumsum(change)[:-1] == 0
            before = np.concatenate([[0], np.cumsum(stays)])
            kept, n = np.diff(before[edges]), np.diff(edges)
            size = stops[stays] - starts[stays]
            blank = np.ones(len(size), np.int64)  # one space after each word but the last of its row
            last = np.cumsum(kept)[kept > 0] - 1
            blank[last] = 0
            source = ragged(starts[stays], size + blank)
            out = raw[np.minimum(source, max(len(raw) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
            ends = np.cumsum(size + blank)
            out[(ends - 1)[blank > 0]] = 0x20
            rows = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(kept)])])
            text_out = binary_rows(out, rows).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(n - kept, pa.int64()), text_out], names=["key", "n_words", "n_removed", "kept"])

    lists = spans.distinct().groupBy("doc", "row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    rows = texts.join(lists, ["doc", "row"], "left").select("key", "text", "spans")
    return rows.mapInArrow(work, f"key {df.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    found = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w),
h AS (SELECT doc_id, j, ws[j] AS word, CASE WHEN j + {WINDOW - 1} <= len(ws) THEN hash(ws[j:j + {WINDOW - 1}]) END AS x FROM p),
f AS (SELECT x, min(doc_id) AS first FROM h WHERE x IS NOT NULL GROUP BY x HAVING count(*) > 1),
c AS (SELECT doc_id, j, word, coalesce(max((first < doc_id)::INT) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM h LEFT JOIN f USING (x))
SELECT doc_id, count(word) AS n_words, coalesce(count(*) FILTER (gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id"""
