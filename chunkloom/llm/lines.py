"""Line deduplication within one edit: a deletion-neighbourhood join that keeps the earliest line.

Two lines within one edit (a character inserted, deleted or replaced) have a common variant: what is
left when each loses one character, or when the longer one does. Making all variants of all lines would write
the corpus many times over, so lines are narrowed first, losing no pair. With a line cut into blocks, one edit
leaves all but one block as they were: the variants are first made by deleting a whole block. Cut in two blocks,
they show which lines have any partner; these are cut finer, and only partners that agree in all but one
short block get single characters of that block deleted. The edit distance is verified on the block, as
the rest is equal. Lines are counted in code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Table, fresh, fresh_root, mix64, ragged, run_sums, slices, small_batches, with_place
from .substrings import list_lengths

#: Characters in a short block.
PIECE = 24

_MARK = np.uint64(0xD6E8FEB86659FD93)
#: What scrambled code points of the first plane are.
_PLANE = mix64((np.arange(1, (1 << 16) + 1, dtype=np.uint64)) * _MARK)


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scrambled code points of all texts, and where each text starts (texts + 1 numbers)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if len(points) and points.max() >> 16:
        return mix64((points.astype(np.uint64) + np.uint64(1)) * _MARK), edges
    return _PLANE[points], edges


def _tagged(x: np.ndarray, *tags: np.ndarray) -> np.ndarray:
    for t in tags:
        x = mix64((x ^ np.asarray(t).astype(np.uint64)) * _MARK + np.uint64(1))
    return x


def block_keys(sums, start: np.ndarray, stop: np.ndarray, shorter: np.ndarray, block: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each line without one block, and where that block starts and stops.

    Blocks are those of the shorter line of a pair: `shorter` is its length. What stands before the
    block counts from the line's start, what stands after it from the line's end. sums: run_sums() of all characters.
    """
    head, tail = block * shorter // blocks, shorter - (block + 1) * shorter // blocks
    before, after = sums(start, start + head), sums(stop - tail, stop)
    return _tagged(before, after, shorter, block), start + head, stop - tail


def _lines(df: DataFrame) -> DataFrame:
    """(doc, row, no, n, line, keys array): every line with a word; keys: its hashes without either half, as the shorter and the longer of a pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            texts = [t or "" for t in part.column(2).to_pylist()]
            split = [t.split("\n") for t in texts]
            row = np.repeat(np.arange(len(texts)), [len(x) for x in split])
            no = ragged(np.zeros(len(texts), np.int64), np.array([len(x) for x in split], np.int64))
            all_ = [x for lines in split for x in lines]
            spoken = np.fromiter((bool(x.strip(" \t\n\r\x0b\x0c")) for x in all_), bool, len(all_))
            chars, edges = _characters(all_)
            i = np.flatnonzero(spoken)
            start, stop = edges[i], edges[i + 1]
            n = stop - start
            sums = run_sums(chars)
            line = _tagged(sums(start, stop), n)
            keys = np.stack([block_keys(sums, start, stop, np.maximum(n - less, 0), np.full(len(i), j), np.full(len(i), 2))[0] for less in (0, 1) for j in (0, 1)], axis=1)
            arrays = pa.ListArray.from_arrays(pa.array(4 * np.arange(len(i) + 1), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            doc, key = (part.column(k).to_numpy()[row[i]] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(no[i], pa.int32()), pa.array(n, pa.int32()), pa.array(line.view(np.int64)), arrays], names=["doc", "row", "no", "n", "line", "keys"])

    return df.mapInArrow(work, "doc long, row long, no int, n int, line long, keys array<long>")


def _pieces(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, line, first, longer, piece): each wanted line without one of its short blocks (key), and that block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            items = part.column(3)
            owner = np.repeat(np.arange(part.num_rows), list_lengths(items))
            no, line = (items.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            split = [t.split("\n") for t in part.column(0).to_pylist()]
            lines = [split[o][k] for o, k in zip(owner.tolist(), no.tolist())]
            chars, edges = _characters(lines)
            start, stop = edges[:-1], edges[1:]
            which, shorter, longer = (np.concatenate(x) for x in zip(*[(np.arange(len(lines)), stop - start - less, np.full(len(lines), less == 1)) for less in (0, 1)]))
            blocks = np.maximum(2, -(-shorter // PIECE))
            pick = np.repeat(np.arange(len(which)), blocks)
            block = ragged(np.zeros(len(which), np.int64), blocks)
            which, shorter, longer = which[pick], shorter[pick], longer[pick]
            key, a, b = block_keys(run_sums(chars), start[which], stop[which], shorter, block, blocks[pick])
            at = start[which]
            piece = [lines[w][i:j] for w, i, j in zip(which.tolist(), (a - at).tolist(), (b - at).tolist())]
            doc, row = (part.column(k).to_numpy()[owner][which] for k in (1, 2))
            for s in range(0, len(which), 50_000):
                e = slice(s, s + 50_000)
                first = pa.StructArray.from_arrays([pa.array(doc[e]), pa.array(row[e]), pa.array(no[which[e]], pa.int32())], ["doc", "row", "no"])
                yield pa.RecordBatch.from_arrays([pa.array(key[e].view(np.int64)), pa.array(line[which[e]]), first, pa.array(longer[e]), pa.array(piece[e], pa.string())], names=["key", "line", "first", "longer", "piece"])

    items = wanted.groupBy("first.doc", "first.row").agg(F.collect_list(F.struct("first.no", "line")).alias("items"))
    return texts.join(items, ["doc", "row"]).select("text", "doc", "row", "items").mapInArrow(work, "key long, line long, first struct<doc:long,row:long,no:int>, longer boolean, piece string")


def _with_partner(rows: DataFrame) -> DataFrame:
    """The rows whose key another line has too."""
    shared = rows.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a < b").select("key")
    return rows.join(shared, "key", "left_semi")


def _near(pieces: DataFrame) -> DataFrame:
    """line: those within one edit of an earlier line, by single deletions from pieces with equal surroundings."""
    size = F.length("piece")
    shrunk = lambda i: F.concat(F.expr("substring(piece, 1, i)"), F.expr("substring(piece, i + 2)"))
    each = F.expr("explode(sequence(0, length(piece) - 1))").alias("i")
    cut = pieces.where(size > 0).select("*", each).withColumn("variant", shrunk("i"))
    # lines of one length: the same place deleted, so any two of a group differ in that character alone
    replaced = cut.where("not longer").select("key", "variant", "i", "line", "first", "piece")
    # lines of two lengths: a deletion from the longer gives the shorter whole
    whole = pieces.where("not longer").select("key", F.col("piece").alias("variant"), F.lit(-1).alias("i"), "line", "first", "piece")
    shrunk_ = cut.where("longer").select("key", "variant", F.lit(-2).alias("i"), "line", "first", "piece")
    rows = replaced.unionByName(whole).unionByName(shrunk_)
    earliest = lambda when: F.min(F.when(when, F.struct("first", "line", "piece")))
    group = F.when(F.col("i") >= 0, F.col("i")).otherwise(-1)
    mates = rows.groupBy("key", "variant", group.alias("g")).agg(earliest(F.lit(True)).alias("any"), earliest(F.col("i") == -1).alias("whole"), earliest(F.col("i") == -2).alias("longer"), F.min("line").alias("a"), F.max("line").alias("b")).where("a < b").drop("a", "b")
    both = rows.withColumn("g", group).join(mates, ["key", "variant", "g"])
    mate = F.when(F.col("i") >= 0, F.col("any")).when(F.col("i") == -1, F.col("longer")).otherwise(F.col("whole"))
    found = both.withColumn("mate", mate).where("mate is not null and mate.first < first and mate.line <> line")
    return found.where(F.levenshtein("piece", "mate.piece", 1) >= 0).select("line").distinct()


def repeated_lines(texts: DataFrame) -> DataFrame:
    """(doc, row, no): the lines of texts (doc, row, text) that an earlier line equals or is one edit from."""
    small_batches(texts.sparkSession)
    lines = Table(_lines(texts), "lines").df
    place = F.struct("doc", "row", "no")
    distinct = Table(lines.groupBy("line").agg(F.min(place).alias("first"), F.first("keys").alias("keys")), "distinct").df
    keyed = distinct.select("line", F.explode("keys").alias("key"))
    wanted = distinct.select("line", "first").join(_with_partner(keyed).select("line").distinct(), "line", "left_semi")
    pieces = Table(_pieces(texts, wanted), "pieces")
    near = Table(_near(_with_partner(pieces.df)), "near").df.withColumn("near", F.lit(True))
    pieces.drop()
    marked = distinct.select("line", "first").join(near, "line", "left")
    gone = lines.select("doc", "row", "no", "line").join(marked, "line").where("near or first.doc <> doc or first.row <> row or first.no <> no")
    return gone.select("doc", "row", "no")


def drop_repeated_lines(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with each text without its repeated lines, and the columns n_lines and n_removed (underscores are added to taken names).

    Lines are what \\n parts; one without a word (only ASCII blanks) always stays. A line goes if an earlier one,
    by key, then place in its text, equals it or is one insertion, deletion or replacement of a character away, however short it is.
    That is judged on the input: a line that goes may be what a later one repeats. Keys may be of any type that can be sorted. Null
    keys come last (2^63 - 1 counts as null), rows with equal keys in the order of their texts' hashes; rows that are equal in both count
    as one, and keep the same lines. A null text stays null, with no lines. The lines of a text that stay keep their order.
    """
    lines, removed = fresh(df, "n_lines"), fresh(df, "n_removed")
    root = fresh_root(df, "cl", "doc", "doc_key", "row", "drop")
    doc, row, drop = f"{root}doc", f"{root}row", f"{root}drop"
    keyed = with_place(df, key, doc).withColumn(row, F.xxhash64(text))
    gone = repeated_lines(keyed.select(F.col(doc).alias("doc"), F.col(row).alias("row"), F.col(text).alias("text")))
    gone = gone.distinct().groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.sort_array(F.collect_list("no")).alias(drop))
    both = keyed.join(gone, [doc, row], "left")

    @F.arrow_udf("string")
    def without(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for t, n in zip(texts, numbers):
            t = t.as_py()
            if n.is_valid:
                skip = set(n.as_py())
                t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in skip)
            out.append(t)
        return pa.array(out, pa.string())

    spoken = F.size(F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    n_removed = F.coalesce(F.size(drop), F.lit(0))
    new = F.when(F.col(drop).isNull(), F.col(text)).otherwise(without(text, drop))
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    return both.select(*columns, F.when(F.col(text).isNull(), 0).otherwise(spoken).cast("long").alias(lines), F.when(F.col(drop).isNull(), 0).otherwise(n_removed).cast("long").alias(removed))


def op8_lines(spark, sf_dir: str) -> DataFrame:
    """Per document: lines with a word, lines removed, and the SHA-256 of the text that stays."""
    found = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same by SQL: lines that lose the same character's place and are equal then differ there alone; a line that loses any may be a shorter one.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
s AS (SELECT *, regexp_matches(line, '[^ \t-\r]') AS spoken FROM l),
u AS (SELECT row_number() OVER () AS id, line, first, length(line) AS n, hash(line) AS x FROM (SELECT line, min((doc_id, no)) AS first FROM s WHERE spoken GROUP BY line)),
v AS (SELECT id, first, n, i, hash(substring(line, 1, i) || substring(line, i + 2)) AS x FROM (SELECT *, unnest(range(n)) AS i FROM u)),
g AS (SELECT n, i, x, min(first) AS m FROM v GROUP BY n, i, x HAVING count(*) > 1),
near AS (SELECT v.id FROM v JOIN g ON v.n = g.n AND v.i = g.i AND v.x = g.x WHERE m < first
  UNION SELECT v.id FROM v JOIN u ON v.x = u.x AND v.n = u.n + 1 WHERE u.first < v.first
  UNION SELECT u.id FROM v JOIN u ON v.x = u.x AND v.n = u.n + 1 WHERE v.first < u.first),
r AS (SELECT s.doc_id, s.no, s.line, s.spoken, coalesce((s.doc_id, s.no) > u.first OR near.id IS NOT NULL, false) AS gone FROM s LEFT JOIN u ON s.spoken AND s.line = u.line LEFT JOIN near ON u.id = near.id)
SELECT doc_id, (count(*) FILTER (spoken))::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id"""
