"""Moves that bring a copy into a new order in place: which chunk to copy where, and what to keep in memory first.

A write may destroy chunks that are still to be moved: those move first. Where that goes round in a circle, one of
the circle is read into memory before it is overwritten. Edges come from an interval join (`clone.overlaps`); their order
is found for each file by itself, over its index, not its data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPY, STORE = "copy", "store"


def plan(moves: dict, children: dict) -> list[tuple]:
    """Steps (op, chunk, source, destinations), in order.

    moves: chunk to (source, size, destinations), of all chunks that current and target share; children: chunk to the
    chunks that its writes destroy, in the order in which they are met. Chunks are started by source; what a write destroys
    comes before it, the last met first; a chunk that is met again below itself is kept in memory.
    """
    steps, done = [], set()
    for root in sorted(moves, key=lambda c: (moves[c][0], moves[c][1])):
        if root in done:
            continue
        seen, path = set(), [root]
        opened = set()
        while path:
            chunk = path[-1]
            if chunk in opened:
                path.pop()
                steps.append((COPY, chunk, moves[chunk][0], moves[chunk][2]))
                opened.discard(chunk)
            elif chunk in seen:  # met twice before it was started
                path.pop()
            else:
                seen.add(chunk)
                opened.add(chunk)
                for other in children.get(chunk, ()):
                    if other in done:
                        continue
                    if other in seen:
                        steps.append((STORE, other, moves[other][0], []))
                    else:
                        path.append(other)
        done |= seen
    return steps


def reorder(current: DataFrame, target: DataFrame, widest: int, strip: bool = True) -> DataFrame:
    """(archive_id, step, op, hash, size, source, dest array): the moves of each archive from its current to its target layout.

    Both: (archive_id, hash, length, offset), no length over `widest`. A chunk is read from its first current place; places
    that hold their chunk already are not written (they are if strip is false). Chunks that are only in one of both have no part.
    """
    from .clone import overlaps, remaining

    todo = remaining(current, target) if strip else target
    here = current.groupBy("archive_id", "hash").agg(F.min("offset").alias("offset"), F.first("length").alias("length"))
    shared = here.join(todo.select("archive_id", "hash").distinct(), ["archive_id", "hash"], "left_semi")
    dest = todo.join(shared.select("archive_id", "hash"), ["archive_id", "hash"], "left_semi")
    met = overlaps(shared, dest, widest).select("archive_id", F.col("target_hash").alias("hash"), F.struct("target_offset", (-F.col("offset")).alias("o"), F.col("hash").alias("other")).alias("edge"))
    edges = met.groupBy("archive_id", "hash").agg(F.sort_array(F.collect_set("edge")).alias("edges"))
    places = dest.groupBy("archive_id", "hash").agg(F.sort_array(F.collect_set("offset")).alias("dest"))
    rows = shared.join(places, ["archive_id", "hash"]).join(edges, ["archive_id", "hash"], "left")
    rows = rows.select("archive_id", "hash", "length", F.col("offset").alias("source"), "dest", F.transform("edges", lambda e: e["other"]).alias("others"))

    def solve(table: pa.Table) -> pa.Table:
        records = table.to_pylist()
        moves = {r["hash"]: (r["source"], r["length"], r["dest"]) for r in records}
        steps = plan(moves, {r["hash"]: r["others"] or [] for r in records})
        out = [{"archive_id": records[0]["archive_id"], "step": k, "op": op, "hash": c, "size": moves[c][1], "source": s, "dest": d} for k, (op, c, s, d) in enumerate(steps)]
        return pa.Table.from_pylist(out, schema=pa.schema([("archive_id", table.schema.field("archive_id").type), ("step", pa.int64()), ("op", pa.string()), ("hash", pa.binary()), ("size", pa.int64()), ("source", pa.int64()), ("dest", pa.list_(pa.int64()))]))

    kind = current.schema["archive_id"].dataType.simpleString()
    return rows.groupBy("archive_id").applyInArrow(solve, f"archive_id {kind}, step long, op string, hash binary, size long, source long, dest array<long>")


def carry_out(steps: Iterable[tuple[str, bytes, int, int, list[int]]], read: Callable[[int, int], bytes], write: Callable[[int, bytes], object]) -> int:
    """Do the steps (op, hash, size, source, dest) in order, with read(offset, size) and write(offset, data); returns the bytes written.

    What is kept in memory is only what goes round in circles, until it is written.
    """
    kept, moved, done = {}, set(), 0
    for op, chunk, size, source, dest in steps:
        if op == STORE:
            if chunk not in kept and chunk not in moved:  # a plan may ask for it again when its place has been overwritten
                kept[chunk] = read(source, size)
            continue
        data = kept.pop(chunk) if chunk in kept else read(source, size)
        moved.add(chunk)
        for offset in dest:
            write(offset, data)
            done += size
    return done
