"""Boundaries of chunks, by array operations over many streams at once.

Both rolling hashes depend on the last `window` bytes alone, so the places where a chunk may end are found for all bytes
together, from running sums; only the choice among them, with its minimum and maximum size, goes one by one.

rollsum: with T the sum of the last w bytes and Q that of place times byte, the low half of the hash is
31w(w-1) + (i+1)T - Q and the high half 31w + T; before its start a stream counts as zeros.

buzhash: with y the table's number of byte j turned left by -j, the hash is the exclusive or of the last w of these, turned left by i.
It has one exception. The hash skips bytes while its window holds one value, and takes the first byte after the w that
start it for a repetition if that is zero; so as long as nothing but zeros has come since, the last of the first w bytes stays in the window.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from chunkloom.config import CHAR_OFFSET, ChunkerConfig

U32 = np.uint64(0xFFFFFFFF)


def _rotl32(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64) & np.uint64(31)
    return ((x << by) | (x >> (np.uint64(32) - by))) & U32


def rolling_sums(data: np.ndarray, starts: np.ndarray, config: ChunkerConfig) -> np.ndarray:
    """The 32-bit hash at every byte; starts: where streams start. For buzhash the first w - 1 of a stream have no meaning."""
    n, w = len(data), config.window
    sizes = np.diff(np.append(starts, n))
    local = np.arange(n) - np.repeat(starts, sizes)
    low = np.arange(n) - np.minimum(local, w - 1)  # first byte of the window
    if config.algorithm == "rollsum":
        x = data.astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(x)])
        placed = np.concatenate([[np.uint64(0)], np.cumsum(x * local.astype(np.uint64))])
        total = sums[1:] - sums[low]
        weighted = (local + 1).astype(np.uint64) * total - (placed[1:] - placed[low])
        s1 = np.uint64(CHAR_OFFSET * w) + total
        s2 = np.uint64(CHAR_OFFSET * w * (w - 1) & 0xFFFFFFFF) + weighted
        return ((s1 << np.uint64(16)) & U32) | (s2 & np.uint64(0xFFFF))
    table = np.array(config.seeded_table, np.uint64)
    turned = _rotl32(table[data], -local)
    ors = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(turned)]) if n else np.zeros(1, np.uint64)
    return _rotl32(ors[1:] ^ ors[low], local)


def _zeros_first(x: np.ndarray, config: ChunkerConfig) -> int | None:
    """For a buzhash stream to which the exception may apply: the first byte after those that fill the window."""
    w = config.window
    skipped = config.min_size - w
    first = skipped - 1 if skipped > w else w
    return first if len(x) > first and x[w - 1] and not x[first] else None


def _kept_sum(x: np.ndarray, config: ChunkerConfig) -> int:
    """The hash of byte w - 1 and w - 1 zeros."""
    w, table = config.window, config.seeded_table
    turn = lambda v, by: (v << by % 32 | v >> (32 - by % 32)) & 0xFFFFFFFF
    out = turn(table[int(x[w - 1])], w - 1)
    for k in range(w - 1):
        out ^= turn(table[0], k)
    return out


Kept = tuple[int, int, bool]  # first byte after those that fill the window, first place with the kept hash, whether it passes


def choose(candidates: list[int], x: np.ndarray, config: ChunkerConfig, offset: int = 0, kept: Kept | None = None) -> tuple[list[int], list[Kept | None]]:
    """Ends of all chunks of a stream from a chunk's start on, and what to give as `kept` to go on from each of these.

    candidates: places, ascending, whose hash passes the filter. offset: of x in its stream; places count from x.
    """
    n, ends, states, start = len(x), [], [], 0
    buzhash = config.algorithm == "buzhash"
    if buzhash and offset == 0 and (first := _zeros_first(x, config)) is not None:
        kept = first, first + config.window - 1, _kept_sum(x, config) & config.mask == config.mask
    nonzero = np.flatnonzero(x) if kept else x
    skip = max(config.min_size - config.window - 1, 0) if config.min_size >= config.window else 0
    while start < n:
        test = start + config.first_tested
        if buzhash and start + offset == 0:
            test = max(test, config.window)
        k = bisect_left(candidates, test)
        at = candidates[k] if k < len(candidates) else n
        if kept:  # as long as only zeros were read
            z = int(np.searchsorted(nonzero, kept[0] if start + offset == 0 else start + skip))
            other = int(nonzero[z]) if z < len(nonzero) else n
            place = max(test, kept[1] - offset)
            if place <= at and place < other:
                k = bisect_left(candidates, other)
                at = place if kept[2] else candidates[k] if k < len(candidates) else n
        end = min(at + 1, start + config.max_size, n)
        if kept and other < end:
            kept = None
        ends.append(end)
        states.append(kept)
        start = end
    return ends, states


def chunk_ends(data: np.ndarray, offsets: np.ndarray, config: ChunkerConfig) -> list[np.ndarray]:
    """For each stream (data between two offsets) where its chunks end."""
    if config.algorithm == "fixed":
        return [np.minimum(np.arange(config.max_size, size + config.max_size, config.max_size), size) for size in np.diff(offsets).tolist()]
    sums = rolling_sums(data, offsets[:-1], config)
    mask = np.uint64(config.mask)
    hits = np.flatnonzero((sums & mask) == mask)
    edges = np.searchsorted(hits, offsets)
    out = []
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        out.append(np.array(choose((hits[edges[k] : edges[k + 1]] - a).tolist(), data[a:b], config)[0], np.int64))
    return out


class Scanner:
    """Cuts one stream that comes in pieces. Its state is what of the current chunk has come, and what the hash looks back to."""

    def __init__(self, config: ChunkerConfig):
        self.config, self.rest, self.offset, self.before, self.kept = config, b"", 0, b"", None

    def feed(self, data: bytes, last: bool = False) -> list[tuple[int, bytes]]:
        """(offset, chunk) of the chunks that are complete; all that is left if this is the last piece."""
        self.rest += data
        ends, states = self._ends()
        done = len(ends) if last else max(len(ends) - 1, 0)
        out, a = [], 0
        for b in ends[:done]:
            out.append((self.offset + a, self.rest[a:b]))
            a = b
        if done:
            self.before = (self.before + self.rest[:a])[-max(self.config.window, 1) :]
            self.offset, self.rest, self.kept = self.offset + a, self.rest[a:], states[done - 1]
        return out

    def _ends(self) -> tuple[list[int], list[Kept | None]]:
        config, x, back = self.config, np.frombuffer(self.before + self.rest, np.uint8), len(self.before)
        if config.algorithm == "fixed":
            ends = chunk_ends(x[back:], np.array([0, len(self.rest)]), config)[0].tolist()
            return ends, [None] * len(ends)
        sums = rolling_sums(x, np.zeros(1, np.int64), config)  # the window lies within x wherever it is asked for
        mask = np.uint64(config.mask)
        hits = np.flatnonzero((sums & mask) == mask) - back
        return choose(hits[hits >= 0].tolist(), x[back:], config, self.offset, self.kept)
