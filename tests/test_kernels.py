"""Array kernels against a step-by-step reading of the published rules."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.config import ChunkerConfig
from chunkloom.operators.kernels import Scanner, chunk_ends, rolling_sums


class StepRoll:
    def __init__(self, c):
        self.w, self.buf, self.k, self.ready = c.window, [0] * c.window, 0, True
        self.s1, self.s2 = 31 * c.window, 31 * c.window * (c.window - 1)

    def feed(self, v):
        old, self.buf[self.k] = self.buf[self.k], v
        self.k = (self.k + 1) % self.w
        self.s1 += v - old
        self.s2 += self.s1 - self.w * (old + 31)

    def value(self):
        return (self.s1 << 16 | self.s2 & 0xFFFF) & 0xFFFFFFFF


class StepBuz:
    def __init__(self, c):
        self.t, self.w, self.window, self.last, self.same = c.seeded_table, c.window, [], 0, 0

    @property
    def ready(self):
        return len(self.window) == self.w

    def fill(self, v):
        self.window.append(v)

    def feed(self, v):
        self.same = self.same + 1 if v == self.last else 0
        self.last = v
        if self.same < self.w:
            self.window = [*self.window[1:], v]

    def value(self):
        out = 0
        for v in self.window:
            out = (out << 1 | out >> 31) & 0xFFFFFFFF
            out ^= self.t[v]
        return out


def steps(data, c):
    h = StepBuz(c) if c.algorithm == "buzhash" else StepRoll(c)
    ends, start, n = [], 0, len(data)
    limit = c.min_size - c.window if c.min_size >= c.window else 0
    while start < n:
        at, size, hit = 0, n - start, False
        while not h.ready and at < size:
            h.fill(data[start + at])
            at += 1
        if limit and at < limit:
            at = min(limit - 1, size)
        while at < min(c.min_size - 1, size):
            h.feed(data[start + at])
            at += 1
        while at < min(c.max_size, size) and not hit:
            h.feed(data[start + at])
            at += 1
            hit = h.value() & c.mask == c.mask
        start += at
        ends.append(start)
    return ends


GRID = [(5, 3, 640, 5), (5, 0, 40, 10), (5, 10, 40, 5), (3, 10, 512, 16), (4, 20, 600, 10), (2, 50, 200, 7), (1, 1, 9, 3), (6, 9, 99, 8)]


def streams(rng):
    n = rng.choice([0, 1, 5, 30, 300, 2000])
    kind = rng.randrange(5)
    if kind == 0:
        return rng.randbytes(n)
    if kind == 1:
        return bytes(n)
    if kind == 2:
        return bytes(rng.choice([0, 0, 0, 1, 7]) for _ in range(n))
    if kind == 3:
        return rng.randbytes(rng.randrange(1, 40)) + bytes(rng.randrange(200)) + rng.randbytes(n)
    return b"".join(bytes([rng.randrange(256)]) * rng.randrange(1, 90) for _ in range(n // 30))


@pytest.mark.parametrize("algorithm", ["rollsum", "buzhash"])
def test_like_the_steps(algorithm):
    rng = random.Random(1)
    for bits, low, high, window in GRID:
        c = ChunkerConfig(algorithm, bits, low, high, window)
        data = [streams(rng) for _ in range(60)]
        joined = np.frombuffer(b"".join(data), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        for d, got in zip(data, chunk_ends(joined, offsets, c)):
            assert got.tolist() == steps(d, c), (c, d)


def test_zeros_after_the_start_of_buzhash():
    rng = random.Random(2)
    for _ in range(400):
        bits, low, high, window = rng.choice(GRID)
        c = ChunkerConfig("buzhash", rng.choice([1, 2, bits]), low, high, window)
        d = bytes(rng.randrange(1, 256) for _ in range(rng.choice([window, max(low - window - 1, window)]))) + bytes(rng.randrange(0, 4 * window)) + rng.choice([b"", b"\1", rng.randbytes(5)]) + bytes(rng.randrange(3 * window)) + rng.randbytes(60)
        assert chunk_ends(np.frombuffer(d, np.uint8), np.array([0, len(d)]), c)[0].tolist() == steps(d, c), (c, d)


def test_zeros_after_the_start_in_pieces():
    rng = random.Random(6)
    for _ in range(300):
        bits, low, high, window = rng.choice(GRID)
        c = ChunkerConfig("buzhash", rng.choice([1, 2, bits]), low, high, window)
        d = rng.randbytes(max(low - window - 1, window)) + bytes(rng.randrange(0, 3 * high)) + rng.randbytes(60)
        scanner, got = Scanner(c), []
        while len(d) > sum(len(x) for x in got):
            got.append(d[sum(len(x) for x in got) :][: rng.randrange(1, 50)])
        out = [x for p in got for x in scanner.feed(p)] + scanner.feed(b"", last=True)
        assert [o + len(x) for o, x in out] == steps(d, c), (c, d)


def test_hash_depends_on_the_window_alone():
    c = ChunkerConfig("buzhash", 5, 3, 640, 5)
    one = rolling_sums(np.array([1, 2, 3, 4, 5], np.uint8), np.array([0]), c)[-1]
    two = rolling_sums(np.array([9, 9, 9, 1, 2, 3, 4, 5], np.uint8), np.array([0]), c)[-1]
    assert one == two


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=700), st.lists(st.integers(0, 700), max_size=8), st.sampled_from(["fixed", "rollsum", "buzhash"]), st.sampled_from(GRID))
def test_any_pieces_give_the_same_chunks(data, places, algorithm, grid):
    c = ChunkerConfig.fixed(grid[2]) if algorithm == "fixed" else ChunkerConfig(algorithm, *grid)
    whole = [0, *chunk_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)]), c)[0].tolist()]
    scanner, got = Scanner(c), []
    edges = [0, *sorted(min(p, len(data)) for p in places), len(data)]
    for a, b in zip(edges, edges[1:]):
        got += scanner.feed(data[a:b])
    got += scanner.feed(b"", last=True)
    assert b"".join(x for _, x in got) == data
    assert [(o, len(x)) for o, x in got] == [(a, b - a) for a, b in zip(whole, whole[1:])]


def test_pseudo_random_source_byte_by_byte():
    seed, data = 0xA3, bytearray()
    for i in range(10_000):
        seed = (seed ^ seed * 4) & (1 << 64) - 1
        data.append((seed ^ i) & 0xFF)
    for algorithm in ("rollsum", "buzhash"):
        c = ChunkerConfig(algorithm, 10, 20, 600, 10)
        scanner = Scanner(c)
        got = [x for v in data for x in scanner.feed(bytes([v]))] + scanner.feed(b"", last=True)
        assert [o + len(x) for o, x in got] == steps(bytes(data), c)
