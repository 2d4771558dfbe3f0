"""Parameters of chunking, identity and compression, with their checks."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from functools import cached_property

from .errors import CompressionError, ConfigError, SizeError

KIB, MIB = 1 << 10, 1 << 20
ALGORITHMS = ("buzhash", "rollsum", "fixed")  # their numbers in archives
CODECS = ("none", "lzma", "zstd", "brotli")  # their numbers in archives
MAX_LEVEL = {"brotli": 11, "lzma": 9, "zstd": 22}

# What the table of the cyclic-polynomial hash is combined with, and the constant that RollSum adds to bytes.
TABLE_SEED = 0x10324195
CHAR_OFFSET = 31


def parse_size(text: str) -> int:
    """Bytes of a size such as 64KiB: a whole number and B, KiB, MiB, GiB or nothing."""
    for unit, factor in (("KiB", KIB), ("MiB", MIB), ("GiB", 1 << 30), ("B", 1), ("", 1)):
        number = text[: len(text) - len(unit)] if unit else text
        if text.endswith(unit) and number.isascii() and number.isdigit():
            return int(number) * factor
    raise SizeError(f"{text!r} is no size; write a whole number and B, KiB, MiB or GiB")


def default_table() -> tuple[int, ...]:
    """256 scattered 32-bit numbers, by a rule: the first bytes of BLAKE2b of each byte value."""
    return tuple(int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256))


def filter_bits(average: int) -> int:
    """Bits of the boundary filter for a nominal average size: the power of two below it, halved."""
    if average < 2:
        raise ConfigError("the average size must be 2 or more")
    return average.bit_length() - 2


@dataclass(frozen=True)
class ChunkerConfig:
    """How a byte stream is cut.

    fixed: every max_size bytes. rollsum, buzhash: after a byte where the low `bits` bits of a hash of the last `window`
    bytes are all set, if the chunk then has min_size bytes or more, and at max_size. table: 256 numbers for buzhash (before
    they are combined with TABLE_SEED); archives cut with another table need that one to be cut alike.
    """

    algorithm: str = "rollsum"
    bits: int = 15
    min_size: int = 16 * KIB
    max_size: int = 16 * MIB
    window: int = 64
    hash_length: int = 64
    table: tuple[int, ...] | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ConfigError(f"unknown algorithm {self.algorithm!r}")
        if not 4 <= self.hash_length <= 64:
            raise ConfigError("the hash length must be 4 to 64 bytes")
        if self.max_size < 1:
            raise ConfigError("the maximum size must be 1 or more")
        if self.algorithm == "fixed":
            return
        if not 1 <= self.bits <= 31:
            raise ConfigError("the filter must have 1 to 31 bits")
        if self.window < 1 or self.min_size < 0 or self.min_size > self.max_size:
            raise ConfigError("sizes must be 0 <= minimum <= maximum, the window 1 or more")
        if self.algorithm == "buzhash" and self.window > self.max_size:
            raise ConfigError("the window must not exceed the maximum size")
        if self.table is not None and len(self.table) != 256:
            raise ConfigError("the table must have 256 numbers")

    @classmethod
    def fixed(cls, size: int, hash_length: int = 64) -> ChunkerConfig:
        return cls("fixed", 0, 0, size, 0, hash_length)

    @classmethod
    def rolling(cls, algorithm: str = "rollsum", average: int = 64 * KIB, minimum: int = 16 * KIB, maximum: int = 16 * MIB, window: int | None = None, hash_length: int = 64) -> ChunkerConfig:
        """By sizes, as users give them; the window is 64 bytes (buzhash: 16) unless given."""
        if not minimum <= average <= maximum:
            raise ConfigError("sizes must be minimum <= average <= maximum")
        return cls(algorithm, filter_bits(average), minimum, maximum, window or (16 if algorithm == "buzhash" else 64), hash_length)

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1

    @property
    def target_average(self) -> int:
        return 1 << (self.bits + 1)

    @cached_property
    def seeded_table(self) -> tuple[int, ...]:
        return tuple(x ^ TABLE_SEED for x in self.table or default_table())

    @property
    def first_tested(self) -> int:
        """Bytes from a chunk's start to the first place that may be its last byte."""
        return max(self.min_size, 1) - 1

    def to_params(self) -> dict[str, int | str]:
        """The parameters as archives have them; a fixed size stands in max_size."""
        fixed = self.algorithm == "fixed"
        return {
            "algorithm": self.algorithm,
            "filter_bits": 0 if fixed else self.bits,
            "min_size": 0 if fixed else self.min_size,
            "max_size": self.max_size,
            "window_size": 0 if fixed else self.window,
            "hash_length": self.hash_length,
        }

    @classmethod
    def from_params(cls, params: dict, table: tuple[int, ...] | None = None) -> ChunkerConfig:
        return cls(params["algorithm"], params["filter_bits"], params["min_size"], params["max_size"], params["window_size"], params["hash_length"] or 64, table)


@dataclass(frozen=True)
class Compression:
    """A codec and its level; no codec: data is stored as it is."""

    codec: str | None = "brotli"
    level: int = 6

    def __post_init__(self):
        if self.codec == "none":
            object.__setattr__(self, "codec", None)
        if self.codec is None:
            object.__setattr__(self, "level", 0)
        elif self.codec not in MAX_LEVEL:
            raise CompressionError(f"unknown codec {self.codec!r}")
        elif not 1 <= self.level <= MAX_LEVEL[self.codec]:
            raise CompressionError(f"{self.codec} levels are 1 to {MAX_LEVEL[self.codec]}")

    def __str__(self) -> str:
        return f"{self.codec} (level {self.level})" if self.codec else "None"


@dataclass(frozen=True)
class ArchiveOptions:
    """How an archive is made."""

    chunker: ChunkerConfig = ChunkerConfig()
    compression: Compression = Compression()
    metadata: dict[str, bytes] = field(default_factory=dict)

    def with_metadata(self, values: dict[str, str] | None = None, files: dict[str, bytes] | None = None) -> ArchiveOptions:
        """Texts first, then files, so a file wins where both have a key."""
        return replace(self, metadata=self.metadata | {k: v.encode() for k, v in (values or {}).items()} | (files or {}))
