"""What can go wrong, by what it concerns."""


class ChunkloomError(Exception):
    """Base of all errors of this package."""


class ConfigError(ChunkloomError, ValueError):
    """Parameters that contradict each other or are out of range."""


class SizeError(ConfigError):
    """Text that is no size, such as 12MB or 1.5KiB."""


class CompressionError(ChunkloomError):
    """An unknown codec, a level out of range, or data that doesn't decompress."""


class ArchiveError(ChunkloomError):
    """A file that is no archive, or one whose header is damaged."""


class HashMismatchError(ArchiveError):
    """Data whose hash isn't the expected one."""


class RangeError(ChunkloomError, EOFError):
    """A byte range that a source doesn't have, or a server doesn't serve."""
