"""Byte ranges of local files and of HTTP servers."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from chunkloom.errors import RangeError


def resolve(source: str) -> str:
    """A path that exists, or else a URL; anything else is an error. An absolute path is never taken for a URL."""
    if os.path.exists(source):
        return os.path.abspath(source)
    if not os.path.isabs(source) and source.split("://")[0] in ("http", "https") and "://" in source:
        return source
    raise FileNotFoundError(source)


@dataclass(frozen=True)
class ByteReader:
    """read(offset, size) of a path or URL.

    HTTP: a reply that breaks off is continued where it stopped; `retries` is for the whole range, with `delay` seconds before each. The server
    must answer with a part (status 206). A source that ends within the range is an error.
    """

    source: str
    retries: int = 0
    delay: float = 0.0
    timeout: float | None = None
    headers: dict[str, str] = field(default_factory=dict)

    def read(self, offset: int, size: int) -> bytes:
        if size == 0:
            return b""
        if "://" not in self.source:
            with open(self.source, "rb") as file:
                file.seek(offset)
                out = file.read(size)
        else:
            out = self._fetch(offset, size)
        if len(out) < size:
            raise RangeError(f"{self.source} ends within {size} bytes from {offset}")
        return out

    def _fetch(self, offset: int, size: int) -> bytes:
        out, left = bytearray(), self.retries
        while len(out) < size:
            request = urllib.request.Request(self.source, headers=self.headers | {"Range": f"bytes={offset + len(out)}-{offset + size - 1}"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    if reply.status != 206:
                        raise RangeError(f"status {reply.status} instead of a part")
                    while block := reply.read(1 << 16):
                        out += block
                if len(out) < size:
                    raise RangeError("the reply is short")
            except (urllib.error.URLError, TimeoutError, ConnectionError, RangeError) as e:
                if not left or isinstance(e, urllib.error.HTTPError) and e.code == 416:
                    raise e if isinstance(e, RangeError) else RangeError(str(e)) from e
                left -= 1
                time.sleep(self.delay)
        return bytes(out[:size])
