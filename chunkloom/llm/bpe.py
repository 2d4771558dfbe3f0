"""Byte-level BPE: text to ids and back with the tokenizers library, over Arrow batches.

Byte-level BPE first writes each byte of the UTF-8 text as one printable character (the byte table
below), then merges characters. The tokens of a text therefore tile its bytes exactly: offsets in
bytes are running sums of token lengths, offsets in characters count the bytes that start one, and
decoding looks the bytes of every id up and joins them. A character may be split over tokens; whole
texts decode to whole characters, and `StreamDecoder` holds back the bytes of an unfinished one.

Merges never cross the matches of the pre-token pattern, and a match stands for the same ids
wherever it occurs. So a task finds the matches of all texts of a batch with array operations (with the
pattern itself where a text has more than Latin letters), gives the library only matches that it has
not met before, and puts the ids of the texts together.
"""

from __future__ import annotations

import base64
import codecs
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, ragged, slices, small_batches, span_hashes, text_bytes

#: Characters outside these ranges may be classed differently by the libraries' Unicode versions;
#: texts that hold one go whole to the tokenizers library, which splits them itself.
UNSURE = "[^\\x00-\u0557\u2000-\u206f\u20a0-\u20bf\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]"
#: Pre-tokens a worker remembers; beyond it starts anew. Bounds its memory, never the result.
REMEMBERED = 2_000_000


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a line for each, base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def _last_pair(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are left of a token when merges of lower rank are done."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best, i = min(found)
        if best >= rank:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts) if len(parts) == 2 else None


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A tokenizers definition with the vocabulary of a rank file; it splits texts as the byte-level pattern does."""
    table = byte_table()
    name = lambda token: "".join(map(table.__getitem__, token))
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    pairs = (_last_pair(token, rank, ranks) for token, rank in ordered if len(token) > 1)
    return json.dumps(
        {
            "version": "1.0",
            "added_tokens": [],
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True},
            "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True},
            "model": {
                "type": "BPE",
                "vocab": {name(token): rank for token, rank in ordered},
                "merges": [[name(a), name(b)] for a, b in filter(None, pairs)],
            },
        }
    )


def token_bytes(definition: str) -> tuple[np.ndarray, np.ndarray]:
    """From a byte-level definition: the bytes of all tokens, and where those of each id start (ids + 1 numbers)."""
    back = {c: b for b, c in byte_table().items()}
    spec = json.loads(definition)
    by_id = {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in spec["model"]["vocab"].items()}
    by_id |= {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
    each = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    starts = np.zeros(len(each) + 1, np.int64)
    np.cumsum([len(x) for x in each], out=starts[1:])
    return np.frombuffer(b"".join(each), np.uint8), starts


class Places:
    """A hash table of 64-bit keys, numbered in the order in which they were added."""

    def __init__(self, bits: int = 16):
        self.size, self.room = 0, 1 << bits
        self.keys, self.numbers = np.zeros(self.room, np.uint64), np.zeros(self.room, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it was never added. Key 0 is not allowed."""
        out = np.full(len(keys), -1, np.int64)
        at = (keys & np.uint64(self.room - 1)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.numbers[at[hit]]
            on = ~hit & (there != 0)
            open_, at = open_[on], (at[on] + 1) & (self.room - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add keys that are all different and not there yet."""
        if 3 * (self.size + len(keys)) > 2 * self.room:
            old = self.keys != 0
            old_keys, old_numbers = self.keys[old], self.numbers[old]
            while 3 * (self.size + len(keys)) > 2 * self.room:
                self.room *= 2
            self.keys, self.numbers = np.zeros(self.room, np.uint64), np.zeros(self.room, np.int32)
            self._put(old_keys, old_numbers)
        self._put(keys, np.arange(self.size, self.size + len(keys), dtype=np.int32))
        self.size += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = (keys & np.uint64(self.room - 1)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            _, first = np.unique(at[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            self.keys[at[mine]], self.numbers[at[mine]] = keys[mine], numbers[mine]
            rest = np.ones(len(keys), bool)
            rest[mine] = False
            keys, numbers, at = keys[rest], numbers[rest], (at[rest] + 1) & (self.room - 1)


LETTER, DIGIT, BLANK, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = LETTER
_CLASS[[*range(48, 58)]] = DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
#: Bytes of characters that need the pattern itself: neither ASCII nor from U+00C0 to U+023F.
_FAR = np.zeros(256, bool)
_FAR[[0xC2, *range(0xC9, 0x100)]] = True
#: How many letters after an apostrophe go with it, by the letters.
_SHORT = {b"s": 1, b"t": 1, b"m": 1, b"d": 1, b"re": 2, b"ve": 2, b"ll": 2}


def near_latin(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold only ASCII and the letters from U+00C0 to U+023F; the signs for times and divided by are no letters."""
    far = _FAR[raw]
    signs = np.flatnonzero(raw[:-1] == 0xC3)
    far[signs[np.isin(raw[signs + 1], (0x97, 0xB7))]] = True
    before = np.concatenate([[0], np.cumsum(far)])
    return before[offsets[1:]] == before[offsets[:-1]]


def pretoken_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each match of the byte-level pattern starts, for rows that are near_latin.

    A match is a run of letters, digits or other signs, with one space before it if there is one; of other
    blanks a run, without its last character if something follows; an apostrophe that nothing goes
    before takes one of the short endings with it.
    """
    n = len(raw)
    kind = _CLASS[raw]
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    rows = offsets[:-1][offsets[:-1] < n]
    edge[rows] = True
    head = np.zeros(n + 1, bool)  # first byte of a row; the end counts as one
    head[rows] = True
    head[n] = True
    starts = np.flatnonzero(edge)
    stops = np.append(starts[1:], n)
    kinds = kind[starts]
    flag = edge.copy()
    inner = np.flatnonzero((kinds == BLANK) & ~head[stops])  # blanks that something follows
    last = stops[inner] - 1
    flag[last] = True
    spaced = inner[raw[last] == 0x20]
    flag[stops[spaced]] = False
    quote = np.flatnonzero((raw[starts] == 0x27) & (stops - starts == 1) & (kinds == OTHER) & ~head[stops] & flag[starts])
    quote = quote[kinds[np.minimum(quote + 1, len(kinds) - 1)] == LETTER]
    for k in quote.tolist():
        a, b = int(stops[k]), int(stops[k + 1])
        two = raw[a : min(a + 2, b)].tobytes()
        if size := _SHORT.get(two[:1], 0) or _SHORT.get(two, 0):
            flag[a] = False
            if a + size < b:
                flag[a + size] = True
    return np.flatnonzero(flag)


class Coder:
    """Encodes whole texts by their pre-tokens, each of which goes to the library when it is first met.

    Pre-tokens are known again by a 64-bit hash of their bytes. added: whether the definition's added tokens are looked for in the
    texts first, as the library does unless it is told that they are ordinary text; texts that hold one go to it whole.
    """

    def __init__(self, definition: str, pattern: str, direct: str = UNSURE, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = not added
        self.added = [x["content"].encode() for x in json.loads(definition).get("added_tokens", [])] if added else []
        self.merge = self.tokenizer.model.tokenize
        self.characters = byte_table()
        self.split = regex.compile(pattern).findall
        self.direct = re.compile(direct).search
        self.forget()

    def forget(self) -> None:
        self.known = Places()
        self.ids = np.zeros(1 << 16, np.uint16 if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.uint32)
        self.starts = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def learn(self, pieces: list[bytes], keys: np.ndarray) -> None:
        """Ids of pre-tokens that were met for the first time."""
        merge, table = self.merge, self.characters
        found = [[t.id for t in merge(x.decode("latin-1").translate(table))] for x in pieces]
        flat = np.fromiter(chain.from_iterable(found), self.ids.dtype)
        first, last = self.known.size, self.known.size + len(found)
        self.known.add(keys)
        if last >= len(self.starts):
            self.starts = np.resize(self.starts, 2 * last)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first : last + 1] = self.used + np.cumsum([0, *map(len, found)])
        self.used += len(flat)

    def with_added(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold an added token, whatever other tokens may do to it."""
        out = np.zeros(len(offsets) - 1, bool)
        data = raw.tobytes() if self.added else b""
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = True  # one that two rows make up marks one for nothing
                at = data.find(token, at + 1)
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the ids of each text; texts: a list or an Arrow array."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        raw, offsets = text_bytes(texts)
        simple = near_latin(raw, offsets)
        special = self.with_added(raw, offsets)
        simple[special] = False
        whole: dict[int, np.ndarray] = {}
        if simple.all():
            starts = pretoken_starts(raw, offsets)
        else:
            flag = np.zeros(len(raw) + 1, bool)
            easy = np.flatnonzero(simple)
            sizes = np.diff(offsets)
            to = ragged(offsets[easy], sizes[easy])
            flag[to[pretoken_starts(raw[to], np.concatenate([[0], np.cumsum(sizes[easy])]))]] = True
            for k in np.flatnonzero(~simple).tolist():
                text = raw[offsets[k] : offsets[k + 1]].tobytes().decode()
                if special[k] or self.direct(text):
                    whole[k] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                    flag[offsets[k]] = True  # a stand-in; its ids are replaced below
                else:
                    flag[offsets[k] + np.cumsum([0, *(len(x.encode()) for x in self.split(text))])[:-1]] = True
            starts = np.flatnonzero(flag)
        stops = np.append(starts[1:], len(raw)) if len(starts) else starts
        edges = np.searchsorted(starts, offsets)
        for k in whole:  # not to be learnt as one pre-token
            stops[edges[k]] = starts[edges[k]]
        keys = np.maximum(span_hashes(raw, starts, stops), np.uint64(1))
        if self.known.size > REMEMBERED:
            self.forget()
        which = self.known.find(keys)
        new = np.flatnonzero(which < 0)
        if len(new):
            unique, first = np.unique(keys[new], return_index=True)
            data = raw.tobytes()
            first = new[first]
            self.learn([data[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())], unique)
            which[new] = self.known.find(keys[new])
        begin = self.starts[which].astype(np.int64)
        lengths = self.starts[which + 1] - begin
        flat = self.ids[ragged(begin, lengths)].astype(np.uint32)
        edges = np.concatenate([[0], np.cumsum(lengths)])[edges]
        counts = np.diff(edges)
        if whole:
            flat = np.concatenate([whole.get(k, flat[edges[k] : edges[k + 1]]) for k in range(len(counts))])
            counts = np.asarray([len(whole[k]) if k in whole else c for k, c in enumerate(counts)], np.int64)
        return flat, counts


@lru_cache(maxsize=1)
def coder_of(definition: str, pattern: str, added: bool = False) -> Coder:
    """A worker process keeps its coder, and what that has learnt, from task to task."""
    return Coder(definition, pattern, added=added)


class Decoder:
    """Ids to bytes, by the reversed byte table."""

    def __init__(self, definition: str):
        self.data, self.starts = token_bytes(definition)

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.starts[ids.astype(np.int64) + 1] - self.starts[ids]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[ids], self.lengths(ids))]


class StreamDecoder:
    """Text of ids that come in pieces; the bytes of a character that is not complete wait for the rest."""

    def __init__(self, definition: str):
        self.decoder, self.text = Decoder(definition), codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.text.decode(self.decoder.decode(np.fromiter(ids, np.int64)).tobytes(), final=last)


def offsets(ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, starts: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """For each token of whole texts: where its bytes end, and the characters that begin before that end."""
    ends = np.cumsum(decoder.lengths(ids))
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    row = np.repeat(starts[:-1], counts)
    return ends - row, characters[ends] - characters[row]


def round_trip(df: DataFrame, definition: str, pattern: str, *, key: str = "doc_id", text: str = "text", decoded: bool = True, positions: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again: (key, n_tokens long, ids binary[, decoded binary][, byte_ends binary, char_ends binary]).

    ids are little-endian unsigned 32-bit numbers; decoded holds the bytes that the ids stand for;
    byte_ends and char_ends are as many little-endian 64-bit numbers, the end of each token in the text.
    A null or empty text has no ids and no bytes. Rows come back one for one, repeated rows and null
    keys included; other columns are not read, so their names don't matter. An empty table gives none.
    No shuffle: one pass over Arrow batches, in slices of bounded bytes. The definition travels with the
    tasks; its size is that of the vocabulary.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    fields = [("n_tokens", pa.int64()), ("ids", pa.binary())]
    fields += [("decoded", pa.binary())] if decoded else []
    fields += [("byte_ends", pa.binary()), ("char_ends", pa.binary())] if positions else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, decoder = coder_of(definition, pattern), Decoder(definition)
        for part in slices(batches):
            ids, counts = coder.encode(part.column(1))
            out = [part.column(0), pa.array(counts, pa.int64()), binary_rows(ids, counts)]
            if decoded:
                ends = np.concatenate([[0], np.cumsum(decoder.lengths(ids))])[np.concatenate([[0], np.cumsum(counts)])]
                out.append(binary_rows(decoder.decode(ids), np.diff(ends)))
            if positions:
                raw, starts = text_bytes(part.column(1))
                out += [binary_rows(x.astype(np.int64), counts) for x in offsets(ids, counts, raw, starts, decoder)]
            yield pa.RecordBatch.from_arrays(out, names=["key", *(n for n, _ in fields)])

    names = {"n_tokens": "long"}
    schema = f"key {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {names.get(n, 'binary')}" for n, _ in fields)
    return rows.mapInArrow(work, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, definition: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) of rows of ids, little-endian unsigned 32-bit. Null ids decode to no bytes."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(definition)
        for part in slices(batches):
            out = [decoder.decode(np.frombuffer(x or b"", "<u4")).tobytes() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["key", "decoded"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(work, f"key {df.schema[key].dataType.simpleString()}, decoded binary").withColumnRenamed("key", key)


def op9_byte_bpe(spark, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digest of ids and decoded bytes of every document; ranks: the path of a rank file."""
    if ranks is None:
        import public_tokenizers

        ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_json(read_ranks(ranks)), pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
