"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token with which its encoding can end. Storing that token for
each prefix makes the encoding a walk backwards, makes appends exact (old entries never change) and lets an edit
re-encode only until the entries agree with the old ones over one longest-token length.

A candidate token is the valid last one if, put after the last token of the prefix before it, the merges would still
leave the boundary between the two alone; that is decided from the pair itself by undoing merges in descending rank.

Defined results: null and empty text give no ids; repeated rows each get their own result; text of any length is
encoded whole; other columns pass through unless they are named like an output, which then replaces them.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm._common import mapped, worker_store

# The characters with the Unicode property White_Space, as a class body.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: An optional space and a run of other characters, or white space; no match of the usual pattern crosses its bounds.
CHUNK = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
#: Entries that a worker keeps for repeated chunks and pieces; what comes after that is encoded for its batch only.
CHUNKS_KEPT, PIECES_KEPT, JOINS_KEPT = 150_000, 300_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PrefixBPE:
    """Encoder for one rank table; states are lists with the last token of each prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(sorted((i, b) for b, i in ranks.items()))
        self.longest = max(map(len, ranks))
        self.merged: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.joins: dict[tuple[int, int], bool] = {}
        for token, data in self.bytes_of.items():
            self.left[token] = self.right[token] = token
            for cut in range(1, len(data)):
                a, b = ranks.get(data[:cut], token), ranks.get(data[cut:], token)
                if a < token and b < token and self._stays(a, b):
                    self.merged[a, b] = token
                    self.left[token], self.right[token] = a, b
                    break
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        #: Finds all tokens that end at a byte, the longest first.
        self.ends = ahocorasick.Automaton()
        for data, token in ranks.items():
            self.ends.add_word(data.decode("latin-1"), token)
        self.ends.make_automaton()

    def _stays(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together gives just a, b."""
        made_later = 1 << 62
        while True:
            if self.merged.get((a, b), 1 << 62) < made_later:
                return False
            if a > b:  # a was made last: before that its right part stood at the boundary
                made_later, part = a, self.right[a]
                if part != a:
                    a = part
                    continue
                made_later, part = b + 1, self.left[b]
                if part == b:
                    return True
                b = part
            else:
                made_later, part = b + 1, self.left[b]
                if part != b:
                    b = part
                    continue
                made_later, part = a, self.right[a]
                if part == a:
                    return True
                a = part

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Appends to last the entries of all prefixes of data that are longer than those it covers."""
        joins, stays, size, done = self.joins, self._stays, self.size, len(last)
        if len(joins) > JOINS_KEPT:
            joins.clear()
        for end, token in self.ends.iter(data.decode("latin-1")):
            if end < done:
                continue
            if begin := end + 1 - size[token]:
                pair = (last[begin - 1], token)
                fits = joins.get(pair)
                if fits is None:
                    fits = joins[pair] = stays(*pair)
                if not fits:
                    continue
            last.append(token)
            done += 1
        if done < len(data):
            raise ValueError(f"no token for byte {data[done]}")
        return last

    def ids(self, last: list[int]) -> list[int]:
        out, end, of = [], len(last), self.bytes_of
        while end:
            out.append(last[end - 1])
            end -= len(of[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.ids(self.extend(data, []))

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int], int]:
        """data with [start, stop) replaced, its entries, and how many of them were computed anew.

        An entry follows from the longest - 1 bytes and entries before it; once that many agree with the old ones
        behind the edit, so do all after them.
        """
        out, state = data[:start] + new + data[stop:], last[:start]
        back, step = stop - start - len(new), max(16, self.longest)
        while len(state) < len(out):
            upto = min(len(out), len(state) + step)
            # What is looked at begins a longest token before the first open entry.
            self._more(out, upto, state)
            agree = 0
            for at in range(len(state) - 1, start + len(new) - 1, -1):
                if at + back >= len(last) or last[at + back] != state[at]:
                    break
                agree += 1
            if agree >= self.longest:
                return out, state + last[len(state) + back :], len(state) - start
        return out, state, len(state) - start

    def _more(self, data: bytes, upto: int, last: list[int]) -> None:
        """extend for the entries up to upto, looking at no more bytes than they need."""
        off = max(0, len(last) - self.longest)
        for end, token in self.ends.iter(data[off:upto].decode("latin-1")):
            end += off
            if end < len(last):
                continue
            begin = end + 1 - self.size[token]
            if begin == 0 or self._stays(last[begin - 1], token):
                last.append(token)

    def decode(self, ids) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


class TextEncoder:
    """Pieces by a pattern, each encoded by itself; keeps a bounded store of what repeats."""

    def __init__(self, bpe: PrefixBPE, pattern: str):
        self.bpe, self.pieces = bpe, regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # The usual pattern's matches have white space only alone or as one leading blank.
        self.coarse = r"\s+(?!\S)|\s+" in pattern and " ?" in pattern
        self.chunks: dict[str, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Encodes pieces in sorted order, so that each goes on from the prefix it shares with the one before it."""
        bpe, out, before, last = self.bpe, {}, b"", []
        for data in sorted(pieces):
            whole = bpe.ranks.get(data)
            if whole is not None:
                out[data] = whole.to_bytes(4, "little")
                continue
            same, most = 0, min(len(last), len(data))
            while same < most and data[same] == before[same]:
                same += 1
            del last[same:]
            before = data
            out[data] = array("I", bpe.ids(bpe.extend(data, last))).tobytes()
        if len(self.known) < PIECES_KEPT:
            self.known.update(out)
        return out

    def split(self, chunk: str) -> list[str]:
        """The pattern's matches; letters, with one sign after them or none, need no pattern."""
        if self.coarse:
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                return [chunk]
            if word and word[-1] in ".,;:!?" and word[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.pieces.findall(chunk)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        chunks, known = self.chunks, self.known
        cut = CHUNK.findall if self.coarse else self.pieces.findall
        parts = [cut(x) if x else [] for x in texts]
        new = {x: None for x in set().union(*parts) if x not in chunks}
        learnt = self.learn({p for x in new for p in map(str.encode, self.split(x)) if p not in known})
        for x in new:
            new[x] = b"".join([known[p] if p in known else learnt[p] for p in map(str.encode, self.split(x))])
        full = len(chunks) >= CHUNKS_KEPT
        chunks.update(new)
        get = chunks.__getitem__
        out = [b"".join(map(get, x)) for x in parts]
        if full:
            for x in new:
                del chunks[x]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str, pattern: str) -> TextEncoder:
    return worker_store(("bpe", path, pattern), lambda: TextEncoder(PrefixBPE(read_ranks(path)), pattern))


def portions(texts: list[str | None], chars: int = 3_000_000) -> Iterator[list[str | None]]:
    """Runs of texts that end as soon as they hold so many characters."""
    some, n = [], 0
    for x in texts:
        some.append(x)
        n += len(x or "")
        if n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


def slices(b: pa.RecordBatch, column: int, size: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows that end as soon as the column's values hold so many bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size)) + 1
        yield b.slice(at, upto - at)
        at = upto


def _mapped(df: DataFrame, column: str, out: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """df with out: what make()'s function gives for column's values; a few MB of them at a time."""
    kept = [x for x in df.columns if x != out]
    at = kept.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for some in slices(b, at):
                made = pa.array(f(some.column(at).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, made], [*kept, out])

    schema = T.StructType([*(df.schema[x] for x in kept), T.StructField(out, T.BinaryType())])
    return mapped(df.select(*(f"`{x}`" for x in kept)), run, schema, "bpe")


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with out: the ids of text as packed little-endian unsigned 32-bit integers (binary).

    Map-only: no shuffle; a worker holds the rank table, bounded stores and one Arrow batch.
    """
    return _mapped(df, text, out, lambda: encoder(ranks_path, pattern).encode_all)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with out: the bytes of packed ids; null ids give null, an unknown id fails."""

    def make():
        ranks = read_ranks(ranks_path)
        of = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            of[i] = data
        get = of.__getitem__
        return lambda packs: [None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in packs]

    return _mapped(df, ids, out, make)
