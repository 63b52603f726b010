"""Texts to ids with the tokenizers library, each distinct chunk of a batch encoded once.

A chunk is a run of characters other than white space, with one blank before it where the tokenizer keeps blanks, or a
run of white space; it also ends between a letter, a digit and a sign (of those in _KIND). The pre-tokenizers in use
never join characters over a chunk's bounds, so the chunks' ids one after another are the text's ids.

Bounds of chunks are found on a batch's bytes at once, and the ids of its chunks are put together by an index, so that
Python sees each distinct chunk of a batch once. Strings of special tokens in a text are ordinary text, as the
tokenizers' description has it.

Null and empty text give no ids.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm._common import worker_store
from tidemark.llm.bpe import WHITE_SPACE, portions

#: Chunks that a worker keeps; what comes after that is encoded for its batch only.
KEPT = 700_000
_SPACES = [c.encode() for c in map(chr, range(0x3001)) if re.match(f"[{WHITE_SPACE}]", c)]
_BLANK = np.zeros(256, bool)
_BLANK[[c[0] for c in _SPACES if len(c) == 1]] = True
#: 1 for letters, 2 for digits, 3 for signs, but the apostrophe, which pre-tokenizers join with letters; 0 for all else.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = [1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(33, 127)]
_KIND[ord("'")] = 0
_WIDE = {n: np.array([int.from_bytes(c, "big") for c in _SPACES if len(c) == n]) for n in (2, 3)}


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to characters that are white space."""
    white = _BLANK[data]
    for n, codes in _WIDE.items():
        lead = np.zeros(256, bool)
        lead[codes >> (8 * (n - 1))] = True
        at = np.flatnonzero(lead[data])
        if len(at):
            value = sum(data[at + k].astype(np.int64) << (8 * (n - 1 - k)) for k in range(n))
            at = at[np.isin(value, codes)]
            for k in range(n):
                white[at + k] = True
    return white


def _kinds(data: np.ndarray) -> np.ndarray:
    """_KIND of each byte, with 1 for those of U+00C0 to U+00FF that are letters."""
    kind = _KIND[data]
    at = np.flatnonzero(data == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kind[at] = kind[at + 1] = 1
    return kind


def _chunks(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of texts (bytes data, cut at offsets) start; their own bytes and offsets in those."""
    white = _white(data)
    begins = np.zeros(len(data), bool)
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    after = np.concatenate([[False], white[:-1]])
    word = ~white & (after | begins)
    kind = _kinds(data)
    turn = np.concatenate([[False], (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)])
    if words:
        at = np.flatnonzero(word | turn)
        own = data[~white]
        return at, own, np.append((np.cumsum(~white) - 1)[at], len(own))
    start = begins | (white & ~after) | turn
    at = np.flatnonzero(word & ~begins)
    blank = data[at - 1] == 32
    start[at[blank] - 1] = True
    start[at[~blank]] = True
    last = at[~blank] - 1  # the white space character before the word is a chunk
    for _ in range(2):
        last = np.where(data[last] & 0xC0 == 0x80, last - 1, last)
    start[last] = True
    at = np.flatnonzero(start)
    return at, data, np.append(at, len(data))


class ChunkTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.of = Tokenizer.from_file(path)
        self.of.encode_special_tokens = True  # their strings in a text are ordinary text
        #: With an end-of-word suffix white space and case are dropped, else a blank belongs to what follows.
        self.words = bool(self.of.model.end_of_word_suffix)
        if not self.words and not isinstance(self.of.pre_tokenizer, pre_tokenizers.ByteLevel):
            raise ValueError("a tokenizer that splits at white space is needed")
        self.vocabulary = self.of.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}

    def _packs(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these distinct chunks."""
        known = self.known
        out = list(map(known.get, chunks))
        at = [i for i, x in enumerate(out) if x is None]
        if not at:
            return out
        rest = [chunks[i] for i in at]
        made = []
        for first in range(0, len(rest), 2_000):
            made += [array("I", x.ids).tobytes() for x in self.of.encode_batch_fast(rest[first : first + 2_000], add_special_tokens=False)]
        for i, x in zip(at, made, strict=True):
            out[i] = x
        if len(known) < KEPT:
            known.update((x, y) for x, y in zip(rest, made, strict=True) if len(x) <= 100)
        return out

    def encode_column(self, texts: pa.Array, end: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each with end after it; where each text's ids end."""
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        at, own, bounds = _chunks(data, offsets, self.words)
        chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(own))).dictionary_encode()
        packs = self._packs(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        packs.append(array("I", end or []).tobytes())
        sizes = np.fromiter(map(len, packs), np.int64, len(packs)) // 4
        starts, flat = np.cumsum(sizes, dtype=np.int64) - sizes, np.frombuffer(b"".join(packs), "<u4")
        ends = np.searchsorted(at, offsets[1:])
        code = np.insert(chunks.indices.to_numpy(), ends, len(packs) - 1)
        n = sizes[code]
        upto = np.cumsum(n, dtype=np.int64)
        at = np.repeat(starts[code] - (upto - n), n)
        at += np.arange(len(at))
        ids = flat[at]
        return ids, upto[ends + np.arange(len(ends))]


def tokenizer(path: str) -> ChunkTokenizer:
    return worker_store(("tokenizer", path), lambda: ChunkTokenizer(path))


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each run of ids that ends there."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * ids.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def encoded(path: str, texts: list[str | None]) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, a bounded number of characters at a time."""
    for some in portions(texts):
        yield from packed(*tokenizer(path).encode_column(pa.array(some, pa.large_string()))).to_pylist()
