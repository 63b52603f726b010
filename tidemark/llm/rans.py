"""Static range asymmetric numeral system over token ids, in blocks of interleaved lanes.

One frequency table, quantised to 2**SCALE slots, serves all blocks. A block deals its ids to LANES coder states in
turn; one numpy step advances all lanes, and a lane that runs over writes one 32-bit word. States at every
CHECKPOINT-th step are kept with the position in the words, so that a reader can start there. Header, words and ids
each carry a CRC-32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LANES = 1024
CHECKPOINT = 512
LOW = np.uint64(1 << 31)
MAGIC = b"TMR1"
HEAD = struct.Struct("<4sIQIIIII")  # magic, lanes, ids, words, checkpoints, crc of ids, crc of body, step of checkpoints


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for each counted symbol, near proportion otherwise."""
    total, size = int(counts.sum()), 1 << SCALE
    if total == 0:
        counts, total = np.ones_like(counts), len(counts)
    if np.count_nonzero(counts) > size:
        raise ValueError("more symbols than slots")
    exact = counts * (size / total)
    freq = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    rest = size - int(freq.sum())
    order = np.argsort(-(exact - freq), kind="stable")
    order = order[counts[order] > 0]
    if rest > 0:
        freq[order[0]] += rest - min(rest, len(order))
        freq[order[: min(rest, len(order))]] += 1
    while rest < 0:  # take from the largest, never below 1
        most = np.argsort(-freq, kind="stable")[: max(1, min(-rest, int((freq > 1).sum())))]
        freq[most] -= 1
        rest += len(most)
    return freq.astype(np.uint64)


class Tables:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def encode_block(ids: np.ndarray, t: Tables) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written, shift = 0, np.uint64(63 - SCALE)
    for step in range(steps - 1, -1, -1):
        some = ids[step * LANES : (step + 1) * LANES]
        f, x = t.freq[some], state[: len(some)]
        if not f.all():
            raise ValueError("an id that the table gives no frequency")
        over = x >= (f << shift)
        if over.any():
            words = (x[over] & np.uint64(0xFFFFFFFF)).astype("<u4")
            out.append(words[::-1])
            written += len(words)
            x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: len(some)] = (q << np.uint64(SCALE)) + (x - q * f) + t.start[some]
        if step and step % CHECKPOINT == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(out)[::-1] if out else np.empty(0, "<u4")
    # Positions from the front of what a reader sees: the final states come first.
    marks = [(written - at, s) for at, s in marks[::-1]]
    body = state.astype("<u8").tobytes() + b"".join(struct.pack("<I", at) + s.astype("<u8").tobytes() for at, s in marks) + words.tobytes()
    head = HEAD.pack(MAGIC, LANES, n, len(words), len(marks), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body), CHECKPOINT)
    return head + body


def decode_block(block: bytes, t: Tables, part: int | None = None) -> np.ndarray:
    """Ids of a block, or of its part-th run of CHECKPOINT steps only."""
    magic, lanes, n, n_words, n_marks, crc_ids, crc_body, every = HEAD.unpack_from(block)
    body = memoryview(block)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc_body:
        raise ValueError("damaged block")
    state = np.frombuffer(body, "<u8", lanes).astype(np.uint64)
    at, size = 8 * lanes, 4 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, at + n_marks * size).astype(np.uint64)
    steps = -(-n // lanes)
    first, last, pos = 0, steps, 0
    if part is not None:
        first, last = part * every, min(steps, (part + 1) * every)
        if part:
            mark = at + (part - 1) * size
            pos = struct.unpack_from("<I", body, mark)[0]
            state = np.frombuffer(body, "<u8", lanes, mark + 4).astype(np.uint64)
    out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
    mask, scale, wide = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for step in range(first, last):
        k = min(lanes, n - step * lanes)
        x = state[:k]
        slot = x & mask
        some = t.symbol[slot]
        out[(step - first) * lanes : (step - first) * lanes + k] = some
        x = t.freq[some] * (x >> scale) + slot - t.start[some]
        under = x < LOW
        m = int(np.count_nonzero(under))
        if m:
            x[under] = (x[under] << wide) | words[pos : pos + m]
            pos += m
        state[:k] = x
    if part is None and zlib.crc32(out.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("ids differ from their checksum")
    return out
