"""BPE, token files, packing: against the libraries, round trips and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, rans, tokenfile, tokenize

RANKS, BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", " ", "a", "\n\n x", "don't we'll 'S", "x" * 5000, "naïve Ünïcode ÿ 漢字かな 😀", "á İ!  b c\x1cd", "<|endoftext|> 12 345", "tab\t\tend  ", "🙂" * 300]


def some_texts(n=60, seed=1):
    rnd = random.Random(seed)
    alphabet = list("abcdehnorst  \n.,'!09ÉßñΣ") + ["the", " and", "ing", "\t", " ", "…"]
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400))) for _ in range(n)]


def u32(x):
    return np.frombuffer(x, "<u4").tolist()


def test_bpe_equals_the_library():
    own = bpe.encoder(RANKS, P.PATTERN)
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=own.bpe.ranks, special_tokens={})
    texts = some_texts()
    assert [u32(x) for x in own.encode_all(texts)] == [lib.encode_ordinary(x) for x in texts]


def test_prefixes_allow_appends_and_edits():
    b, rnd = bpe.encoder(RANKS, P.PATTERN).bpe, random.Random(2)
    for _ in range(150):
        data = "".join(rnd.choice(["the", "tion", "q", "é", "x1", "ou"]) for _ in range(rnd.randrange(1, 60))).encode()
        whole = b.extend(data, [])
        k = rnd.randrange(len(data) + 1)
        assert b.extend(data, whole[:k]) == whole
        lo = rnd.randrange(len(data) + 1)
        hi = rnd.randrange(lo, len(data) + 1)
        new = rnd.choice([b"", b"zz", b"the", b"\xff"])
        out, state, _ = b.edit(data, whole, lo, hi, new)
        assert out == data[:lo] + new + data[hi:] and state == b.extend(out, [])
        assert b.decode(b.ids(state)) == out
    long = b"thonenouthe" * 3000
    out, state, done = b.edit(long, b.extend(long, []), 500, 503, b"abc")
    assert done < 2000 and state == b.extend(out, [])


def test_bpe_frame(spark):
    rows = [(i, x) for i, x in enumerate(some_texts(5))] + [(900, None), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    for r in got.collect():
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_equal_the_library(path):
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    texts = some_texts(80, 3)
    assert [u32(x) for x in tokenize.encoded(path, texts)] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert list(tokenize.encoded(path, [None, ""])) == [b"", b""]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 3000, 700_000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.uint32)
    t = rans.Tables(rans.quantised(np.bincount(ids, minlength=5000) + (n == 0)))
    block = rans.encode_block(ids, t)
    assert (rans.decode_block(block, t) == ids).all()
    parts = -(-(-(-n // rans.LANES)) // rans.CHECKPOINT)
    assert n == 0 or (np.concatenate([rans.decode_block(block, t, k) for k in range(parts)]) == ids).all()


def test_rans_finds_damage():
    ids = np.arange(500, dtype=np.uint32)
    t = rans.Tables(rans.quantised(np.ones(500, np.int64)))
    block = bytearray(rans.encode_block(ids, t))
    block[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(bytes(block), t)


@pytest.mark.parametrize("counts", [[1], [1, 0, 5], [10**9, 1, 1], [1] * 49408])
def test_frequencies(counts):
    f = rans.quantised(np.array(counts, np.int64))
    assert f.sum() == 1 << rans.SCALE and ((f > 0) == (np.array(counts) > 0)).all()


def test_token_file(spark):
    rows = [(5, "b c"), (2, None), (9, "x" * 300), (None, "no id"), (2, ""), (7, "the the")]
    lib = Tokenizer.from_file(WORDS)
    want, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = tokenfile.written(df, WORDS, 1).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert tokenfile.written(df.limit(0), WORDS, 1).count() == 0


def test_best_fit_and_bounds():
    rng = np.random.default_rng(4)
    for capacity, n in ((10, 7), (100, 200), (2048, 3000)):
        sizes = rng.integers(1, capacity + 1, n)
        bin_of, offset, bins = packing.best_fit(sizes, capacity)
        fill = np.bincount(bin_of, sizes, bins)
        assert fill.max() <= capacity and packing.lower_bound(sizes, capacity) <= bins
        for b in range(bins):
            at = np.flatnonzero(bin_of == b)
            at = at[np.argsort(offset[at])]
            assert (offset[at] == np.concatenate([[0], np.cumsum(sizes[at])[:-1]])).all()
    assert packing.lower_bound(np.full(7, 6), 10) == 7 and packing.lower_bound(np.array([5, 5, 4, 4, 4]), 12) == 2
    # Against all partitions of small cases.
    def least(items, bins):
        if not items:
            return len(bins)
        out = len(bins) + len(items)
        for i in range(len(bins)):
            if bins[i] + items[0] <= 10:
                out = min(out, least(items[1:], [*bins[:i], bins[i] + items[0], *bins[i + 1 :]]))
        return min(out, least(items[1:], [*bins, items[0]]))

    for _ in range(30):
        items = rng.integers(1, 11, 7)
        assert packing.lower_bound(items, 10) <= least(items.tolist(), [])


def test_pieces_encode_small_slices(monkeypatch):
    texts = [*some_texts(), *("some words " * 20_000 for _ in range(30)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    whole, sizes = tokenize.ChunkTokenizer(BYTES), []

    class Watched:
        def encode_column(self, column, end):
            sizes.append(sum(len((x or "").encode()) for x in column.to_pylist()))
            return whole.encode_column(column, end)

    monkeypatch.setattr(packing, "tokenizer", lambda path: Watched())
    got = [r for b in packing._cut([batch], BYTES, 0, 64, "doc_id") for r in b.to_pylist()]
    ids, ends = whole.encode_column(batch.column(1), [0])
    assert b"".join(r["ids"] for r in got) == ids.tobytes() and sum(r["length"] for r in got) == ends[-1]
    assert sum(sizes) == sum(len((x or "").encode()) for x in texts) and max(sizes) <= packing.SLICE_BYTES + 220_000 < 2_000_000


def test_packing(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["the", "of", "and", "tion"]) for _ in range(rnd.randrange(1, 90)))) for i in range(300)] + [(400, None), (401, "a " * 200), (402, ""), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = packing.pieces(df, BYTES, 0, capacity=64)
    got = packing.pack(cut.select("doc_id", "piece", "start", "length"), 64, group=50, fan=3).collect()
    total = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total.get(r.sequence_id, 0)
        total[r.sequence_id] = r.offset + r.length
    assert max(total.values()) <= 64 and len(total) <= 1.05 * sum(total.values()) / 64 + 2
    lib = Tokenizer.from_file(BYTES)
    ids = {401: [*lib.encode("a " * 200, add_special_tokens=False).ids, 0]}
    p = sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in cut.where("doc_id = 401").collect())
    assert [x[2] for x in p[1:]] == [64] * (len(p) - 1) and sum((u32(x[3]) for x in p), []) == ids[401]
    assert packing.pack(cut.select("doc_id", "piece", "start", "length").limit(0), 64).count() == 0
