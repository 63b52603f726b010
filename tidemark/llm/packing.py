"""Best-fit packing of documents' tokens into sequences, with bounds that certify the number of sequences.

Items are dealt at random into groups of bounded size. Each group is packed by best-fit decreasing and gets a lower
bound on its bins from dual feasible functions. A group whose count meets its bound is done. Groups with a gap put the
items of their emptiest bins together with those of other such groups, and best-fit decreasing runs again over them;
the new bins are taken where they are fewer. Only lengths move, never ids.

Defined results: null and empty text is one piece with the end id; longer documents than the capacity are cut into full
pieces of which the first may be shorter; repeated rows are pieces of their own; an empty table gives no rows; a null
document id is kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import mapped, stored
from tidemark.llm.bpe import slices
from tidemark.llm.tokenize import packed, tokenizer

#: Items in a group, on average; groups that exchange items at a time.
GROUP, FAN = 4096, 8
#: Bytes of text whose ids are made at once; more take more memory and no less time.
SLICE_BYTES = 1_500_000


def _cut(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, capacity: int, key: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for some in slices(b, 1, SLICE_BYTES):
            ids, ends = tokenizer(tokenizer_path).encode_column(some.column(1), [end_id])
            n = np.diff(ends, prepend=0)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            # All pieces but the first are full.
            start = np.where(piece > 0, n[row] - (count[row] - piece) * capacity, 0)
            length = np.where(piece > 0, capacity, n[row] - (count[row] - 1) * capacity)
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), packed(ids, np.cumsum(length))], [key, "piece", "start", "length", "ids"])


def pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids): the documents' ids with end_id after them, cut to capacity; ids packed as u32."""

    kind = df.schema[key].dataType.simpleString()
    return mapped(df.select(key, text), lambda batches: _cut(batches, tokenizer_path, end_id, capacity, key), f"`{key}` {kind}, piece int, start bigint, length bigint, ids binary", "tokenizer")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of: total size; the functions floor((k+1)x)/k; those that cut off large and small items."""
    if not len(lengths):
        return 0
    h = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((h * x).sum()) // capacity)
    for k in range(1, 30):
        y = (k + 1) * x
        # In units of 1 / (k * capacity): x itself where (k+1)x is whole, else its floor over k.
        value = np.where(y % capacity == 0, k * x, (y // capacity) * capacity)
        best = max(best, -(-int((h * value).sum()) // (k * capacity)))
    count, total = np.cumsum(h), np.cumsum(h * x)
    cut = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - cut]
    middle = total[capacity - cut] - total[cut - 1]
    return max(best, int((large - (-middle // capacity)).max()))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item by best-fit decreasing, and the number of bins; ties in the order given."""
    n = len(lengths)
    bin_of, offset, bins = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r free
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            at = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
        else:
            r, at, bins = capacity, bins, bins + 1
        bin_of[i], offset[i] = at, capacity - r
        if r > size:
            free[r - size].append(at)
            mask |= 1 << (r - size)
    return bin_of, offset, bins


def pack(items: DataFrame, capacity: int = 2048, length: str = "length", group: int = GROUP, fan: int = FAN) -> DataFrame:
    """items with sequence_id, offset, and bins and bound of the group that packed them last.

    Columns of these names are replaced. Lengths must be from 1 to capacity.
    """
    kept = [x for x in items.columns if x not in ("sequence_id", "offset", "bins", "bound")]
    # What is the caller's stays in one struct, so that no name of theirs meets one of ours.
    own = F.struct(*(F.col(f"`{x}`") for x in kept)).alias("own")
    base = stored(items.select(own, F.col(f"`{length}`").cast("bigint").alias("length"), F.monotonically_increasing_id().alias("_row")), "items")
    n = base.count()
    schema = T.StructType([*base.schema, *(T.StructField(x, T.LongType()) for x in ("sequence_id", "offset", "bins", "bound")), T.StructField("_group", T.LongType()), T.StructField("_open", T.BooleanType())])

    plain, made_names = base.columns, schema.names[len(base.columns) :]

    def packer(round_no: int):
        def run(t: pa.Table) -> pa.Table:
            t = t.combine_chunks().sort_by([("length", "descending"), ("_row", "ascending")])
            sizes = t.column("length").to_numpy()
            name = t.column("_group")[0].as_py()
            bin_of, offset, bins = best_fit(sizes, capacity)
            bound = lower_bound(sizes, capacity)
            seq = (round_no << 58) | (name << 22) | bin_of
            if round_no:
                old, there = np.unique(t.column("sequence_id").to_numpy(), return_inverse=True)
                if bins >= len(old):
                    seq, offset, bin_of, bins = t.column("sequence_id").to_numpy(), t.column("offset").to_numpy(), there, len(old)
            filled, held = np.bincount(bin_of, sizes, bins), np.bincount(bin_of, minlength=bins)
            order = np.argsort(filled, kind="stable")
            some = order[: max(2, int(np.searchsorted(np.cumsum(held[order]), group // fan)))] if bins > bound else order[:1]
            loose = np.isin(bin_of, some[filled[some] < capacity])
            made = {"sequence_id": seq, "offset": offset, "bins": np.full(len(sizes), bins), "bound": np.full(len(sizes), bound), "_group": np.full(len(sizes), name), "_open": loose}
            return pa.Table.from_arrays([*(t.column(x) for x in plain), *(pa.array(made[x]) for x in made_names)], [*plain, *made_names])

        return run

    def dealt(df: DataFrame, key: str, groups: int, round_no: int) -> DataFrame:
        named = df.withColumn("_group", F.pmod(F.xxhash64(key, F.lit(round_no)), F.lit(max(1, groups))))
        return named.groupBy("_group").applyInArrow(packer(round_no), schema)

    state, done = stored(dealt(base, "_row", -(-n // group), 0), "packed"), []
    for round_no in itertools.count(1):
        gaps, items_left = state.where("_open").agg(F.count_distinct("_group"), F.count("*")).first()
        if gaps < 2:
            break
        done.append(state.where(~F.col("_open")))
        # Each round leaves a part of the groups; the last ones meet in one, as do all whose items fit in one.
        groups = 1 if items_left <= group else -(-gaps // fan)
        state = stored(dealt(state.where("_open"), "_group", groups, round_no), "packed")
    for x in done:
        state = state.unionByName(x)
    return state.select(*(F.col("own").getField(x).alias(x) for x in kept), "sequence_id", "offset", "bins", "bound")
