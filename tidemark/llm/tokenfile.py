"""Token ids of a corpus as entropy-coded block files, in ascending order of document id.

Layout under a path: `table` (one row: the shared frequency table) and `blocks`, whose files hold rows (part, seq, docs,
lengths, n_ids, block): whole documents in order, their ids as one block of `rans`. Parquet is the container, so that
any store that Spark writes to will do and a lost or repeated task leaves no half-written file. Each block can be
decoded alone, from any of its checkpoints; the ids before a part are sums over the light columns.

Ids are counted over the whole corpus before the table is made. Rows are dealt by ranges of (id, hash, row number), so
that one repeated document id doesn't land in one task.

Defined results: null ids come first, their rows are kept; null and empty text give the end id only; repeated rows are
all kept, in order of their ids' hash; a document is never cut over blocks; an empty table gives an empty file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import rans
from tidemark.llm._common import BATCH_BYTES, mapped, new_path, small, stored
from tidemark.llm.bpe import slices
from tidemark.llm.tokenize import packed, tokenizer

#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 20


def tokenise(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", dtype: str = "<u4") -> DataFrame:
    """(key, ids): packed ids of text, end_id after them; dtype tells how wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, 1, BATCH_BYTES):
                ids, ends = tokenizer(tokenizer_path).encode_column(some.column(1), [end_id])
                yield pa.RecordBatch.from_arrays([some.column(0), packed(ids.astype(dtype), ends)], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return mapped(df.select(key, text), run, f"`{key}` {kind}, ids binary", "tokenizer")


def _joined(ids: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The packed ids of all rows, one after another; where each row's begin, and the end of the last."""
    offsets = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset).astype(np.int64) // np.dtype(dtype).itemsize
    values = np.frombuffer(ids.buffers()[2] or b"", dtype)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def id_counts(ids: DataFrame, vocabulary: int, dtype: str) -> np.ndarray:
    """How often each id occurs: counted per task, then summed per id; at most vocabulary numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for b in batches:
            values, _ = _joined(b.column(0), dtype)
            for at in range(0, len(values), 1 << 20):
                n += np.bincount(values[at : at + (1 << 20)], minlength=vocabulary)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["id", "n"])

    rows = mapped(ids.select("ids"), run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes the documents' ids to path."""
    spark = df.sparkSession
    vocabulary = max(tokenizer(tokenizer_path).vocabulary, end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"  # half the bytes on disk and in shuffles
    ids = tokenise(df, tokenizer_path, end_id, key, text, dtype)
    ids = stored(ids.select("*", F.monotonically_increasing_id().alias("row")), "ids")
    freq = rans.quantised(id_counts(ids, vocabulary, dtype))
    spark.createDataFrame([(vocabulary, bytearray(freq.astype("<u8").tobytes()))], "vocabulary int, freq binary").coalesce(1).write.parquet(f"{path}/table")
    table = rans.Tables(freq)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs, sizes, packs, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            all_ids = np.concatenate(packs).astype(np.uint32)
            lengths = np.concatenate(sizes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.ListArray.from_arrays([0, len(lengths)], pa.concat_arrays(docs)),
                    pa.ListArray.from_arrays([0, len(lengths)], pa.array(lengths, pa.int64())),
                    pa.array([len(all_ids)], pa.int64()),
                    pa.array([rans.encode_block(all_ids, table)], pa.binary()),
                ],
                ["part", "seq", "docs", "lengths", "n_ids", "block"],
            )

        for b in batches:
            values, offsets = _joined(b.column(1), dtype)
            at = 0
            while at < b.num_rows:
                # Up to the document that fills the block.
                upto = min(b.num_rows, int(np.searchsorted(offsets, offsets[at] + BLOCK_IDS - held)))
                upto = max(upto, at + 1)
                docs.append(b.column(0).slice(at, upto - at))
                sizes.append(np.diff(offsets[at : upto + 1]))
                packs.append(values[offsets[at] : offsets[upto]])
                held += int(offsets[upto] - offsets[at])
                at = upto
                if held >= BLOCK_IDS:
                    yield block()
                    docs, sizes, packs, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield block()

    order = [F.col(key).asc_nulls_first(), F.xxhash64("ids"), "row"]
    ordered = ids.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "ids")
    blocks = mapped(ordered, run, f"part int, seq int, docs array<{kind}>, lengths array<bigint>, n_ids bigint, block binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) from the files: start counts the ids of all documents before it in the file."""
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").first()["freq"], "<u8")
    table = rans.Tables(freq)
    blocks = spark.read.parquet(f"{path}/blocks")
    light = blocks.select("part", "seq", "n_ids")
    # One row for each part, not for each document: what the one ordered window holds.
    parts = light.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = light.select("part", "seq", within.alias("within")).join(small(parts), "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                docs, lengths, block, base = (b.column(i)[row] for i in range(4))
                n = lengths.values.to_numpy()
                ids = rans.decode_block(block.as_buffer(), table)
                ends = np.cumsum(n)
                for at in range(0, len(n), 1000):
                    some, first = ends[at : at + 1000], ends[at] - n[at]
                    yield pa.RecordBatch.from_arrays([docs.values[at : at + 1000], pa.array(base.as_py() + some - n[at : at + 1000]), pa.array(n[at : at + 1000]), packed(ids[first : some[-1]], some - first)], [key, "start", "n_tokens", "ids"])

    rows = blocks.join(small(starts), ["part", "seq"]).select("docs", "lengths", "block", "base")
    return mapped(rows, run, f"`{key}` {kind}, start bigint, n_tokens bigint, ids binary")


def written(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes to the shared folder and reads back."""
    path = new_path(df.sparkSession, "tokens")
    write(df, path, tokenizer_path, end_id, key, text)
    return read(df.sparkSession, path, key)
