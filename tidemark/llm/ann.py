"""Nearest neighbours by cosine from one-bit codes of randomly rotated vectors.

A unit vector is rotated and kept as the signs of its components, with the inner product of the vector and its code as
correction. From a code and a rotated query follow an estimate of their cosine and a bound on its error that holds with
high probability; only vectors whose estimate plus bound reaches the k-th best exact cosine so far are compared in
full. The rotation is random, so nothing is fitted, and every row is in the index.

Queries go over all rows in blocks of bounded size, each block sent to the tasks that read the index; a task keeps its
k best for each query, and these meet in one window for each query.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows with a null id, and vectors
of another length than the query's take no part; ties go to the smaller id; ids that repeat count once, with their best
row; with fewer candidates than k all are returned; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import mapped, stored
from tidemark.llm.vectors import dots, matrix, norms, usable

#: Bound on the queries sent to all tasks at once; vectors that a task looks at together.
QUERY_BLOCK, CHUNK = 4096, 4096


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and each vector's inner product with its code."""
    turned = (x / norms(x)[:, None]) @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def index(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, vec, dim, code, correction) of the rows that take part."""
    from tidemark.llm.vectors import packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array(b.column(1).value_lengths().to_pylist(), np.int64)
            for dim in np.unique(dims):
                some = b.take(pa.array(np.flatnonzero(dims == dim)))
                bits, corr = codes(matrix(some.column(1)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(packed(some.column(1)), pa.binary()), pa.array(np.full(some.num_rows, dim, np.int32)), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(corr)], [key, "vec", "dim", "code", "correction"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(usable(F.col(vec)) & F.col(key).isNotNull()).select(key, F.col(vec).cast("array<double>"))
    return mapped(rows, run, f"`{key}` {kind}, vec binary, dim int, code binary, correction double")


class Best:
    """The k best of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.q, self.id, self.score = np.empty(0, np.int64), None, np.empty(0)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        ids = ids if self.id is None else np.concatenate([self.id, ids])
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
        # An id that repeats counts once, with its best row.
        order = np.lexsort((-score, ids, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, score = q[first], ids[first], score[first]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        begins = np.searchsorted(q, q)
        rank = np.arange(len(q)) - begins
        kept = rank < self.k
        self.q, self.id, self.score = q[kept], ids[kept], score[kept]
        full = rank[kept] == self.k - 1
        self.least[self.q[full]] = self.score[full]


def scan(best: Best, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, code: np.ndarray, corr: np.ndarray, sigmas: float) -> None:
    """Compares the queries with a chunk of vectors; what is compared in full goes to best."""
    dim = x.shape[1]
    qn, xn = norms(queries), norms(x)
    turned = (queries / qn[:, None]) @ rotation(dim).T
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = (turned.astype(np.float32) @ signs.T) / (np.sqrt(dim) * corr).astype(np.float32)
    error = (sigmas * np.sqrt(np.maximum(0.0, 1 - corr**2)) / corr / np.sqrt(max(1, dim - 1))).astype(np.float32)
    estimate[query_ids[:, None] == ids[None, :]] = -np.inf

    # Single precision first, whose error for unit vectors is below slack; what may be among the k best is exact then.
    q32, x32 = (queries / qn[:, None]).astype(np.float32), (x / xn[:, None]).astype(np.float32)
    slack = 1e-5 + 2e-7 * dim

    def compare(some: np.ndarray) -> None:
        left, right = [], []
        for i in np.flatnonzero(some.any(axis=1)):
            rows = np.flatnonzero(some[i])
            rows = rows[x32[rows] @ q32[i] >= best.least[i] - slack]
            left.append(np.full(len(rows), i))
            right.append(rows)
        if not left:
            return
        q, v = np.concatenate(left), np.concatenate(right)
        for at in range(0, len(q), 200_000):
            a, b = q[at : at + 200_000], v[at : at + 200_000]
            best.add(a, ids[b], dots(queries[a], x[b]) / (qn[a] * xn[b]))

    few = min(4 * best.k, len(ids))
    top = np.argpartition(-estimate, few - 1, axis=1)[:, :few]
    done = np.zeros(estimate.shape, bool)
    np.put_along_axis(done, top, True, axis=1)
    # The most promising first, as they raise what the others must reach; none that can't be among the k best.
    hopeful = lambda: (estimate + error >= best.least[:, None].astype(np.float32) - 1e-5) & (estimate > -np.inf)
    done &= hopeful()
    compare(done)
    compare(hopeful() & ~done)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at least, but for the last: what a small batch compares in full doesn't pay."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def search(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vec: str = "embedding", sigmas: float = 3.0, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all other rows for each row where is_query holds."""
    kind = df.schema[key].dataType.simpleString()
    table = stored(index(df, key, vec), "codes")
    asked = table.where(is_query).select(key, "dim", "vec")
    blocks = -(-asked.count() // block)
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else asked
        got = part.collect()  # about one block of queries, a bounded set
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {r["dim"] for r in got}:
            mine = [r for r in got if r["dim"] == dim]
            by_dim[dim] = np.array([r[key] for r in mine]), np.stack([np.frombuffer(r["vec"], "<f8") for r in mine])

        def run(batches: Iterator[pa.RecordBatch], by_dim=by_dim) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], Best] = {}
            for rows in gathered(batches, CHUNK):
                dims = rows.column(2).to_numpy()
                for dim in set(dims.tolist()) & set(by_dim):
                    own = rows.take(pa.array(np.flatnonzero(dims == dim)))
                    for at in range(0, own.num_rows, CHUNK):
                        some = own.slice(at, CHUNK)
                        x = np.frombuffer(b"".join(some.column(1).to_pylist()), "<f8").reshape(-1, dim)
                        code = np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint8).reshape(len(x), -1)
                        for q in range(0, len(by_dim[dim][0]), 1024):
                            i, vecs = by_dim[dim][0][q : q + 1024], by_dim[dim][1][q : q + 1024]
                            part = best[dim, q] = best.get((dim, q)) or Best(len(i), k)
                            scan(part, vecs, i, np.array(some.column(0).to_pylist()), x, code, some.column(4).to_numpy(), sigmas)
            for at, one in best.items():
                if len(one.q):
                    ids = by_dim[at[0]][0][at[1] :]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[one.q]), pa.array(one.id), pa.array(one.score)], ["query_id", "vec_id", "score"])

        some = mapped(table, run, f"query_id {kind}, vec_id {kind}, score double")
        some = stored(some, "found") if blocks > 1 else some
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = df.sparkSession.createDataFrame([], f"query_id {kind}, vec_id {kind}, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
