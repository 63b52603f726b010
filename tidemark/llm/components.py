"""Connected components of a link table.

A table of at most SOLO links, which take a few tens of MB, is solved in one task; a larger one in Spark rounds of
alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import dropped, mapped, stored

SOLO = 1 << 20


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Links each node's larger (or smaller) neighbours to the least of its neighbours and itself.

    Minima are partial sums before any shuffle; the join back is one that Spark splits where a node has many links.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u > m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least number that links (u, v) reach."""
    label = np.arange(n)
    while True:
        lo, hi = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        if (lo == hi).all():
            return label
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label = label[label]


def _alone(edges: DataFrame) -> DataFrame:
    """Components of edges (u, v) in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        both = pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks])
        ids, at = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
        found = labels(at[: t.num_rows], at[t.num_rows :], len(ids))
        kind = t.schema.field("u").type
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ids[found], kind)], ["id", "component"])

    kind = edges.schema["u"].dataType.simpleString()
    return mapped(edges.coalesce(1), run, f"id {kind}, component {kind}")


def components(edges: DataFrame, rounds: int = 60, solo: int | None = None) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the least id reachable. Self-links and nulls are left out."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if now.count() <= (SOLO if solo is None else solo):
        return _alone(now)
    seen = None
    for _ in range(rounds):
        new = stored(_star(_star(now, True), False), "links")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now)
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
