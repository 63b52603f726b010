"""Near-duplicate embeddings by counting collisions in one-dimensional projections.

Unit vectors at most `reach` apart (which follows from the least cosine) lie within a window of `width` reaches of each
other in most of many Gaussian projections. A pair of a label is verified in double precision if it collides in at
least as many of them as all but one in a million linked pairs do.

Equal vectors of a label are one class first. Classes are sorted into cells by their first projection, cells so wide
that a linked pair is in the same or in adjacent ones but with the chance of a 5.3 sigma deviation; large cells are
dealt into sub-blocks, and each pair of sub-blocks is one bounded task, where all query-centred windows are counted at
once. A task returns sums of links and a spanning forest, never all pairs, so a group of copies costs no more rows than
it has members.

Defined results: vectors that are null, zero, or hold null or non-finite components, or whose label or id is null, link
with nothing and are their own component (null for a null id) and kept; only vectors of one length are compared; rows
that repeat an id count as vectors of their own; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import mapped, small, stored
from tidemark.llm.components import components
from tidemark.llm.vectors import dots, matrix, norms, usable

#: Classes in a sub-block, on average; projections; half-width of a window and of a cell in reaches.
BLOCK, PROJECTIONS, WIDTH, CELL = 1024, 48, 2.0, 5.3


def least_collisions(projections: int, width: float, miss: float = 1e-6) -> int:
    """The count that a pair at the full reach falls short of with probability miss at most."""
    p, below = erf(width / sqrt(2)), 0.0
    for c in range(projections + 1):
        below += comb(projections, c) * p**c * (1 - p) ** (projections - c)
        if below > miss:
            return c
    return projections


def directions(dim: int, projections: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projections))


def links(a: np.ndarray, b: np.ndarray, least: float, projections: int, width: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) with cosine of at least least that collide often enough; a is b if same."""
    g = directions(a.shape[1], projections)
    reach = sqrt(max(0.0, 2 * (1 - least)))
    na, nb = norms(a), norms(b)
    pa_, pb = (a / na[:, None]) @ g, (b / nb[:, None]) @ g
    need, window = least_collisions(projections, width), width * reach + 1e-9
    left, right = [], []
    # Each projection's values of b as a sorted run; the window centred at a row of a is a part of it.
    order = np.argsort(pb, axis=0, kind="stable")
    runs = np.take_along_axis(pb, order, axis=0)
    lo = np.stack([np.searchsorted(runs[:, k], pa_[:, k] - window) for k in range(projections)])
    hi = np.stack([np.searchsorted(runs[:, k], pa_[:, k] + window, "right") for k in range(projections)])
    for at in range(0, len(a), 64):
        rows = np.arange(at, min(at + 64, len(a)))
        hits = np.zeros(len(rows) * len(b), np.uint16)
        for k in range(projections):
            n = hi[k, rows] - lo[k, rows]
            inside = np.repeat(lo[k, rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            # A row of b is in a window once at most.
            hits[np.repeat((rows - at) * len(b), n) + order[inside, k]] += 1
        i, j = np.divmod(np.flatnonzero(hits >= need), len(b))
        left.append(rows[i])
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if same:
        i, j = i[i < j], j[i < j]
    out_i, out_j = [], []
    for at in range(0, len(i), 100_000):
        x, y = i[at : at + 100_000], j[at : at + 100_000]
        real = dots(a[x], b[y]) / (na[x] * nb[y]) >= least
        out_i.append(x[real])
        out_j.append(y[real])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row that the links reach within this task."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def near_duplicates(df: DataFrame, least: float = 0.98, key: str = "vec_id", vec: str = "embedding", label: str = "label", block: int = BLOCK, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """(key, n_links, component_id, kept) for each row."""
    kind = df.schema[key].dataType.simpleString()
    takes_part = usable(F.col(vec)) & F.col(label).isNotNull() & F.col(key).isNotNull()
    values = F.transform(F.col(vec).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one value
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(takes_part, values).alias("vec"))
    rows = rows.withColumns({"f1": F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")), "f2": F.when(F.col("vec").isNotNull(), F.xxhash64("vec", F.lit(1), "label"))})
    fine = rows.where(F.col("vec").isNotNull())
    classes = fine.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    reach = sqrt(max(0.0, 2 * (1 - least)))
    cell_width = max(CELL * reach, 1e-3)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array(b.column("vec").value_lengths().to_pylist(), np.int64)
            cell = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = matrix(b.column("vec").take(pa.array(at)))
                cell[at] = np.floor((x / norms(x)[:, None]) @ directions(dim, projections)[:, 0] / cell_width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims.astype(np.int32)), pa.array(cell)], [*b.schema.names, "dim", "cell"])

    schema = classes.withColumns({"dim": F.lit(0), "cell": F.lit(0).cast("bigint")}).schema
    table = stored(mapped(classes, placed, schema), "classes")
    # Sub-blocks of each cell: a row for each label and cell.
    cells = table.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("subs"))
    ahead = cells.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("subs").alias("ahead"))
    behind = cells.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("subs").alias("behind"))
    at = ["label", "dim", "cell"]
    cells = stored(cells.join(ahead, at, "left").join(behind, at, "left").na.fill(0, ["ahead", "behind"]), "cells")
    own = table.join(small(cells), at).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    upto = lambda a, n: F.when(n > a, F.sequence(F.lit(a) if isinstance(a, int) else a, n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda cell, step, i, j, side: F.struct(cell.alias("c"), F.lit(step).alias("step"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    c, s = F.col("cell"), F.col("sub")
    copies = F.concat(
        F.transform(upto(0, F.col("subs")), lambda j: task(c, 0, F.least(s, j), F.greatest(s, j), 0)),
        F.transform(upto(0, F.col("ahead")), lambda j: task(c, 1, s, j, 0)),
        F.transform(upto(0, F.col("behind")), lambda j: task(c - 1, 1, j, s, 1)),
    )
    dealt = own.select("rep", "m", "label", "dim", "vec", "sub", F.explode(copies).alias("t")).select("label", "dim", "t.*", "sub", "rep", "m", "vec")
    rep_kind = kind

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        step, i, j = (t.column(x)[0].as_py() for x in ("step", "i", "j"))
        x = matrix(t.column("vec").combine_chunks())
        rep, m = t.column("rep").to_numpy(), t.column("m").to_numpy()
        if step == 0 and i == j:
            left, right = links(x, x, least, projections, width, True)
        else:
            side = (t.column("side") if step else t.column("sub")).to_numpy()
            a, b = np.flatnonzero(side == (0 if step else i)), np.flatnonzero(side == (1 if step else j))
            left, right = links(x[a], x[b], least, projections, width, False) if len(a) and len(b) else (np.empty(0, int), np.empty(0, int))
            left, right = a[left], b[right]
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, left, m[right])
        np.add.at(n, right, m[left])
        root = forest(left, right, len(rep))
        used = np.flatnonzero(n)
        return pa.table({"a": pa.array(rep[used]), "n": pa.array(n[used]), "b": pa.array(rep[root[used]])})

    found = stored(dealt.groupBy("label", "dim", "c", "step", "i", "j").applyInArrow(compare, f"a {rep_kind}, n bigint, b {rep_kind}"), "links")
    sums = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comps = components(found.select("a", "b")).withColumnRenamed("id", "rep")
    # Only classes with copies or links; all other rows are alone.
    linked = table.select("f1", "f2", "rep", "m").join(sums, "rep", "left").join(comps, "rep", "left").where((F.col("m") > 1) | F.col("others").isNotNull())
    linked = linked.select("f1", "f2", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("id", "f1", "f2").join(small(stored(linked, "linked")), ["f1", "f2"], "left")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(True)).alias("kept"))
