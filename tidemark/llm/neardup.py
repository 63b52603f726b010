"""Near-duplicate documents by a chosen-path join of their shingle sets.

Documents with equal sets are one class. A class keeps the least hash of its set in each of SIGNATURE ranges (one
permutation, empty ranges filled from others by a fixed rule), so two classes agree in a coordinate with the
probability of their similarity. Each of TREES trees branches all classes by one coordinate; a node of more than NODE
classes branches again by another (by a second one with a chance of 1 / floor - 1, so that a pair at the floor keeps
one path on average) until nodes are small, and small nodes are compared exhaustively.

The comparison takes two passes, so that what is sent grows with the members of a group and not with its pairs:

1. In each node the signatures estimate all similarities; the node gives the maximum spanning forest of the pairs whose
   estimate may reach the threshold. Those pairs are confirmed on the full sets of shingles; links make components.
2. In each node of the first AGAIN trees, classes that may still link with another component (the smaller ones, and
   what they may link with) go to cells with their full sets, where each of the smaller ones is compared with all.
   Smaller ones that may link with the same class share cells, so a large group is not sent once for each of them.

A node too large for one task is dealt into blocks that share HUBS of its classes in pass 1, so a group of near copies
becomes one component there. In pass 2 it ends, dealt into blocks, once its smaller components fit in one block (or
after LEVELS branchings, when their blocks are paired); until then it branches. A path survives about 1 / depth of the
time, so large nodes branch several times, with other dice, as often as RECALL needs at the depth that the largest is
expected to reach.

Defined results: words are runs of characters other than space and \\t to \\r, A-Z lower-cased; texts with fewer words
than a shingle are one shingle; null texts and texts without words have an empty set and link with nothing; a null id
takes no part (its component is null, it is kept); each row that repeats an id has the component of its own text, and
is kept if that is its id.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import BATCH_BYTES, dropped, mapped, small, stored
from tidemark.llm.bpe import slices
from tidemark.llm.components import components

SIGNATURE, TREES, AGAIN, HUBS = 128, 10, 4, 64
#: Most classes of a node that one task compares.
NODE = 4096
#: Branchings after which a large node ends in any case.
LEVELS = 40
#: Shingles, of 8 bytes each, and classes of each side of a cell.
CELL, SIDE = 1 << 20, 64
#: Expected share of the pairs at the threshold, sharing only large nodes, that meet in a small node at last.
RECALL = 0.99
#: Bounds on what a worker keeps of words' hashes.
WORDS_KEPT = 200_000
WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = {c: c + 32 for c in range(65, 91)}


class Shingler:
    def __init__(self, size: int):
        self.size, self.known = size, {}

    def set_of(self, text: str | None) -> np.ndarray:
        """The sorted distinct 64-bit hashes of the text's shingles."""
        words = WORD.findall(text.translate(UPPER) if not text.isascii() else text.lower()) if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, len(words) if n < self.size else self.size, np.uint64)
            for k in range(n):
                out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
            out = out * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def _identity(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two signed numbers."""
    whole = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def _fill_order(size: int, seed: int = 17) -> np.ndarray:
    return np.array([np.random.default_rng((seed, i)).permutation(size) for i in range(size)])


FILL = _fill_order(SIGNATURE)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash in each of SIGNATURE equal ranges; an empty range takes that of the first filled one in its own order."""
    bounds = np.arange(SIGNATURE, dtype=np.uint64) << np.uint64(64 - SIGNATURE.bit_length() + 1)
    at = np.searchsorted(hashes, bounds)
    ends = np.append(at[1:], len(hashes))
    filled = ends > at
    out = hashes[np.minimum(at, len(hashes) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        source = FILL[empty][np.arange(len(empty)), filled[FILL[empty]].argmax(axis=1)]
        with np.errstate(over="ignore"):
            out[empty] = out[source] * np.uint64(0x94D049BB133111EB) + empty.astype(np.uint64)
    return out


def signatures(df: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, f1, f2, roots, sig): number of shingles, 128-bit identity of the set, a node for each tree, one byte for
    each coordinate."""
    picks = np.random.default_rng(23).permutation(SIGNATURE)[:TREES]
    salts = np.random.default_rng(29).integers(1, 1 << 62, TREES, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(size)
        for b in batches:
            for some in slices(b, 1):
                n, f1, f2, roots, sig = [], [], [], [], []
                for x in some.column(1).to_pylist():
                    s = make.set_of(x)
                    n.append(len(s))
                    if not len(s):
                        f1.append(None), f2.append(None), roots.append(None), sig.append(None)
                        continue
                    one, two = _identity(s)
                    f1.append(one), f2.append(two)
                    v = signature(s)
                    with np.errstate(over="ignore"):
                        roots.append(((v[picks] ^ salts) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                        sig.append(((v * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(roots, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["id", "n", "f1", "f2", "roots", "sig"])

    kind = df.schema[key].dataType.simpleString()
    return mapped(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), run, f"id {kind}, n bigint, f1 bigint, f2 bigint, roots array<bigint>, sig binary")


def _floor(least: float) -> float:
    """Equal bytes that a pair at the threshold reaches, but for one of a thousand; 1 of 256 agrees by chance."""
    return SIGNATURE * (least + (1 - least) / 256 - 3.1 * np.sqrt(least * (1 - least) / SIGNATURE))


def _missed(least: float, depth: int, repeats: int) -> float:
    """Expected share of pairs at the threshold that no branching keeps together, each large node branched so often.

    The equal coordinates of a pair's signatures are binomial; survival follows the paths' recurrence level by level.
    """
    second = _second(least) / 1000
    k = np.arange(SIGNATURE + 1)
    s = k / SIGNATURE
    weight = np.array([math.comb(SIGNATURE, int(x)) * least**x * (1 - least) ** (SIGNATURE - x) for x in k])
    alive = np.ones(len(k))
    for _ in range(depth):
        lost = 1 - s * alive
        alive = 1 - (1 - second) * lost - second * lost**2
    return float((weight * (1 - s * (1 - (1 - alive) ** repeats)) ** AGAIN).sum())


def _second(least: float) -> int:
    """Chance in 1000 of a second path."""
    return int(1000 * (1 / least - 1))


def _repeats(least: float, depth: int) -> int:
    return next(r for r in itertools.count(1) if _missed(least, depth, r) <= 1 - RECALL)


def _agreeing(mine: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Equal bytes of each row of one with each of the other."""
    out = np.empty((len(mine), len(all_)), np.uint8)
    step = max(1, (8 << 20) // (SIGNATURE * len(all_)))
    for at in range(0, len(mine), step):
        same = (mine[at : at + step, None, :] == all_[None, :, :]).view(np.uint64)
        # Up to SIGNATURE / 8 ones in each byte of a word's sum.
        out[at : at + step] = same.sum(axis=2, dtype=np.uint64)[..., None].view(np.uint8).sum(axis=2, dtype=np.uint8)
    return out


def _forest(agree: np.ndarray, floor: float) -> tuple[list[int], list[int]]:
    """A maximum spanning forest of the pairs that agree in floor bytes at least (Prim's)."""
    n = len(agree)
    best, back, left = np.full(n, -1, np.int16), np.zeros(n, np.int64), np.ones(n, bool)
    a, b, i = [], [], 0
    left[0] = False
    for _ in range(n - 1):
        better = left & (agree[i] > best)
        best[better], back[better] = agree[i][better], i
        j = int(np.where(left, best, -1).argmax())
        if best[j] >= floor and left[j]:
            a.append(int(back[j]))
            b.append(j)
        else:
            j = int(left.argmax())
        left[j], i = False, j
    return a, b


def _runs(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Tables of so many rows at least, cut where the column changes; the input is sorted by it."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < rows:
            continue
        value = held.column(column).to_numpy()
        last = np.flatnonzero(value != value[-1])
        if len(last):
            yield held.slice(0, int(last[-1]) + 1).combine_chunks()
            held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _each(t: pa.Table, column: str) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of two rows at least."""
    value = t.column(column).to_numpy()
    new = np.flatnonzero(value[1:] != value[:-1]) + 1
    for s, e in zip(np.concatenate([[0], new]), np.concatenate([new, [len(value)]]), strict=True):
        if e - s > 1:
            yield s, e


def _bytes(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def _forests(least: float):
    """Rows (node, k, sig), sorted by node, to the pairs (a, b) of each node's forest."""
    floor = _floor(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "node", 20_000):
            k, sig, a, b = t.column("k").to_numpy(), _bytes(t), [], []
            for s, e in _each(t, "node"):
                agree = _agreeing(sig[s:e], sig[s:e])
                active = np.flatnonzero((agree >= floor).sum(axis=1) > 1)
                if len(active):
                    i, j = _forest(agree[np.ix_(active, active)], floor)
                    at = k[s:e][active]
                    a.append(at[i]), b.append(at[j])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _cells(least: float):
    """Rows (node, k, n, sig, comp), sorted by node, to (cell, k, comp, minor): what is to be compared on full sets.

    The minor classes of a node are those outside its largest component. Those that may link with another component
    are joined, over what they may link with, to clusters, so that each class is in one cluster at most; a cluster
    gives a cell for each pair of a run of its minor classes with a run of all its classes. Equal clusters of several
    trees give equal cells.
    """
    floor = _floor(least)

    def split(n: np.ndarray) -> np.ndarray:
        new = (np.diff((np.cumsum(n) - n) // CELL) > 0) | (np.arange(1, len(n)) % SIDE == 0)
        return np.concatenate([[0], np.cumsum(new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "node", 20_000):
            k, n, comp, sig = t.column("k").to_numpy(), t.column("n").to_numpy(), t.column("comp").to_numpy(), _bytes(t)
            out: list[tuple] = []
            for s, e in _each(t, "node"):
                c = comp[s:e]
                if (c == c[0]).all():
                    continue
                values, of, counts = np.unique(c, return_inverse=True, return_counts=True)
                minor = np.flatnonzero(of != counts.argmax())
                near = (_agreeing(sig[s:e][minor], sig[s:e]) >= floor) & (c[minor][:, None] != c[None, :])
                is_minor = np.zeros(e - s, bool)
                is_minor[minor] = True
                todo = near.any(axis=1)
                while todo.any():
                    inside, queue = np.zeros(e - s, bool), np.array([todo.argmax()])
                    while len(queue):
                        todo[queue] = False
                        new = near[queue].any(axis=0) & ~inside
                        new[minor[queue]] = True
                        inside |= new
                        left = np.flatnonzero(todo)
                        queue = left[near[np.ix_(left, np.flatnonzero(new))].any(axis=1)]
                    every = np.flatnonzero(inside)
                    every = every[np.argsort(k[s:e][every], kind="stable")]
                    few = every[is_minor[every]]
                    rows, columns = split(n[s:e][few]), split(n[s:e][every])
                    for x, y in itertools.product(np.unique(rows), np.unique(columns)):
                        left, right = few[rows == x], np.setdiff1d(every[columns == y], few[rows == x])
                        ks = np.concatenate([k[s:e][left], k[s:e][right]])
                        cell = np.int64(xxhash.xxh3_64_intdigest(ks.tobytes(), seed=len(left)) - (1 << 63))
                        out.append((np.full(len(ks), cell), ks, np.concatenate([c[left], c[right]]), np.arange(len(ks)) < len(left)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(4)], ["cell", "k", "comp", "minor"])

    return run


def _spread(size: int):
    """Rows (text, k, f1, f2, comp, cells) to (cell, k, hashes, comp, minor): the set of a text, once for each of its
    cells (cell, minor). However many these are, a batch holds about BATCH_BYTES, or one set."""
    names = ["cell", "k", "hashes", "comp", "minor"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, rows, held = Shingler(size), [], 0
        for batch in batches:
            for some in slices(batch, 0):
                for x, k, f1, f2, comp, cells in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    s = make.set_of(x)
                    if _identity(s) != (f1, f2):
                        continue
                    hashes = s.tobytes()
                    for at in cells:
                        rows.append((at["cell"], k, hashes, comp, at["minor"]))
                        held += len(hashes)
                        if held >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
        yield batch_of(rows)

    return run


def _sets(docs: DataFrame, need: DataFrame, size: int, key: str, text: str, cells: int) -> DataFrame:
    """(cell, k, hashes, comp, minor) for need (id, k, f1, f2, comp, cells): the full set of each class, made again from
    a text of it, once for each of its cells."""
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("x"))
    # At most 72 bytes for a row and 32 for each of its cells.
    side = F.broadcast(need) if cells * 104 <= 64 << 20 else need
    rows = texts.join(side, "id").select("x", "k", "f1", "f2", "comp", "cells")
    return mapped(rows, _spread(size), "cell bigint, k bigint, hashes binary, comp bigint, minor boolean")


def _linked(percent: int):
    """Rows (cell, k, hashes, a) sorted by cell, a and k, first the sets (a null), then the pairs a, k to confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for b in batches:
            good = []
            for cell, k, hashes, a in zip(*(b.column(c) for c in ("cell", "k", "hashes", "a")), strict=True):
                if cell.as_py() != now:
                    now, sets = cell.as_py(), {}
                if not a.is_valid:
                    sets[k.as_py()] = np.frombuffer(hashes.as_py(), np.uint64)
                    continue
                x, y = sets[a.as_py()], sets[k.as_py()]
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append((a.as_py(), k.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in good], pa.int64()), pa.array([x[1] for x in good], pa.int64())], ["a", "b"])

    return run


def _compared(percent: int):
    """Rows (cell, k, hashes, comp, minor) sorted by cell to links (a, b): of each minor class with the others, one to
    each component that is new to it."""

    def of_cell(t: pa.Table) -> tuple[list, list]:
        keys, at = np.unique(t.column("k").to_numpy(), return_index=True)
        minor, comp = t.column("minor").to_numpy(zero_copy_only=False)[at], t.column("comp").to_numpy()[at]
        hashes = t.column("hashes")
        sets = [np.frombuffer(hashes[int(i)].as_py(), np.uint64) for i in at]
        n = np.array([len(x) for x in sets])
        starts = np.cumsum(n) - n
        universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
        comp = np.unique(comp, return_inverse=True)[1]
        mark, a, b = np.zeros(len(universe), np.int32), [], []
        for i in np.flatnonzero(minor):
            if (comp == comp[i]).all():
                break
            own = flat[starts[i] : starts[i] + n[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[own] = 0
            linked = np.flatnonzero((100 * both >= percent * (n + n[i] - both)) & (comp != comp[i]))
            for c, j in zip(*np.unique(comp[linked], return_index=True), strict=True):
                a.append(keys[i]), b.append(keys[linked[j]])
                comp[comp == c] = comp[i]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "cell", 1):
            a, b = [], []
            for s, e in _each(t, "cell"):
                x, y = of_cell(t.slice(s, e - s))
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes with 100 * intersection >= percent * union of the full sets.

    Pairs are dealt to a grid of cells by the hashes of both sides, so a cell holds bounded sets; each set is sent once
    to a cell, whatever the pairs it has there.
    """
    count = pairs.count()
    mean = classes.agg(F.avg("n")).first()[0] or 1
    side = max(1, math.ceil(math.sqrt(count * 2 * mean / CELL)))
    cell = F.xxhash64(F.pmod(F.xxhash64("a"), F.lit(side)), F.pmod(F.xxhash64("b", F.lit(1)), F.lit(side)))
    pairs = pairs.withColumn("cell", cell)
    at = F.struct("cell", F.lit(False).alias("minor"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("k"), "cell").groupBy("k").agg(F.collect_set(at).alias("cells"))
    need = stored(classes.select("id", "k", "f1", "f2").join(ends, "k").select("id", "k", "f1", "f2", F.lit(None).cast("bigint").alias("comp"), "cells"), "need")
    sets = _sets(docs, need, size, key, text, 2 * count).select("cell", "k", "hashes", F.lit(None).cast("bigint").alias("a"))
    rows = sets.unionByName(pairs.select("cell", F.col("b").alias("k"), F.lit(None).cast("binary").alias("hashes"), "a"))
    return mapped(rows.repartition("cell").sortWithinPartitions("cell", F.col("a").asc_nulls_first(), "k"), _linked(percent), "a bigint, b bigint")


def _small_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """nodes (tree, node, k): those of 2 to NODE classes; the larger ones, if any; classes of the largest."""
    size = stored(nodes.groupBy("tree", "node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    most = size.agg(F.max("size")).first()[0] or 0
    fit = nodes.join(size.where(F.col("size") <= NODE).select("tree", "node"), ["tree", "node"], "left_semi")
    if most <= NODE:
        return fit, None, most
    large = size.where(F.col("size") > NODE)
    return fit, stored(nodes.join(small(large), ["tree", "node"]).select("tree", "node", "k", "size"), "large"), most


def _with_hubs(large: DataFrame) -> DataFrame:
    """(node, k): large nodes (tree, node, k, size) in blocks, with about HUBS classes that all blocks of a node have."""
    blocks = F.ceil(F.col("size") * 2 / NODE).cast("int")
    hub = F.pmod(F.xxhash64("k", "node", F.lit(1)), F.col("size")) < HUBS
    own = F.pmod(F.xxhash64("k", "node"), blocks).cast("int")
    to = F.when(hub, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    return large.select("node", "k", F.explode(to).alias("block")).select(F.xxhash64("node", "block").alias("node"), "k")


def _in_blocks(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, k): nodes that end (tree, node, size, most, major) in blocks: each block of a node's smaller components
    with each block of the rest, and with each other block of the smaller."""
    half = max(1, NODE // 2)
    here = rows.join(small(ends), ["tree", "node"])
    is_minor = F.col("comp") != F.col("major")
    few, many = F.ceil((F.col("size") - F.col("most")) / half).cast("int"), F.ceil(F.col("most") / half).cast("int")
    own = F.pmod(F.xxhash64("k", "node"), F.when(is_minor, few).otherwise(many)).cast("int")
    all_few, all_many = F.sequence(F.lit(0), few - 1), F.sequence(F.lit(0), many - 1)
    cells_of_minor = F.concat(
        F.transform(all_many, lambda m: F.struct(own.alias("x"), m.alias("y"), F.lit(False).alias("both"))),
        F.transform(F.filter(all_few, lambda f: (f != own) | (few == 1)), lambda f: F.struct(F.least(own, f).alias("x"), F.greatest(own, f).alias("y"), F.lit(True).alias("both"))),
    )
    cells_of_major = F.transform(all_few, lambda f: F.struct(f.alias("x"), own.alias("y"), F.lit(False).alias("both")))
    cell = F.explode(F.when(is_minor, cells_of_minor).otherwise(cells_of_major)).alias("cell")
    return here.select("node", "k", cell).select(F.xxhash64("node", "cell.x", "cell.y", "cell.both").alias("node"), "k")


def _branched(large: DataFrame, classes: DataFrame, comps: DataFrame, least: float, most: int) -> DataFrame | None:
    """(node, k): nodes for pass 2 from large ones (tree, node, k)."""
    named = classes.select("k", "sig").join(comps, "k", "left").select("k", "sig", F.coalesce("component", "k").alias("comp"))
    rows = stored(large.join(named, "k").select("tree", "node", "k", "sig", "comp"), "level")
    # Nodes of classes closer to each other than the threshold, which would be deeper, are one component mostly.
    repeats = _repeats(least, max(1, math.ceil(math.log(most / NODE) / -math.log(least))))
    done = None
    for level in itertools.count():
        by = rows.groupBy("tree", "node", "comp").agg(F.count("*").alias("n")).groupBy("tree", "node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"))
        size = stored(by.select("tree", "node", "size", F.col("top.n").alias("most"), F.col("top.comp").alias("major")).where("size > most"), "sizes")
        fits = F.col("size") <= NODE
        lopsided = (F.col("size") - F.col("most") <= max(1, NODE // 2)) | F.lit(level >= LEVELS)
        fit = rows.join(size.where(fits).select("tree", "node"), ["tree", "node"], "left_semi").select(F.xxhash64("tree", "node").alias("node"), "k")
        ended = stored(fit.unionByName(_in_blocks(rows, size.where(~fits & lopsided))), "ended")
        done = ended if done is None else done.unionByName(ended)
        on = size.where(~fits & ~lopsided).select("tree", "node")
        if on.isEmpty():
            dropped(rows)
            return done
        # A large node chooses one coordinate, and a second with probability 1 / least - 1; the repeat is part of the
        # tree's number from the first level on.
        trees = F.array(*(F.col("tree") + r * TREES for r in range(1, repeats + 1))) if level == 0 else F.array("tree")
        chosen = on.select(F.explode(trees).alias("as"), "tree", "node").withColumn("dice", F.xxhash64("as", "node", F.lit(level)))
        here = rows.join(small(chosen), ["tree", "node"])
        second = F.pmod(F.shiftrightunsigned("dice", 20), F.lit(1000)) < _second(least)
        paths = F.explode(F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("path")
        here = here.select("k", "sig", "comp", F.col("as").alias("tree"), "node", "dice", paths)
        here = here.withColumn("coordinate", F.pmod(F.xxhash64("dice", "path"), F.lit(SIGNATURE)).cast("int") + 1)
        new = here.select("tree", F.xxhash64("node", "path", "coordinate", F.expr("substring(sig, coordinate, 1)")).alias("node"), "k", "sig", "comp")
        new = stored(new, "level")
        dropped(rows)
        rows = new


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row."""
    least = percent / 100
    signed = stored(signatures(docs, size, key, text).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # A class of equal sets is named by its first row; the signature is the same in all its rows.
    grouped = signed.where(F.col("f1").isNotNull() & F.col("id").isNotNull()).groupBy("f1", "f2")
    classes = stored(grouped.agg(F.min("row").alias("k"), F.min("id").alias("id"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("roots").alias("roots"), F.first("sig").alias("sig")), "classes")
    nodes, large, most = _small_nodes(classes.select("k", F.posexplode("roots").alias("tree", "node")))
    nodes = stored(nodes, "nodes")

    # Pass 1.
    here = nodes.select("node", "k") if large is None else nodes.select("node", "k").unionByName(_with_hubs(large))
    dealt = here.join(classes.select("k", "sig"), "k").select("node", "k", "sig").repartition("node").sortWithinPartitions("node")
    first = stored(mapped(dealt, _forests(least), "a bigint, b bigint").distinct(), "pairs")
    links = stored(_confirmed(first, classes, docs, size, percent, key, text), "linked")
    comps = stored(components(links).select(F.col("id").alias("k"), "component"), "components")

    # Pass 2.
    here = nodes.where(F.col("tree") < AGAIN).select("node", "k")
    if large is not None:
        here = here.unionByName(_branched(large.where(F.col("tree") < AGAIN), classes, comps, least, most))
    told = classes.select("k", "n", "sig").join(comps, "k", "left").select("k", "n", "sig", F.coalesce("component", "k").alias("comp"))
    dealt = here.join(told, "k").select("node", "k", "n", "sig", "comp").repartition("node").sortWithinPartitions("node")
    cells = stored(mapped(dealt, _cells(least), "cell bigint, k bigint, comp bigint, minor boolean").distinct(), "cells")
    count = cells.count()
    if count:
        # Component and role go with each set, so that the sets are sent once.
        ends = cells.groupBy("k").agg(F.first("comp").alias("comp"), F.collect_set(F.struct("cell", "minor")).alias("cells"))
        need = stored(classes.select("id", "k", "f1", "f2").join(ends, "k").select("id", "k", "f1", "f2", "comp", "cells"), "need")
        rows = _sets(docs, need, size, key, text, count)
        more = mapped(rows.repartition("cell").sortWithinPartitions("cell"), _compared(percent), "a bigint, b bigint")
        more = stored(more, "linked")
        if not more.isEmpty():
            comps = stored(components(links.unionByName(more)).select(F.col("id").alias("k"), "component"), "components")

    # Only classes with copies or links; every other document is alone.
    named = classes.select("f1", "f2", "k", "id", "m").join(comps, "k", "left").where((F.col("m") > 1) | F.col("component").isNotNull())
    named = stored(named.select("f1", "f2", "id", F.coalesce("component", "k").alias("component")), "named")
    least_id = named.groupBy("component").agg(F.min("id").alias("c"))
    told = stored(named.join(small(least_id), "component").select("f1", "f2", "c"), "told")
    out = signed.select("id", "n", "f1", "f2").join(small(told), ["f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
