"""Co-change: pairs of items that share a group, with strengths.

Groups are commits, items files or methods. A pair is formed within a group only. A group of more than `most` items
makes pairs in proportion to its square, as the semantics ask; min_together prunes items first: an item in fewer
groups than that can't be in a pair, so it is dropped before the join.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ladder
from tidemark.functions.paths import dir_name
from tidemark.operators.graph import _cut as checkpointed

#: Rows of a task that forms pairs, or that adds them up.
TASK_ROWS = 100_000


def _tasks(df: DataFrame) -> int:
    """So many that a task has about TASK_ROWS rows, whatever the input; Spark would merge tasks of a number it chose itself."""
    return max(1, math.ceil(df.count() / TASK_ROWS))


def _sets(df: DataFrame, group: str, item: str, tasks: int, **more: Column) -> DataFrame:
    """(_cell, group, items, more): the distinct items of each group in ascending order; more are aggregates.

    Groups are dealt by cell before anything is aggregated, so that no task holds the distinct rows of a whole split.
    """
    cell = F.pmod(F.xxhash64(F.col(group)), F.lit(16 * tasks))
    dealt = df.where(F.col(group).isNotNull()).withColumn("_cell", cell).repartition(tasks, "_cell")
    return dealt.groupBy("_cell", group).agg(F.array_sort(F.collect_set(item)).alias("_items"), *(x.alias(k) for k, x in more.items()))


def _later(*keep: str) -> tuple:
    return (*keep, "a", F.explode(F.slice("_items", F.col("_i") + 2, F.size("_items"))).alias("b"))


def _together(sets: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """(keys, a, b, together) with a < b. Pairs are added up in their cell first, so a frequent pair is sent 16 * tasks times at most."""
    both = sets.select("_cell", *keys, "_items", F.posexplode("_items").alias("_i", "a")).select(*_later("_cell", *keys))
    part = both.groupBy("_cell", *keys, "a", "b").agg(F.count("*").alias("_n"))
    return part.repartition(tasks, "a", "b").groupBy(*keys, "a", "b").agg(F.sum("_n").alias("together"))


def together(df: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, together): in how many groups both are, a < b."""
    n = _tasks(df)
    return _together(_sets(df, group, item, n), n)


def pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, a, b) with a < b, each once."""
    return _sets(df, group, item, _tasks(df)).select(group, "_items", F.posexplode("_items").alias("_i", "a")).select(*_later(group))


def _touches(sets: DataFrame, *keys: str) -> DataFrame:
    return sets.select(*keys, F.explode("_items").alias("x")).groupBy(*keys, "x").agg(F.count("*").alias("touches"))


def _with_touches(co: DataFrame, t: DataFrame, *keys: str) -> DataFrame:
    return co.join(t.select(*keys, F.col("x").alias("a"), F.col("touches").alias("ta")), [*keys, "a"]).join(t.select(*keys, F.col("x").alias("b"), F.col("touches").alias("tb")), [*keys, "b"])


def _strengths(sets: DataFrame, group: str, tasks: int, min_together: int) -> DataFrame:
    often = _touches(sets).where(F.col("touches") >= min_together)
    if min_together > 1:
        sets = _sets(sets.select(group, F.explode("_items").alias("x")).join(often, "x", "left_semi"), group, "x", tasks)
    return _with_touches(_together(sets, tasks).where(F.col("together") >= min_together), often)


def temporal_coupling(df: DataFrame, group: str = "sha", item: str = "path", min_together: int = 3, least: float = 0.3, other_module: bool = True) -> DataFrame:
    """together / min(touches); touches count groups with two items at least; pairs of one directory are left out."""
    n = _tasks(df)
    multi = _sets(df, group, item, n).where(F.size("_items") >= 2)
    out = _strengths(multi, group, n, min_together).withColumn("strength", F.col("together") / F.least("ta", "tb"))
    if other_module:
        out = out.where(dir_name(F.col("a").cast("string")) != dir_name(F.col("b").cast("string")))
    return out.where(F.col("strength") >= least).select("a", "b", "together", "strength", ladder(F.col("strength"), [(">", 0.7, "high"), (">", 0.5, "medium")], "low").alias("severity"))


def file_coupling(df: DataFrame, group: str = "sha", item: str = "path", least: float = 0.3, min_together: int = 1) -> DataFrame:
    """together / max(touches), at least least."""
    n = _tasks(df)
    out = _strengths(_sets(df, group, item, n), group, n, min_together).withColumn("strength", F.col("together") / F.greatest("ta", "tb"))
    return out.where(F.col("strength") >= least).select("a", "b", "together", "strength", ladder(F.col("strength"), [(">=", 0.7, "high"), (">=", 0.5, "medium")], "low").alias("severity"))


def stability(df: DataFrame, order: str, group: str = "sha", item: str = "path", chronological: bool = False, margin: float = 0.1) -> DataFrame:
    """Strength of each pair in the first and the last third of the groups, and how it moves from one to the other.

    The first third holds the groups of the greatest order, as histories list the newest commit first; if chronological
    is set, it holds those of the least. Ranges of the order are stored, as a range may be cut elsewhere when it is made
    again; only the ranges in which a third ends are ranked.
    """
    tasks = _tasks(df)
    sets = _sets(df, group, item, tasks, _at=F.min(order))
    by = [F.col("_at") if chronological else F.desc("_at"), F.col(group)]
    ranges = checkpointed(sets.select("_at", group).repartitionByRange(tasks, *by).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    n = sum(x for _, x in sizes)
    third = n // 3
    first = dict(zip([r for r, _ in sizes], accumulate((x for _, x in sizes), initial=0)))
    wanted = {third - 1: "_early", n - third: "_late"} if third else {}
    held = {r: [i for i in wanted if first[r] <= i < first[r] + x] for r, x in sizes}
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    ends = None
    for r, i in ((r, i) for r, found in held.items() for i in found):
        row = ranges.where(F.col("_range") == r).withColumn("_i", place).where(F.col("_i") == i - first[r])
        row = F.broadcast(row.select(F.struct("_at", F.col(group).alias("_group")).alias(wanted[i])))
        ends = row if ends is None else ends.crossJoin(row)
    at, g = F.col("_at"), F.col(group)

    def no_later(end: str) -> Column:
        x, y = (at, F.col(end)["_at"]) if chronological else (F.col(end)["_at"], at)
        return F.coalesce(x < y, x.isNull() & y.isNotNull()) | (x.eqNullSafe(y) & (g <= F.col(end)["_group"]))

    if ends is None:
        tagged = sets.withColumn("part", F.lit(None).cast("string")).where("part is not null")
    else:
        late = ~no_later("_late") | (at.eqNullSafe(F.col("_late._at")) & (g == F.col("_late._group")))
        tagged = sets.crossJoin(F.broadcast(ends)).withColumn("part", F.when(no_later("_early"), "early").when(late, "late")).where("part is not null").drop("_early", "_late")
    s = _with_touches(_together(tagged, tasks, "part"), _touches(tagged, "part"), "part")
    value = F.col("together") / F.greatest("ta", "tb")
    of = lambda p: F.coalesce(F.max(F.when(F.col("part") == p, value)), F.lit(0.0))
    wide = s.repartition(tasks, "a", "b").groupBy("a", "b").agg(of("early").alias("early"), of("late").alias("late"))
    return wide.withColumn("stability", ladder(F.col("late") - F.col("early"), [(">", margin, "tightening"), ("<", -margin, "loosening")], "stable"))


def changed_methods(hunks: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods that a hunk of their file's version overlaps, once each: ranges meet within (sha, path) only."""
    ends = F.col("line") + F.col("length") - 1
    m = methods.select("sha", "path", "name", "line", ends.alias("_to"))
    return m.join(hunks.select("sha", "path", "start", "end"), ["sha", "path"]).where((F.col("end") >= F.col("line")) & (F.col("start") <= F.col("_to"))).select("sha", "path", "name", "line").distinct()


def method_coupling(changed: DataFrame, group: str = "sha", item: str = "method", min_commits: int = 10, min_together: int = 4, least: float = 0.5) -> DataFrame:
    """Pairs of methods that change together; none from fewer commits than min_commits."""
    tasks = _tasks(changed)
    sets = _sets(changed, group, item, tasks)
    n = sets.agg(F.count("*").alias("_commits"))
    out = _strengths(sets, group, tasks, min_together).withColumn("strength", F.col("together") / F.greatest("ta", "tb"))
    out = out.where(F.col("strength") >= least).join(F.broadcast(n)).where(F.col("_commits") >= min_commits)
    return out.select("a", "b", "together", "strength", ladder(F.col("strength"), [(">=", 0.8, "high"), (">=", 0.65, "medium")], "low").alias("severity"))


def coupling_findings(df: DataFrame) -> DataFrame:
    return df.select(F.lit("MethodTemporalCoupling").alias("type"), F.when(F.col("severity") == "high", "medium").otherwise("low").alias("severity"), "a", "b")
