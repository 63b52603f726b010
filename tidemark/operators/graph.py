"""Dependency graphs: degrees, reachability, cycles, cost of change.

Each round of an iteration is written to the checkpoint folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ladder


def _cut(df: DataFrame) -> DataFrame:
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", df.sparkSession.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        df.sparkSession.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def dependency_edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst) without loops."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, instability = out / (in + out)): both counts in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    d = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return d.withColumn("instability", F.when(F.col("fan_in") + F.col("fan_out") > 0, F.col("fan_out") / (F.col("fan_in") + F.col("fan_out"))).otherwise(0.0))


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All (src, dst) with a path from src to dst; paths double in each round, so rounds grow with the log of their length."""
    reach = _cut(edges.select("src", "dst").distinct())
    n = reach.count()
    for _ in range(rounds):
        hop = reach.select("src", F.col("dst").alias("m")).join(reach.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst")
        reach = _cut(reach.union(hop).distinct())
        if (m := reach.count()) == n:
            return reach
        n = m
    raise RuntimeError("the closure did not settle")


def propagation_cost(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(node, dependants, cost): how many other nodes reach it, over the number of nodes."""
    nodes = nodes_of(edges)
    reach = closure(edges) if reach is None else reach
    n = nodes.agg(F.count("*").alias("_n"))
    d = reach.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependants"))
    return nodes.join(d, "node", "left").na.fill(0, ["dependants"]).join(F.broadcast(n)).select("node", "dependants", (F.col("dependants") / F.col("_n")).alias("cost"))


def strong_components(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the least node among those that reach it and that it reaches."""
    reach = closure(edges) if reach is None else reach
    both = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")
    least = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_c"))
    return nodes_of(edges).join(least, "node", "left").select("node", F.least("node", F.coalesce("_c", "node")).alias("component"))


def cycles(components: DataFrame) -> DataFrame:
    """Components of more than one node, with members; above five high."""
    c = components.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members")).where("size > 1")
    return c.withColumn("severity", ladder(F.col("size"), [(">", 5, "high")], "medium"))


def module_profile(edges: DataFrame, churn: DataFrame | None = None, reach: DataFrame | None = None) -> DataFrame:
    """Cost of change: .35 fan-in + .40 propagation + .15 cycle + .10 churn, each over its greatest, held to 0..1."""
    reach = closure(edges) if reach is None else reach
    comp = strong_components(edges, reach)
    cyc = comp.groupBy("component").agg(F.count("*").alias("_size"))
    out = degrees(edges).join(propagation_cost(edges, reach), "node").join(comp.join(cyc, "component").select("node", (F.col("_size") > 1).alias("in_cycle")), "node")
    out = out.join(churn.select("node", "churn"), "node", "left").na.fill(0, ["churn"]) if churn is not None else out.withColumn("churn", F.lit(0))
    most = out.agg(F.greatest(F.max("fan_in"), F.lit(1)).alias("_f"), F.greatest(F.max("churn"), F.lit(1)).alias("_c"))
    cost = 0.35 * F.col("fan_in") / F.col("_f") + 0.40 * F.col("cost") + 0.15 * F.col("in_cycle").cast("int") + 0.10 * F.col("churn") / F.col("_c")
    out = out.join(F.broadcast(most)).withColumn("change_cost", F.greatest(F.lit(0.0), F.least(F.lit(1.0), cost))).drop("_f", "_c")
    return out.withColumn("severity", ladder(F.col("change_cost"), [(">=", 0.60, "high"), (">=", 0.35, "medium")], "low"))


def summary(profile: DataFrame) -> DataFrame:
    return profile.agg(F.count("*").alias("modules"), F.avg("cost").alias("mean_cost"), F.avg("instability").alias("mean_instability"), F.count(F.when(F.col("in_cycle"), 1)).alias("in_cycles"), F.count(F.when(F.col("severity") == "high", 1)).alias("high"))


def report(profile: DataFrame, edges: DataFrame, severity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of a severity (or all) and the edges between them."""
    nodes = profile if severity is None else profile.where(F.col("severity") == severity)
    ids = nodes.select("node")
    return nodes, edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def dead_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, name) exported, not passed on from elsewhere, and imported nowhere."""
    own = exports.where(~F.col("reexport")) if "reexport" in exports.columns else exports
    return own.select("path", "name").join(imports.select("path", "name"), ["path", "name"], "left_anti")
