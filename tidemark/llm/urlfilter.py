"""URL verdicts from rules and, where none fits, from trust and distrust that spread over the link graph of hosts.

Trust starts at hosts with pages that a rule allows and follows links (personalised PageRank); distrust starts at hosts
with pages that a rule blocks and follows links backwards. Both start with the share of judged pages, so that they
compare. A host is blocked if its distrust is above ratio times its trust. Only DataFrame functions are used.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed, as is a
host that neither kind of walk reaches; mass that arrives at a host without further links ends there; repeated rows are
all judged; links within a host are no edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import dropped, small, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (host and path, verdict) that fits, as struct(rule, verdict); else null.

    The rules are few enough to stand in the plan; each is tried, longest first.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda x: len(x[0])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): links from host to other hosts in the href values of html."""
    href = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(href), F.lit(1))))
    links = pages.where(F.col(host) != "").select(F.col(host).alias("src"), target.alias("to"))
    dst = host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")))
    return links.select("src", dst.alias("dst")).where((F.col("dst") != "") & (F.col("dst") != F.col("src"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, trust, distrust).

    Both walks run as one: rows (walk, host, mass) meet rows (walk, src, dst, weight). Each round is a table in the
    shared folder; the rounds end when the masses move by less than the tolerance in all. What moves shrinks by damping
    a round, so that comes after log(tolerance / 2) / log(damping) rounds at the latest.
    """
    rounds = math.ceil(math.log(tolerance / 2) / math.log(damping)) + 1
    ahead = edges.join(edges.groupBy("src").agg(F.sum("n").alias("all")), "src").select(F.lit(0).alias("walk"), F.col("src"), F.col("dst"), (F.col("n") / F.col("all")).alias("weight"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("n").alias("all")), "dst").select(F.lit(1).alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("weight"))
    steps = stored(ahead.unionByName(back), "steps")
    start = stored(seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("walk"), F.col("trust").alias("mass")), F.struct(F.lit(1).alias("walk"), F.col("distrust").alias("mass")))).alias("x")).select("x.walk", "host", "x.mass").where("mass > 0"), "seeds")
    mass = start
    for _ in range(rounds if not steps.isEmpty() else 0):
        came = mass.withColumnRenamed("host", "src").join(steps, ["walk", "src"]).select("walk", F.col("dst").alias("host"), (F.lit(damping) * F.col("mass") * F.col("weight")).alias("mass"))
        home = start.withColumn("mass", F.lit(1 - damping) * F.col("mass"))
        before = mass.withColumnRenamed("mass", "before")
        both = came.unionByName(home).withColumn("before", F.lit(0.0)).unionByName(before.withColumn("mass", F.lit(0.0)))
        new = stored(both.groupBy("walk", "host").agg(F.sum("mass").alias("mass"), F.sum("before").alias("before")), "mass")
        moved = new.agg(F.coalesce(F.sum(F.abs(F.col("mass") - F.col("before"))), F.lit(0.0))).first()[0]
        if mass is not start:
            dropped(mass)
        mass = new.drop("before")
        if moved < tolerance:
            break
    of = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("mass")).otherwise(0.0))
    return mass.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", ratio: float = 1.0, **walk) -> DataFrame:
    """pages without html, with host, path, rule, verdict, trust and distrust (columns of these names are replaced)."""
    out = ["host", "path", "rule", "verdict", "trust", "distrust"]
    kept = [x for x in pages.columns if x not in (*out, html)]
    # What is the caller's stays in one struct, so that no name of theirs meets one of ours.
    own = F.struct(*(F.col(f"`{x}`") for x in kept)).alias("own") if kept else F.lit(None).alias("own")
    known = pages.select(own, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), F.col(f"`{html}`").alias("html"))
    known = known.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    judged = known.where(F.col("fit").isNotNull())
    share = lambda verdict: F.sum(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    total = max(1, judged.count())
    seeds = seeds.select("host", (F.col("trust") / total).alias("trust"), (F.col("distrust") / total).alias("distrust"))
    masses = spread(stored(host_links(known, "host", "html"), "links"), seeds, **walk)
    told = known.drop("html").join(small(masses), "host", "left")
    trust, distrust = (F.coalesce(F.col(x), F.lit(0.0)) for x in ("trust", "distrust"))
    return told.select(
        *(F.col("own").getField(x).alias(x) for x in kept),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(distrust > F.lit(ratio) * trust, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
