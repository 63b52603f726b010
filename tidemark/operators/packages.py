"""Imported packages against lists of known ones: typosquats and packages that don't exist."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of the keyboard, signs that look alike.
KEYBOARD = ("1234567890-", "qwertyuiop", "asdfghjkl", "zxcvbnm")
ALIKE = ({"0", "o"}, {"1", "l", "i"}, {"5", "s"})


def normal_name(name: Column, ecosystem: Column) -> Column:
    """npm names in lower case without scope; PyPI names with runs of - _ . as one -."""
    low = F.lower(name)
    return F.when(ecosystem == "pypi", F.regexp_replace(low, "[-_.]+", "-")).otherwise(F.regexp_replace(low, "^@[^/]+/", ""))


def near_keys(a: str, b: str) -> bool:
    place = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
    if a not in place or b not in place:
        return False
    (r, i), (s, j) = place[a], place[b]
    return abs(r - s) <= 1 and abs(i - j) <= 1


def typo(name: str, target: str) -> str | None:
    """keyslip, homoglyph, transpose or indel if one such step makes name of target; else None."""
    squash = lambda x: "".join(c for c in x if c not in "-_.")
    if name == target or squash(name) == squash(target) or name.rstrip("s") == target.rstrip("s") or len(name) < 4:
        return None
    if len(name) == len(target):
        at = [i for i in range(len(name)) if name[i] != target[i]]
        if len(at) == 1:
            a, b = name[at[0]], target[at[0]]
            if any({a, b} <= x for x in ALIKE):
                return "homoglyph"
            return "keyslip" if near_keys(a, b) else None
        if len(at) == 2 and at[1] == at[0] + 1 and name[at[0]] == target[at[1]] and name[at[1]] == target[at[0]]:
            return "transpose"
        return None
    if abs(len(name) - len(target)) == 1:
        long, short = (name, target) if len(name) > len(target) else (target, name)
        for i in range(len(long)):
            if long[:i] + long[i + 1 :] == short:
                return None if long[i].isdigit() else "indel"
    return None


def deletions(name: Column) -> Column:
    """The name and each form with one sign left out: two names one step apart share such a form."""
    cut = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.array_union(F.array(name), cut))


def typosquats(imports: DataFrame, prominent: DataFrame, name: str = "name") -> DataFrame:
    """(name, target, op): the first target (by ord) that name is one step from.

    Candidates meet on a shared form with one sign left out, so no pair of all with all is made.
    """
    i = imports.select(name).distinct()
    a = i.select(name, F.explode(deletions(F.col(name))).alias("_k"))
    b = prominent.select(F.col("name").alias("target"), "ord", F.explode(deletions(F.col("name"))).alias("_k"))
    pairs = a.join(b, "_k").select(name, "target", "ord").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            t = t.assign(op=[typo(x, y) for x, y in zip(t[name], t["target"], strict=True)])
            yield t[t["op"].notna()]

    ops = pairs.mapInPandas(run, f"`{name}` string, target string, ord bigint, op string")
    return ops.groupBy(name).agg(F.min_by(F.struct("target", "op"), "ord").alias("t")).select(name, "t.target", "t.op")


def slopsquatting(imports: DataFrame, lockfile: DataFrame, popular: DataFrame, corpus: DataFrame, prominent: DataFrame) -> DataFrame:
    """(path, name, reason): not locked, not popular, and in the corpus of invented names or a typosquat."""
    open_ = imports.join(lockfile.select("name"), "name", "left_anti").join(popular.select("name"), "name", "left_anti")
    known = corpus.select("name").distinct().withColumn("_c", F.lit("invented"))
    typos = typosquats(open_, prominent).withColumnRenamed("op", "_op")
    out = open_.join(known, "name", "left").join(typos, "name", "left")
    return out.withColumn("reason", F.coalesce("_c", F.concat(F.lit("typosquat:"), "_op"))).where("reason is not null").select("path", "name", "reason", "target")


def hallucinated(imports: DataFrame, snapshot: DataFrame, builtins: DataFrame) -> DataFrame:
    """The first import of each package of a file that no snapshot holds; relative and built-in ones are left out."""
    own = imports.where(~F.col("name").rlike(r"^[./]|^node:"))
    pkg = F.when(F.col("name").startswith("@"), F.regexp_extract("name", "^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract("name", "^([^/]+)", 1))
    rows = own.withColumn("package", pkg).join(builtins.select(F.col("name").alias("package")), "package", "left_anti").join(snapshot.select(F.col("name").alias("package")), "package", "left_anti")
    return rows.groupBy("path", "package").agg(F.min("line").alias("line"))
