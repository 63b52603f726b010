"""Texts that git prints, as DataFrames. A log file is one row of text per line, with its number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, text): one row for each line of each log file, in order. A log is one row until it is split."""
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n", -1)).alias("seq", "text"))


def numstat(lines: DataFrame, text: str = "text") -> DataFrame:
    """(path, added, deleted) of `added<TAB>deleted<TAB>path` lines; binary files (-) are left out."""
    parts = F.split(text, "\t", 3)
    out = lines.where(F.size(parts) == 3).select(F.get(parts, F.lit(2)).alias("path"), F.expr(f"try_cast(get(split({text}, '\\t', 3), 0) as bigint)").alias("added"), F.expr(f"try_cast(get(split({text}, '\\t', 3), 1) as bigint)").alias("deleted"))
    return out.where("added is not null and deleted is not null")


def name_only(lines: DataFrame, root: str | None = None, file: str = "file", seq: str = "seq", text: str = "text") -> DataFrame:
    """(sha, seq, path): a line of 40 hex digits starts a commit, the others are its files; seq 0 is the newest.

    The running count of headers orders one log file; commits without files leave no row.
    """
    header = F.col(text).rlike("^[0-9a-f]{40}$")
    run = Window.partitionBy(file).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.select(F.col(file), F.col(text), header.alias("_h"), F.last(F.when(header, F.col(text)), True).over(run).alias("sha"), (F.sum(header.cast("int")).over(run) - 1).alias("seq"))
    out = tagged.where(~F.col("_h") & (F.trim(text) != "") & F.col("sha").isNotNull()).select("sha", "seq", F.trim(text).alias("path"))
    return out if root is None else out.where(F.col("path").startswith(root))


def authors(commits: DataFrame, path: str = "path") -> DataFrame:
    return commits.select(path, "author", "sha")


def blame(lines: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """(keys, author, lines) from `author-mail <x>` lines."""
    who = F.regexp_extract(text, r"^author-mail <([^>]*)>", 1)
    return lines.select(*keys, who.alias("author")).where("author <> ''").groupBy(*keys, "author").agg(F.count("*").alias("lines"))


def hunks(lines: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """(keys, start, end) from `@@ -a,b +c,d @@`: c to c + d - 1; d is 1 if missing, and 0 leaves no row."""
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    c, d = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    rows = lines.where(F.col(text).rlike(pattern)).select(*keys, c.cast("int").alias("start"), F.when(d == "", 1).otherwise(F.expr(f"try_cast(nullif(regexp_extract({text}, '^@@ -\\\\d+(?:,\\\\d+)? \\\\+(\\\\d+)(?:,(\\\\d+))? @@', 2), '') as int)")).alias("_d"))
    return rows.where("_d > 0").select(*keys, "start", (F.col("start") + F.col("_d") - 1).alias("end"))


def changed(before: DataFrame, after: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Paths that are new or whose content differs: hashes are compared, not texts."""
    b = before.select(path, F.sha1(content).alias("_b"))
    a = after.select(path, F.sha1(content).alias("_a"))
    return a.join(b, path, "left").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(path)


def ai_signal(commits: DataFrame, path: str = "path") -> DataFrame:
    """(path, first_added, commits, score) from the oldest commit's size and the number of commits."""
    from tidemark.operators.readiness import git_score

    s = commits.groupBy(path).agg(F.max_by("added", "seq").alias("first_added"), F.count_distinct("sha").alias("commits"))
    return s.withColumn("score", git_score(F.col("first_added"), F.col("commits")))


def blame_context(blame_lines: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, author, lines) of the blame lines within each target's range."""
    t = targets.select("path", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return blame_lines.join(t, "path").where((F.col("line") >= F.col("_s")) & (F.col("line") <= F.col("_e"))).groupBy("path", "author").agg(F.count("*").alias("lines"))


def apply_unified_diff(files: DataFrame, diffs: DataFrame, path: str = "path") -> DataFrame:
    """(path, content, applied): each file's unified diff applied to it; where a hunk doesn't fit, the old content."""

    def patched(old: str, diff: str) -> tuple[str, bool]:
        import re

        lines, shift = old.split("\n"), 0
        for head, body in re.findall(r"^(@@ [^\n]*@@[^\n]*)\n((?:[ +\-\\][^\n]*\n?|\n)*)", diff, re.M):
            at = int(re.search(r"-(\d+)", head)[1]) - 1 + shift
            rows = [x for x in body.rstrip("\n").split("\n") if not x.startswith("\\")]
            was, now = [x[1:] for x in rows if x[:1] in (" ", "-")], [x[1:] for x in rows if x[:1] in (" ", "+")]
            if lines[at : at + len(was)] != was:
                return old, False
            lines[at : at + len(was)] = now
            shift += len(now) - len(was)
        return "\n".join(lines), True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [patched(o or "", d or "") for o, d in zip(b["content"], b["diff"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "content": [g[0] for g in got], "applied": [g[1] for g in got]})

    both = files.select(F.col(path).alias("path"), "content").join(diffs.select(F.col(path).alias("path"), "diff"), "path")
    return both.mapInPandas(run, "path string, content string, applied boolean")
