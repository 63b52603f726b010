"""Labels of files: hold-out sets, fixes in the history, introducing changes, defect pairs from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIX = r"(?i)\b(fix(e[sd])?|bug|defect|fault|patch)\b"


def holdout(scores: DataFrame, labels: DataFrame, defaults: dict[str, int], least: float = 8.0, path: str = "path") -> DataFrame:
    """Files that score at least least, with their labels or the defaults."""
    return scores.where(F.col("score") >= least).join(labels.select(path, *defaults), path, "left").na.fill(defaults)


def from_fix_commits(commits: DataFrame, path: str = "path", sha: str = "sha", message: str = "message") -> DataFrame:
    """(path, has_bug, bug_count): files that commits with a fix in their message touch."""
    fix = F.col(message).rlike(FIX)
    return commits.groupBy(path).agg(F.coalesce(F.bool_or(fix), F.lit(False)).alias("has_bug"), F.count_distinct(F.when(fix, F.col(sha))).alias("bug_count"))


def introducing_commits(commits: DataFrame, removed: DataFrame, blame: DataFrame) -> DataFrame:
    """(fix_sha, path, introduced_by): commits that wrote the lines which a fix removed."""
    fixes = commits.where(F.col("message").rlike(FIX)).select("sha").distinct()
    gone = removed.join(fixes, "sha", "left_semi").select(F.col("sha").alias("fix_sha"), "path", "line")
    return gone.join(blame.select("path", "line", F.col("sha").alias("introduced_by")), ["path", "line"]).where("introduced_by <> fix_sha").select("fix_sha", "path", "introduced_by").distinct()


def defect_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of (id, buggy, fixed) as two labelled rows each."""
    rows = spark.read.schema("id string, language string, buggy string, fixed string").option("multiLine", True).json(path)
    sides = F.array(F.struct(F.col("buggy").alias("content"), F.lit(True).alias("has_bug")), F.struct(F.col("fixed").alias("content"), F.lit(False).alias("has_bug")))
    return rows.select("id", "language", F.explode(sides).alias("s")).select("id", "language", "s.*")


def rated(files: DataFrame, ratings: DataFrame, path: str = "path") -> DataFrame:
    """A rating by path, else by the first rating (by ord) with the same base name."""
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    by_base = ratings.groupBy(base(F.col(path)).alias("_b")).agg(F.min_by("rating", "ord").alias("_r"))
    out = files.join(ratings.select(path, "rating"), path, "left").withColumn("_b", base(F.col(path))).join(by_base, "_b", "left")
    return out.withColumn("rating", F.coalesce("rating", "_r")).drop("_b", "_r")
