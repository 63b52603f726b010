"""Scores from findings. A score starts at 10 and loses weight times root of count for each finding type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tables import CEILING, DIMENSIONS, FLOOR, HEALTHY, PROBLEMATIC, WEIGHTS


def weight_of(kind: Column, weights: dict[str, float] | None = None) -> Column:
    """The type's weight as a literal map lookup: no join, no shuffle."""
    table = F.create_map(*(F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit(0.0))


def categorize(score: Column) -> Column:
    return F.when(score >= HEALTHY, "green").when(score >= PROBLEMATIC, "yellow").otherwise("red")


def fixed1(score: Column) -> Column:
    """One decimal, half up."""
    return F.floor(score * 10 + 0.5) / 10


def penalties(smells: DataFrame, path: str = "path", kind: str = "type", weights: dict[str, float] | None = None) -> DataFrame:
    counts = smells.groupBy(path, kind).agg(F.count("*").alias("n"))
    return counts.groupBy(path).agg(F.sum(weight_of(F.col(kind), weights) * F.sqrt("n")).alias("penalty"), F.sum("n").alias("smells"))


def score(files: DataFrame, smells: DataFrame, path: str = "path", kind: str = "type", weights: dict[str, float] | None = None) -> DataFrame:
    """(path, smells, raw, score, category) for every file; raw is unrounded and without a floor."""
    raw = F.lit(CEILING) - F.coalesce("penalty", F.lit(0.0))
    out = files.select(path).join(penalties(smells, path, kind, weights), path, "left").select(path, F.coalesce("smells", F.lit(0)).cast("bigint").alias("smells"), raw.alias("raw"))
    out = out.withColumn("score", F.greatest(F.lit(FLOOR), fixed1(F.col("raw"))))
    return out.withColumn("category", categorize(F.col("score")))


def special_score(content: Column, language: Column, parsed: Column, lines: Column) -> Column:
    """Scores that need no findings: blank or unsupported 10, unparseable 5, or that of one large file above 10,000 lines."""
    blank = F.trim(content) == ""
    return F.when(blank | (language == "unsupported"), 10.0).when(~parsed & (lines > 10000), CEILING - WEIGHTS["LargeFile"]).when(~parsed, 5.0)


def dimension_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for d, kinds in DIMENSIONS.items() for k in kinds for x in (k, d))), kind)


def effective_weight(kind: Column, metric: Column) -> Column:
    """ComplexMethod weighs 1.0 for a complexity of 15 to 24 and 1.5 otherwise."""
    return F.when((kind == "ComplexMethod") & (metric >= 15) & (metric < 25), 1.0).otherwise(weight_of(kind))


def subscores(files: DataFrame, smells: DataFrame, path: str = "path", kind: str = "type", metric: str = "metric_value", rounded: bool = True) -> DataFrame:
    """(path, security, complexity, maintainability, duplication): mean weight times root of count in each dimension."""
    known = smells.withColumn("dimension", dimension_of(F.col(kind))).where("dimension is not null")
    per = known.groupBy(path, "dimension", kind).agg(F.avg(effective_weight(F.col(kind), F.col(metric))).alias("w"), F.count("*").alias("n"))
    wide = per.groupBy(path).agg(*(F.sum(F.when(F.col("dimension") == d, F.col("w") * F.sqrt("n")).otherwise(0.0)).alias(d) for d in DIMENSIONS))
    one = lambda d: F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), CEILING - F.coalesce(d, F.lit(0.0))))
    return files.select(path).join(wide, path, "left").select(path, *((fixed1(one(d)) if rounded else one(d)).alias(d) for d in DIMENSIONS))


def iso5055(files: DataFrame, smells: DataFrame, dimensions: dict[str, tuple[str, ...]], path: str = "path", kind: str = "type", default: float = 0.5) -> DataFrame:
    """A score for each named set of types, unrounded; unknown types weigh default."""
    counts = smells.groupBy(path, kind).agg(F.count("*").alias("n"))
    loss = F.when(weight_of(F.col(kind)) > 0, weight_of(F.col(kind))).otherwise(default) * F.sqrt("n")
    wide = counts.groupBy(path).agg(*(F.sum(F.when(F.col(kind).isin(*kinds), loss).otherwise(0.0)).alias(d) for d, kinds in dimensions.items()))
    return files.select(path).join(wide, path, "left").select(path, *(F.greatest(F.lit(FLOOR), CEILING - F.coalesce(d, F.lit(0.0))).alias(d) for d in dimensions))


def co_occurrence(smells: DataFrame, pairs: tuple[tuple[str, str], ...] = (("GodClass", "BrainMethod"),), factor: float = 1.2, most: float = 1.3, path: str = "path", kind: str = "type") -> DataFrame:
    """(path, type, weight): the heavier of a pair that is present weighs factor times as much, most at most."""
    heavier = [(a, b, a if WEIGHTS[a] >= WEIGHTS[b] else b) for a, b in pairs]
    heavier.sort(key=lambda x: -WEIGHTS[x[2]])
    has = lambda t: F.max(F.when(F.col(kind) == t, 1).otherwise(0))
    target = F.lit(None).cast("string")
    for a, b, t in reversed(heavier):
        target = F.when((has(a) == 1) & (has(b) == 1), t).otherwise(target)
    flags = smells.groupBy(path).agg(target.alias("_t"))
    base = weight_of(F.col(kind))
    return smells.select(path, kind).distinct().join(flags, path).select(path, kind, F.when(F.col(kind) == F.col("_t"), F.least(base * factor, base * most)).otherwise(base).alias("weight"))


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, observed): equal bins of scores over 1..10; observed is the mean of label."""
    width = 9.0 / bins
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(score) - 1) / width)))
    return df.withColumn("bin", at.cast("bigint")).groupBy("bin").agg(F.count("*").alias("n"), (F.avg(score) / 10).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def validate(reports: DataFrame, smells: DataFrame, path: str = "path", tolerance: float = 0.05) -> DataFrame:
    """Whether a report's score, category and loop flag follow from its findings."""
    derived = score(reports, smells, path).select(path, F.greatest(F.lit(FLOOR), F.col("raw")).alias("derived"))
    out = reports.join(derived, path)
    return out.select(path, "derived", (F.abs(F.col("score") - F.col("derived")) <= tolerance).alias("score_ok"), (F.col("category") == categorize(F.col("score"))).alias("category_ok"))


def conformance(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    """PASS, FAIL or SKIP for each expectation: score within tolerance, category, number of findings."""
    got = actual.select(key, F.col("score").alias("_s"), F.col("category").alias("_c"), F.col("smells").alias("_n"))
    out = expected.join(got, key, "left")
    ok = (F.abs(F.col("expected_score") - F.col("_s")) <= F.col("tolerance")) & (F.col("expected_category") == F.col("_c")) & (F.col("expected_smell_count") == F.col("_n"))
    return out.select(key, F.when(F.col("_s").isNull(), "SKIP").when(ok, "PASS").otherwise("FAIL").alias("result"))
