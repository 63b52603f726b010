"""Rank statistics that hold scores against labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import normal_cdf, pearson

# Ranks over one whole table need a total order; ties and counts are aggregated by distinct value first, so the
# one ordered window holds distinct values, not rows.


def value_ranks(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """(groups, value, n, rank): count and mid-rank of each distinct value."""
    n = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*groups).orderBy(value))
    return n.withColumn("rank", upto - F.col("n") + (F.col("n") + 1) / 2)


def pearson_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.coalesce(pearson(x, y), F.lit(0.0)).alias("r"))


def spearman_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    a = value_ranks(df, x).select(x, F.col("rank").alias("_rx"))
    b = value_ranks(df, y).select(y, F.col("rank").alias("_ry"))
    pairs = df.groupBy(x, y).agg(F.count("*").alias("_m"))
    r = pairs.join(a, x).join(b, y)
    s = r.agg(F.sum("_m").alias("n"), *(F.sum(F.col("_m") * e).alias(k) for k, e in {"sx": F.col("_rx"), "sy": F.col("_ry"), "sxx": F.col("_rx") ** 2, "syy": F.col("_ry") ** 2, "sxy": F.col("_rx") * F.col("_ry")}.items()))
    va, vb = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    return s.select(F.when((va > 0) & (vb > 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(va * vb)).otherwise(0.0).alias("rho"))


def auroc(df: DataFrame, score: str, label: str, *groups: str) -> DataFrame:
    """(groups, positives, negatives, auroc): the chance that a labelled row scores lower than another, ties half; 0.5 without both."""
    by = df.groupBy(*groups, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("p"))
    upto = F.sum("n").over(Window.partitionBy(*groups).orderBy(score))
    rank = upto - F.col("n") + (F.col("n") + 1) / 2
    s = by.withColumn("rank", rank).groupBy(*groups).agg(F.sum("p").alias("positives"), (F.sum("n") - F.sum("p")).alias("negatives"), F.sum(F.col("p") * F.col("rank")).alias("_r"))
    p, q = F.col("positives"), F.col("negatives")
    value = F.when((p > 0) & (q > 0), 1 - (F.col("_r") - p * (p + 1) / 2) / (p * q)).otherwise(0.5)
    return s.select(*groups, "positives", "negatives", value.alias("auroc"))


def mann_whitney(df: DataFrame, score: str, label: str, legacy_cdf: bool = False) -> DataFrame:
    """(u, z, p): smaller U, tie-corrected z with continuity, two-tailed p."""
    by = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("p"))
    upto = F.sum("n").over(Window.orderBy(score))
    s = by.withColumn("rank", upto - F.col("n") + (F.col("n") + 1) / 2).agg(F.sum("p").alias("n1"), (F.sum("n") - F.sum("p")).alias("n2"), F.sum(F.col("p") * F.col("rank")).alias("r1"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u, n = F.least(u1, n1 * n2 - u1), n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - F.col("ties") / F.greatest(n * (n - 1), F.lit(1.0)))
    z = F.when(var > 0, (u - n1 * n2 / 2 + 0.5) / F.sqrt(var)).otherwise(0.0)
    out = s.select(u.alias("u"), F.least(z, F.lit(0.0)).alias("z"))
    return out.withColumn("p", F.least(F.lit(1.0), 2 * normal_cdf(F.col("z"), legacy_cdf)))


def bootstrap_auroc(df: DataFrame, score: str, label: str, rounds: int = 1000, level: float = 0.95, seed: int = 1, many_rows: int = 256) -> DataFrame:
    """(low, high): percentile interval over Poisson resamples.

    Rows are counted by (score, label) first. A count of many rows is resampled as one normal deviate of its mean and
    variance, fewer rows one by one, so a round costs the distinct values. All deviates are hashes of score, label, row
    within the count, and round, so the files' layout makes no difference.
    """
    rows = df.groupBy(F.col(score).alias("s"), F.col(label).cast("int").alias("l")).agg(F.count("*").alias("m"))
    large = F.col("m") >= many_rows
    by = rows.select("s", "l", "m", F.explode(F.when(large, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(1).cast("bigint"), F.col("m")))).alias("_i"))
    drawn = lambda k: (F.pmod(F.xxhash64("s", "l", "_i", "b", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    u = drawn(0)
    k = sum((F.when(u > x, 1).otherwise(0) for x in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))
    deviate = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.lit(math.pi) * drawn(1))
    normal = F.greatest(F.lit(0), F.round(F.col("m") + F.sqrt("m") * deviate)).cast("bigint")
    many = by.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_k", F.when(F.col("m") >= many_rows, normal).otherwise(k)).where("_k > 0")
    each = many.groupBy("b", "s").agg(F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("l")).alias("p"))
    rank = F.sum("n").over(Window.partitionBy("b").orderBy("s")) - F.col("n") + (F.col("n") + 1) / 2
    r = each.withColumn("rank", rank).groupBy("b").agg(F.sum("p").alias("p"), (F.sum("n") - F.sum("p")).alias("q"), F.sum(F.col("p") * F.col("rank")).alias("r"))
    a = r.where("p > 0 and q > 0").select((1 - (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("a"))
    tail = (1 - level) / 2
    return a.agg(F.percentile("a", F.lit(tail)).alias("low"), F.percentile("a", F.lit(1 - tail)).alias("high"))


def delong(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """(auc_a, auc_b, delta, z, p): paired comparison of two scores where label 1 should score higher."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(label).cast("int").alias("l")).where("a is not null and b is not null and l is not null")
    n = rows.groupBy("l").agg(F.count("*").alias("m"))
    size = F.broadcast(rows.agg(F.sum("l").alias("pos"), (F.count("*") - F.sum("l")).alias("neg")))
    out = rows
    for x in ("a", "b"):
        by = rows.groupBy(x).agg(F.count("*").alias("t"), F.sum("l").alias("tp"))
        w = Window.orderBy(x)
        both = by.withColumns({f"z{x}": F.sum("t").over(w) - F.col("t") + (F.col("t") + 1) / 2, f"p{x}": F.sum("tp").over(w) - F.col("tp") + (F.col("tp") + 1) / 2})
        tn = F.col("t") - F.col("tp")
        both = both.withColumn(f"n{x}", F.sum(tn).over(w) - tn + (tn + 1) / 2)
        out = out.join(both.select(x, f"z{x}", f"p{x}", f"n{x}"), x)
    v = lambda x: F.when(F.col("l") == 1, (F.col(f"z{x}") - F.col(f"p{x}")) / F.col("neg")).otherwise(1 - (F.col(f"z{x}") - F.col(f"n{x}")) / F.col("pos"))
    placed = out.join(size).select("l", "pos", "neg", v("a").alias("va"), v("b").alias("vb"))
    s = placed.groupBy("l", "pos", "neg").agg(F.avg("va").alias("ma"), F.avg("vb").alias("mb"), (F.var_samp("va") + F.var_samp("vb") - 2 * F.covar_samp("va", "vb")).alias("v"), F.count("*").alias("m"))
    t = s.agg(F.max(F.when(F.col("l") == 1, F.col("ma"))).alias("auc_a"), F.max(F.when(F.col("l") == 1, F.col("mb"))).alias("auc_b"), F.sum(F.col("v") / F.col("m")).alias("_v"))
    t = t.withColumn("delta", F.col("auc_a") - F.col("auc_b")).withColumn("z", F.when(F.col("_v") > 0, F.col("delta") / F.sqrt("_v")).otherwise(0.0))
    return t.select("auc_a", "auc_b", "delta", "z", F.least(F.lit(1.0), 2 * normal_cdf(-F.abs(F.col("z")))).alias("p"))


def roc_thresholds(df: DataFrame, score: str, label: str, group: str, least: int = 5) -> DataFrame:
    """(group, threshold, youden, p90): the highest threshold of greatest sensitivity + specificity - 1 for score >= t."""
    n = df.groupBy(group).agg(F.sum(F.col(label).cast("int")).alias("pos"), (F.count("*") - F.sum(F.col(label).cast("int"))).alias("neg"), F.percentile(F.col(score).cast("double"), F.lit(0.9)).alias("p90"))
    ok = n.where((F.col("pos") >= least) & (F.col("neg") >= least))
    by = df.groupBy(group, score).agg(F.sum(F.col(label).cast("int")).alias("p"), F.count("*").alias("m"))
    w = Window.partitionBy(group).orderBy(F.desc(score))
    cum = by.withColumns({"tp": F.sum("p").over(w), "fp": F.sum(F.col("m") - F.col("p")).over(w)}).join(ok, group)
    j = cum.withColumn("j", F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg"))
    return j.groupBy(group).agg(F.max_by(score, F.struct("j", score)).alias("threshold"), F.max("j").alias("youden"), F.first("p90").alias("p90"))


def validation_report(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: rows, labelled rows, means of both kinds, their distance, correlation and AUROC."""
    lab = F.col(label).cast("int")
    means = df.agg(F.count("*").alias("n"), F.sum(lab).alias("positives"), F.avg(F.when(lab == 1, F.col(score))).alias("mean_pos"), F.avg(F.when(lab == 0, F.col(score))).alias("mean_neg"), pearson(score, label).alias("r"))
    area = auroc(df, score, label).select("auroc")
    return means.withColumn("separation", F.col("mean_neg") - F.col("mean_pos")).join(F.broadcast(area))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, tp, fp, fn, f1) for score > threshold: one pass, each row counted under each threshold by a literal array."""
    t = df.select(F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold"), F.col(score).alias("s"), F.col(label).cast("int").alias("l"))
    hit = F.col("s") > F.col("threshold")
    s = t.groupBy("threshold").agg(F.count(F.when(hit & (F.col("l") == 1), 1)).alias("tp"), F.count(F.when(hit & (F.col("l") == 0), 1)).alias("fp"), F.count(F.when(~hit & (F.col("l") == 1), 1)).alias("fn"))
    return s.withColumn("f1", 2.0 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)))


def baseline(df: DataFrame, value: str, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.when(F.count(value) < 2, 0.0).otherwise(F.stddev_pop(value)).alias("sd"))


def outliers(df: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows below mean - sigmas * sd of the whole column."""
    return df.join(F.broadcast(baseline(df, value))).where(F.col(value) < F.col("mean") - sigmas * F.col("sd")).drop("mean", "sd")


def model_stats(log: DataFrame, model: str = "model_name", delta: str = "delta", smells: str = "smells_introduced", top: int = 5) -> DataFrame:
    """Per model: runs, mean and population sd of the delta, share of deltas of at least 0, and the commonest findings."""
    base = log.groupBy(model).agg(F.count("*").alias("runs"), F.avg(delta).alias("mean_delta"), F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop(delta)).alias("sd_delta"), F.avg(F.when(F.col(delta) >= 0, 1.0).otherwise(0.0)).alias("pass_rate"))
    often = top_n(log.select(model, F.explode(smells).alias("smell")), "smell", top, model)
    return base.join(often.groupBy(model).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "smell"))), lambda x: x["smell"]).alias("top_smells")), model, "left")


def top_n(df: DataFrame, item: str, n: int, *groups: str) -> DataFrame:
    """The n commonest items, ties by item."""
    c = df.groupBy(*groups, item).agg(F.count("*").alias("n"))
    if not groups:
        return c.orderBy(F.desc("n"), item).limit(n)
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), item))).where(F.col("rank") <= n)


def telemetry_aggregates(df: DataFrame, keys: tuple[str, ...] = ("smell_type", "language"), predicted: str = "predicted_delta", actual: str = "actual_delta") -> DataFrame:
    """Per key: n, means, mean absolute error and its nearest-rank median and 90th percentile."""
    err = F.abs(F.col(predicted) - F.col(actual))
    return df.withColumn("_e", err).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), F.avg("_e").alias("mae"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _e)").alias("p50"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY _e)").alias("p90"),
    )


def with_difference(df: DataFrame, before: str, after: str) -> DataFrame:
    """Introduced and fixed items of two array columns; repeats are kept."""
    return df.withColumns({"introduced": F.filter(after, lambda x: ~F.array_contains(before, x)), "fixed": F.filter(before, lambda x: ~F.array_contains(after, x))})
