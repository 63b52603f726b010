"""Change history: churn, hotspots, congestion, ownership, trends.

Inputs are commit-file rows; column roles are parameters, times are compared with an explicit as_of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import js_round, ladder


def since(df: DataFrame, as_of: str | Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last days before as_of; the bound is a plain comparison, so the scan can skip row groups."""
    at = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return df.where(F.col(ts) >= at - F.expr(f"INTERVAL {days} DAYS"))


def since_date(as_of: Column, days: int) -> Column:
    return F.date_sub(as_of, days)


def churn(df: DataFrame, path: str = "path", sha: str = "sha", added: str = "added", deleted: str = "deleted") -> DataFrame:
    """(path, churn, commits): one aggregation for both."""
    return df.groupBy(path).agg(F.sum(F.col(added) + F.col(deleted)).alias("churn"), F.count_distinct(sha).alias("commits"))


def change_frequency(df: DataFrame, path: str = "path", sha: str = "sha") -> DataFrame:
    return df.groupBy(path).agg(F.count_distinct(sha).alias("commits"))


def code_churn(df: DataFrame, loc: DataFrame, path: str = "path", added: str = "added", deleted: str = "deleted", lines: str = "loc") -> DataFrame:
    """Changed lines as a share of the file's, in percent; above 25, 40 and 80 low, medium and high."""
    sums = df.groupBy(path).agg(F.sum(F.col(added) + F.col(deleted)).alias("churn"))
    rate = F.col("churn") / F.greatest(F.coalesce(F.col(lines), F.lit(0)), F.lit(1)) * 100.0
    out = sums.join(loc.select(path, lines), path, "left").withColumn("rate", rate)
    return out.select(path, "churn", "rate", ladder(F.col("rate"), [(">", 80, "high"), (">", 40, "medium"), (">", 25, "low")]).alias("severity"))


def hotspots(df: DataFrame, complexity: DataFrame, min_commits: int = 3, top: int | None = 10, path: str = "path", sha: str = "sha", added: str = "added", deleted: str = "deleted", measure: str = "complexity") -> DataFrame:
    """Churn times complexity, each over its greatest among files with enough commits; healthy files are dropped."""
    eligible = churn(df, path, sha, added, deleted).where(F.col("commits") >= min_commits)
    both = eligible.join(complexity.select(path, measure), path, "left").na.fill(0, [measure])
    # Two scalars: one aggregate row meets every row, as a broadcast of known size.
    most = both.agg(F.greatest(F.max("churn"), F.lit(1)).alias("_c"), F.greatest(F.max(measure), F.lit(1)).alias("_m"))
    score = (F.col("churn") / F.col("_c")) * (F.col(measure) / F.col("_m"))
    out = both.join(F.broadcast(most)).select(path, "churn", "commits", measure, score.alias("score"))
    out = out.withColumn("severity", ladder(F.col("score"), [(">", 0.7, "critical"), (">", 0.4, "warning")], "healthy")).where("severity <> 'healthy'")
    return out if top is None else out.orderBy(F.desc("score"), path).limit(top)


def complexity_score(cc: Column, cognitive: Column, lines: Column) -> Column:
    return cc + cognitive + F.log10(F.greatest(lines, F.lit(1)))


def ranked_hotspots(df: DataFrame, path: str, commits: str, complexity: str, top: int = 10) -> DataFrame:
    """The first max(top, 10 %) files by commits times complexity; severity by rank, under 1 % high, under 5 % medium.

    Only the kept rows are ranked, after a distributed top-k, so no task sorts all files.
    """
    n = df.count()
    keep = max(top, -(-n // 10))
    best = df.withColumn("score", F.col(commits) * F.col(complexity)).orderBy(F.desc("score"), path).limit(keep)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), path)) - 1
    share = F.col("idx") / F.lit(max(n, 1))
    return best.withColumn("idx", rank).select(path, "score", "idx", ladder(share, [("<", 0.01, "high"), ("<", 0.05, "medium")], "low").alias("severity"), js_round(share * 100).alias("percentile"))


def congestion(df: DataFrame, path: str = "path", author: str = "author", steps=((10, "high"), (5, "medium"), (3, "low"))) -> DataFrame:
    """Distinct authors of each file."""
    out = df.groupBy(path).agg(F.count_distinct(author).alias("authors"))
    return out.withColumn("severity", ladder(F.col("authors"), [(">=", n, x) for n, x in steps]))


def sprint_congestion(df: DataFrame, as_of: str | Column, path: str = "path", author: str = "author", ts: str = "ts", days: int = 14) -> DataFrame:
    return congestion(since(df, as_of, days, ts), path, author, ((5, "high"), (3, "medium")))


def commit_shares(df: DataFrame, path: str = "path", author: str = "author") -> DataFrame:
    n = df.groupBy(path, author).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(path)))


def entropy(shares: DataFrame, path: str = "path", share: str = "share") -> DataFrame:
    """Shannon entropy over log2 of the number of shares; 0 for one share, 1 at most."""
    sums = shares.where(F.col(share) > 0).groupBy(path).agg((-F.sum(F.col(share) * F.log2(share))).alias("h"), F.count("*").alias("k"))
    return sums.select(path, F.when(F.col("k") <= 1, 0.0).otherwise(F.least(F.col("h") / F.log2("k"), F.lit(1.0))).alias("entropy"))


def bus_factor_estimate(shares: DataFrame, path: str = "path", author: str = "author", share: str = "share") -> DataFrame:
    """The fewest people whose shares add up to more than half."""
    w = Window.partitionBy(path).orderBy(F.desc(share), author)
    seen = shares.select(path, F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("held"), F.row_number().over(w).alias("k"))
    return seen.groupBy(path).agg(F.coalesce(F.min(F.when(F.col("held") > 0.5, F.col("k"))), F.max("k")).alias("bus_factor"))


def bus_factor(df: DataFrame, path: str = "path", author: str = "author") -> DataFrame:
    """Authors, entropy and bus factor of each file; at risk under 0.3 or at one person. One shuffle for all."""
    shares = commit_shares(df, path, author)
    w = Window.partitionBy(path).orderBy(F.desc("share"), author).rowsBetween(Window.unboundedPreceding, 0)
    held = shares.withColumns({"held": F.sum("share").over(w), "k": F.row_number().over(Window.partitionBy(path).orderBy(F.desc("share"), author))})
    out = held.groupBy(path).agg(
        F.count("*").alias("authors"),
        (-F.sum(F.col("share") * F.log2("share"))).alias("h"),
        F.coalesce(F.min(F.when(F.col("held") > 0.5, F.col("k"))), F.max("k")).alias("bus_factor"),
    )
    normal = F.when(F.col("authors") <= 1, 0.0).otherwise(F.least(F.col("h") / F.log2("authors"), F.lit(1.0)))
    out = out.select(path, "authors", normal.alias("entropy"), "bus_factor")
    return out.withColumn("at_risk", (F.col("entropy") < 0.3) | (F.col("bus_factor") == 1))


def knowledge_loss(df: DataFrame, path: str = "path", author: str = "author", seq: str = "seq") -> DataFrame:
    """Degree of authorship: 3.293 first author + 0.998 commits - 0.321 others before; the owner's share and the bus factor.

    seq counts from the newest commit. Others are the distinct authors before the developer's first place in the list.
    """
    per = df.groupBy(path, author).agg(F.count("*").alias("dl"), F.min(seq).alias("first"), F.max(seq).alias("last"))
    oldest = F.max("last").over(Window.partitionBy(path))
    # Authors are distinct rows here, so those first seen earlier in the list are a running count.
    before = F.count("*").over(Window.partitionBy(path).orderBy("first").rangeBetween(Window.unboundedPreceding, -1))
    doa = F.greatest(F.lit(0.0), 3.293 * F.when(F.col("last") == oldest, 1.0).otherwise(0.0) + 0.998 * F.col("dl") - 0.321 * F.greatest(before - 1, F.lit(0)))
    scored = per.withColumn("doa", doa)
    total = F.sum("doa").over(Window.partitionBy(path))
    shares = scored.select(path, author, "doa", F.when(total > 0, F.col("doa") / total).otherwise(0.0).alias("share"))
    w = Window.partitionBy(path).orderBy(F.desc("share"), author)
    held = shares.select("*", F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("held"), F.row_number().over(w).alias("k"))
    out = held.groupBy(path).agg(F.max("share").alias("owner_share"), F.coalesce(F.min(F.when(F.col("held") >= 0.5, F.col("k"))), F.max("k")).alias("bus_factor"))
    return out.withColumn("at_risk", F.col("owner_share") >= 0.80)


def knowledge_loss_index(blame: DataFrame, active: DataFrame, path: str = "path", author: str = "author", lines: str = "lines", cap: int | None = None) -> DataFrame:
    """Share of lines by authors who are no longer active. If cap is given, both counts end there."""
    upto = (lambda n: F.least(n, F.lit(cap))) if cap else (lambda n: n)
    gone = blame.join(active.select(author).distinct().withColumn("_active", F.lit(1)), author, "left")
    out = gone.groupBy(path).agg(upto(F.sum(F.when(F.col("_active").isNull(), F.col(lines)).otherwise(0))).alias("lost"), upto(F.sum(lines)).alias("total"))
    index = F.col("lost") / F.greatest(F.col("total"), F.lit(1))
    out = out.withColumn("index", index)
    return out.withColumn("severity", ladder(F.col("index"), [(">=", 0.4, "high"), (">=", 0.2, "medium")])).withColumn("orphaned", F.col("index") > 0.4)


def trend(df: DataFrame, group: str, x: str, y: str, flat: float = 0.1) -> DataFrame:
    """Least-squares slope of y over x in each group; 0 for one point or one x."""
    out = df.groupBy(group).agg(F.coalesce(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")), F.lit(0.0)).alias("slope"), F.count("*").alias("points"))
    return out.withColumn("trend", ladder(F.col("slope"), [(">", flat, "rising"), ("<", -flat, "declining")], "stable"))


def sample_points(total: int, n: int) -> list[int]:
    """n indices spread evenly over 0 to total - 1, halves rounded up; all if there are no more."""
    if total <= n:
        return list(range(total))
    if n == 1:
        return [0]
    return [int(i * (total - 1) / (n - 1) + 0.5) for i in range(n)]


def complexity_trend(versions: DataFrame, path: str = "path", seq: str = "seq", measure: str = "cc", points: int = 5) -> DataFrame:
    """Trend of the complexity at evenly spaced versions of each file; x is the place among all its versions."""
    place = versions.withColumns({"_i": F.row_number().over(Window.partitionBy(path).orderBy(seq)) - 1, "_n": F.count("*").over(Window.partitionBy(path))})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(points - 1) + 0.5))
    chosen = place.where((F.col("_n") <= points) | F.array_contains(wanted, F.col("_i").cast("bigint")))
    return trend(chosen, path, "_i", measure)


def decay_index(df: DataFrame, dims: tuple[str, ...], weights: tuple[float, ...] = (0.35, 0.25, 0.20, 0.10, 0.10)) -> DataFrame:
    """Weighted sum of dimensions held to 0..10; bands at 3, 6 and 8 before any rounding."""
    index = sum((F.lit(w) * F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col(d).cast("double"))) for d, w in zip(dims, weights, strict=True)), F.lit(0.0))
    return df.withColumn("decay", index).withColumn("band", ladder(F.col("decay"), [("<", 3, "healthy"), ("<", 6, "warning"), ("<", 8, "degraded")], "critical"))


def brain_methods(functions: DataFrame) -> DataFrame:
    """Functions with a weighted sum of size, complexity, nesting, parameters and centrality of 0.55 and three of them over half."""
    unit = lambda x, at: F.least(F.col(x) / F.lit(float(at)), F.lit(1.0))
    named = F.when(F.col("name") == "<anonymous>", 0).otherwise(F.sum("cc").over(Window.partitionBy("path", "name")))
    f = functions.withColumn("_own", named)
    f = f.withColumn("_central", F.col("_own") / F.greatest(F.max("_own").over(Window.partitionBy("path")), F.lit(1)))
    parts = [(0.30, unit("cc", 20)), (0.25, unit("length", 100)), (0.25, unit("nesting", 5)), (0.10, unit("params", 6)), (0.10, F.col("_central"))]
    score = sum((F.lit(w) * x for w, x in parts), F.lit(0.0))
    many = sum((F.when(x > 0.5, 1).otherwise(0) for _, x in parts), F.lit(0))
    return f.withColumns({"score": score, "factors": many}).drop("_own", "_central").where("score >= 0.55 and factors >= 3")


def untested(files: DataFrame, exports: str = "exports", path: str = "path") -> DataFrame:
    """Files with exports and none of their candidate test paths among the files; 6 exports high, 3 medium."""
    from tidemark.functions.paths import candidate_tests

    sources = files.where(F.col(exports) > 0)
    tested = sources.select(F.col(path), F.explode(candidate_tests(F.col(path))).alias("_t")).join(files.select(F.col(path).alias("_t")), "_t", "left_semi").select(path)
    return sources.join(tested, path, "left_anti").select(path, exports, ladder(F.col(exports), [(">=", 6, "high"), (">=", 3, "medium")], "low").alias("severity"))


def rollup(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))
