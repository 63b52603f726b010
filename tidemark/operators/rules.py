"""Rules over before and after: differences of findings, gates, change sets, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tables import AI_READY, DIMENSIONS, PROBLEMATIC, SEVERITIES
from tidemark.operators.scoring import weight_of

AI_NATIVE = ("SlopsquattingRisk", "HallucinatedPackageImport", "AiAttributedSATD", "LlmUnboundedCall", "LlmUnpinnedModel", "LlmNoSystemMessage", "LlmNoStructuredOutput", "LlmUnsetTemperature")
STRUCTURAL = ("ComplexMethod", "DeepNesting", "BumpyRoad", "LargeMethod", "CognitiveComplexity", "BrainMethod")


def severity_rank(severity: Column) -> Column:
    """Position from low 0 to critical 3; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(v) for i, s in enumerate(SEVERITIES) for v in (s, i))), severity)


def new_findings(before: DataFrame, after: DataFrame, path: str = "path", kind: str = "type", function: str = "function_name") -> DataFrame:
    """Rows of after whose type and function the file did not have before; missing functions are equal."""
    known = before.select(F.col(path).alias("_p"), F.col(kind).alias("_t"), F.col(function).alias("_f")).distinct()
    same = (F.col(path) == F.col("_p")) & (F.col(kind) == F.col("_t")) & F.col(function).eqNullSafe(F.col("_f"))
    return after.join(known, same, "left_anti")


def without_redundant(smells: DataFrame, advisory: str = "TidyOpportunity", path: str = "path", kind: str = "type", function: str = "function_name") -> DataFrame:
    """Advisories go where the same function has a structural finding."""
    hard = smells.where(F.col(kind).isin(*STRUCTURAL)).select(F.col(path).alias("_p"), F.col(function).alias("_f")).distinct()
    cond = (F.col(path) == F.col("_p")) & F.col(function).eqNullSafe(F.col("_f")) & (F.col(kind) == advisory)
    return smells.join(hard, cond, "left_anti")


def gate(scores: DataFrame, introduced: DataFrame, path: str = "path", kind: str = "type", floor: float = PROBLEMATIC, drop: float = -0.05) -> DataFrame:
    """(path, decision, reason) from before/after scores and new findings; the first rule that denies wins."""
    has = lambda kinds: F.max(F.when(F.col(kind).isin(*kinds), 1).otherwise(0))
    flags = introduced.groupBy(path).agg(has(DIMENSIONS["security"]).alias("_sec"), has(AI_NATIVE).alias("_ai"))
    out = scores.join(flags, path, "left").na.fill(0, ["_sec", "_ai"])
    reason = F.when(F.col("_sec") == 1, "new_security").when(F.col("_ai") == 1, "new_ai_native").when(F.col("after") < floor, "below_floor").when(F.col("after") - F.col("before") < drop, "score_drop")
    return out.select(path, "before", "after", F.when(reason.isNull(), "allow").otherwise("deny").alias("decision"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def change_set(before: DataFrame, after: DataFrame, path: str = "path", margin: float = 0.5, healthy: float = 7.0) -> DataFrame:
    """Each changed file as regression, improvement, unchanged, new, new_unhealthy or removed."""
    both = before.select(path, F.col("score").alias("before")).join(after.select(path, F.col("score").alias("after")), path, "full")
    delta = F.col("after") - F.col("before")
    kind = F.when(F.col("before").isNull(), F.when(F.col("after") < healthy, "new_unhealthy").otherwise("new")).when(F.col("after").isNull(), "removed").when(delta < -margin, "regression").when(delta > margin, "improvement").otherwise("unchanged")
    return both.select(path, "before", "after", kind.alias("change"))


def overall_safe(changes: DataFrame) -> DataFrame:
    return changes.agg(F.coalesce(F.bool_and(~F.col("change").isin("regression", "new_unhealthy")), F.lit(True)).alias("safe"), F.count(F.when(F.col("change") == "regression", 1)).alias("regressions"))


def pre_commit(scores: DataFrame, healthy: float = 7.0) -> DataFrame:
    return scores.withColumn("safe", F.col("score") >= healthy)


def verdict(scores: DataFrame, smells: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """Whether a file's loop is complete, and else its first finding by severity."""
    w = Window.partitionBy(path).orderBy(F.desc(severity_rank(F.col("severity"))), line, "type")
    first = smells.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(path, F.col("type").alias("next_type"), F.col("severity").alias("next_severity"))
    return scores.join(first, path, "left").select(path, "score", (F.col("score") >= AI_READY).alias("loop_complete"), "next_type", "next_severity")


def business_case(scores: DataFrame, target: float = AI_READY) -> DataFrame:
    gain = F.greatest(F.lit(0.0), target - F.col("score"))
    return scores.withColumns({"gain": gain, "saving_percent": gain * 4, "priority": F.when(gain > 2, "high").when(gain > 0.5, "medium").otherwise("low")})


def audit_penalty(smells: DataFrame, path: str = "path") -> DataFrame:
    cost = F.when(F.col("severity").isin("critical", "high"), 0.3).when(F.col("severity") == "medium", 0.15).otherwise(0.05)
    return smells.groupBy(path).agg(F.sum(cost).alias("penalty"))


def pick_worst(smells: DataFrame, path: str = "path", derived: tuple[str, ...] = ("LowMaintainability", "ComplexityMassConcentration")) -> DataFrame:
    """For each file the finding type to mend first: severity, then the gain w * (sqrt(n) - sqrt(n - 1))."""
    per = smells.groupBy(path, "type").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank"))
    gain = weight_of(F.col("type")) * (F.sqrt("n") - F.sqrt(F.col("n") - 1))
    w = Window.partitionBy(path).orderBy(F.col("type").isin(*derived), F.desc("rank"), F.desc("gain"), "type")
    return per.withColumn("gain", gain).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def edit_mode(kind: Column, length: Column, whole: tuple[str, ...] = ("GodClass", "FeatureEnvy", "LargeFile", "DataClumps"), point: tuple[str, ...] = ("MagicNumber", "SATD", "TypeSafetyEscape")) -> Column:
    return F.when(kind.isin(*whole), "fileRewrite").when(kind.isin(*point) | (length < 30), "patch").when(length <= 200, "funcRewrite").otherwise("fileRewrite")


def goal_status(goals: DataFrame, scores: DataFrame, as_of: Column, path: str = "path") -> DataFrame:
    """Goal rows with the status that the latest score and the dates give.

    reach_target: done at the target; no_decline: fails below the score at its start; no_problem: fails on a drop of more
    than 2; planned: only dates count. A goal older than 30 days warns; one past its end is expired.
    """
    now = goals.join(scores.select(path, F.col("score").alias("now")), path, "left")
    fails = ((F.col("goal_type") == "no_problem") & (F.col("current_score") - F.col("now") > 2.0)) | ((F.col("goal_type") == "no_decline") & (F.col("now") < F.col("current_score")))
    done = (F.col("goal_type") == "reach_target") & (F.col("now") >= F.col("target_score"))
    old = F.col("created_at") < as_of - F.expr("INTERVAL 30 DAYS")
    status = F.when(F.col("expires_at") < as_of, "expired").when(fails, "failed").when(done, "done").when(old, "warning").otherwise("active")
    return now.withColumn("status", status).withColumn("previous_score", F.col("current_score")).withColumn("current_score", F.coalesce("now", "current_score")).drop("now")
