"""Findings as SARIF, GitLab JSON, CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule ids and weakness numbers of finding types.
RULES = {
    "SqlInjectionRisk": ("HAC101", 89), "XssRisk": ("HAC102", 79), "CommandInjectionRisk": ("HAC103", 78), "PathTraversalRisk": ("HAC104", 22),
    "HardcodedCredential": ("HAC105", 798), "HardcodedApiKey": ("HAC106", 798), "UnsafeDeserialization": ("HAC107", 502), "SsrfRisk": ("HAC108", 918),
    "CryptographicMisuseRisk": ("HAC109", 327), "DependencyVulnerability": ("HAC110", 1104), "SlopsquattingRisk": ("HAC111", 1357), "HallucinatedPackageImport": ("HAC112", 1357),
}


def rule_id(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, (r, _) in RULES.items() for x in (k, r))), kind), kind)


def cwe(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, (_, n) in RULES.items() for x in (k, n))), kind)


def line_hash(path: Column, rule: Column, line: Column) -> Column:
    return F.concat(F.substring(F.sha2(F.concat(path, rule, line.cast("string")), 256), 1, 16), F.lit(":1"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame, path: str = "path") -> DataFrame:
    """One result struct as JSON for each finding; a row each, so that any number can be written in parallel."""
    rule = rule_id(F.col("type"))
    location = F.struct(F.struct(F.struct(F.col(path).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(rule.alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("type").alias("text")).alias("message"), F.array(location).alias("locations"), F.struct(line_hash(F.col(path), rule, F.coalesce("line", F.lit(1))).alias("primaryLocationLineHash")).alias("partialFingerprints"))
    return findings.select(path, F.to_json(result).alias("result"))


def rules(findings: DataFrame) -> DataFrame:
    """Each rule once, with its weakness."""
    return findings.select("type").distinct().select(rule_id(F.col("type")).alias("id"), F.col("type").alias("name"), cwe(F.col("type")).alias("cwe"))


def taxa(findings: DataFrame) -> DataFrame:
    return rules(findings).where("cwe is not null").select(F.concat(F.lit("CWE-"), "cwe").alias("id")).distinct()


def sarif(findings: DataFrame, tool: str, path: str = "path") -> DataFrame:
    """One report for each path, as JSON: a run's results are those of one file, never of all."""
    r = sarif_results(findings, path).groupBy(path).agg(F.sort_array(F.collect_list("result")).alias("r"))
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":['
    return r.select(path, F.concat(F.lit(head), F.array_join("r", ","), F.lit("]}]}")).alias("report"))


def gitlab(findings: DataFrame, path: str = "path") -> DataFrame:
    """One issue as JSON for each finding; the fingerprint takes the path as it is, the location without ./"""
    severity = F.when(F.col("severity") == "critical", "critical").when(F.col("severity") == "high", "major").when(F.col("severity") == "medium", "minor").otherwise("info")
    issue = F.struct(F.col("type").alias("description"), F.col("type").alias("check_name"), F.md5(F.concat(F.col(path), F.col("type"), F.coalesce("line", F.lit(1)).cast("string"))).alias("fingerprint"), severity.alias("severity"), F.struct(F.regexp_replace(F.col(path), r"^\./", "").alias("path"), F.struct(F.coalesce("line", F.lit(1)).alias("begin")).alias("lines")).alias("location"))
    return findings.select(path, F.to_json(issue).alias("issue"))


def write_csv(df: DataFrame, path: str) -> None:
    """Doubles with four decimals, and a header."""
    four = [F.format_number(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*[F.regexp_replace(x, ",", "").alias(c) if t == "double" else x for x, (c, t) in zip(four, df.dtypes, strict=True)]).write.option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
