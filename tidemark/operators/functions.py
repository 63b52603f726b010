"""Function tables (path, name, line, length, cc, cognitive, nesting, params) and the findings that follow from them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tables import THRESHOLDS
from tidemark.operators.textsmells import union

SCHEMA = "path string, name string, line int, length int, cc int, cognitive int, nesting int, params int, chunks int, chain int, booleans int, numbers int, documented boolean, parameters array<string>"
FINDING = "path string, type string, severity string, function_name string, line int, metric_value double"

# For each language of the second tier, how a function starts and what adds to its complexity.
TIER_B: dict[str, tuple[str, str]] = {
    "bash": (r"^\s*(?:function\s+([\w-]+)|([\w-]+)\s*\(\)\s*\{?)", r"\b(?:if|elif|while|for|until|case)\b|&&|\|\|"),
    "lua": (r"^\s*(?:local\s+)?function\s+([\w.:]+)", r"\b(?:if|elseif|while|for|repeat|and|or)\b"),
    "r": (r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(", r"\b(?:if|for|while|repeat)\b|&&|\|\|"),
    "perl": (r"^\s*sub\s+(\w+)", r"\b(?:if|elsif|unless|while|until|for|foreach)\b|&&|\|\|"),
    "powershell": (r"(?i)^\s*function\s+([\w-]+)", r"(?i)\b(?:if|elseif|while|for|foreach|switch)\b|-and\b|-or\b"),
    "c": (r"^[A-Za-z_][\w\s\*]*?\b(\w+)\s*\([^;{}]*\)\s*\{", r"\b(?:if|for|while|case)\b|&&|\|\||\?"),
    "cpp": (r"^[A-Za-z_][\w\s\*&:<>,]*?\b([\w~]+)\s*\([^;{}]*\)\s*(?:const\s*)?\{", r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"),
    "zig": (r"^\s*(?:pub\s+)?fn\s+(\w+)", r"\b(?:if|while|for|switch|and|or|catch|orelse)\b"),
    "nim": (r"^\s*(?:proc|func|method)\s+(\w+)", r"\b(?:if|elif|while|for|case|and|or|except)\b"),
    "erlang": (r"^([a-z]\w*)\s*\([^)]*\)\s*(?:when\b.*)?->", r"\b(?:case|if|receive|andalso|orelse|catch)\b"),
    "groovy": (r"^\s*(?:def|void|\w+)\s+(\w+)\s*\([^)]*\)\s*\{", r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"),
    "dart": (r"^\s*(?:[\w<>?]+\s+)(\w+)\s*\([^)]*\)\s*(?:async\s*)?\{", r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"),
    "crystal": (r"^\s*def\s+([\w?!.]+)", r"\b(?:if|elsif|unless|while|until|when|rescue)\b|&&|\|\|"),
    "fsharp": (r"^\s*let\s+(?:rec\s+|inline\s+)?(\w+)\s+[\w(]", r"\b(?:if|elif|for|while|match|when)\b|&&|\|\|"),
    "vbnet": (r"(?i)^\s*(?:public\s+|private\s+|shared\s+)*(?:sub|function)\s+(\w+)", r"(?i)\b(?:if|elseif|for|while|case|andalso|orelse|catch)\b"),
    "clojure": (r"^\s*\(defn-?\s+([\w?!-]+)", r"\((?:if|when|cond|case|loop|and|or)\b"),
    "cobol": (r"(?i)^\s{0,10}([\w-]+)\s+section\s*\.", r"(?i)\b(?:if|evaluate|perform|when)\b"),
    "apex": (r"(?i)^\s*(?:public|private|global|protected)\s+(?:static\s+)?[\w<>,\s]+?\s(\w+)\s*\([^)]*\)\s*\{", r"(?i)\b(?:if|for|while|catch|when)\b|&&|\|\||\?"),
    "objc": (r"^[-+]\s*\([^)]*\)\s*(\w+)", r"\b(?:if|for|while|case)\b|&&|\|\||\?"),
}


def tier_b(files: DataFrame, language: str, path: str = "path", content: str = "content") -> DataFrame:
    """Functions by their starting lines; each spans to the next start; complexity is 1 plus keywords, the rest 0.

    All inside the row: the lines' array is filtered to starts, and each start takes the next one's line.
    """
    start, keyword = TIER_B[language]
    name = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(x, start, g), F.lit("")) for g in range(1, start.count("(") - start.count("(?") + 1)))
    lines = F.split(content, "\n", -1)
    found = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.when(x.rlike(start), name(x)).alias("name"))), lambda h: h["name"].isNotNull())
    rows = files.select(F.col(path).cast("string").alias("path"), lines.alias("_l"), found.alias("_f")).where(F.size("_f") > 0)
    rows = rows.select("path", "_l", "_f", F.posexplode("_f").alias("_i", "_s"))
    end = F.coalesce(F.get("_f", F.col("_i") + 1)["line"] - 1, F.size("_l"))
    body = F.array_join(F.slice("_l", F.col("_s.line"), end - F.col("_s.line") + 1), "\n")
    cc = 1 + F.regexp_count(body, F.lit(keyword))
    return rows.select("path", F.col("_s.name").alias("name"), F.col("_s.line").alias("line"), (end - F.col("_s.line") + 1).cast("int").alias("length"), cc.cast("int").alias("cc"), F.lit(0).alias("cognitive"), F.lit(0).alias("nesting"), F.lit(0).alias("params"))


class _Measures(ast.NodeVisitor):
    """Counts inside one function, without its inner functions' parameters."""

    BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)
    NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)

    def __init__(self):
        self.cc, self.cognitive, self.deepest, self.booleans, self.chain, self.numbers = 1, 0, 0, 0, 0, 0

    def walk(self, node: ast.AST, depth: int, branch: bool = False) -> None:
        inner = depth
        if isinstance(node, self.BRANCH):
            self.cc += 1
            self.cognitive += 1 if branch else 1 + depth
        if isinstance(node, ast.BoolOp):
            self.cc += len(node.values) - 1
            self.cognitive += 1
            self.booleans = max(self.booleans, len(node.values) - 1)
        if isinstance(node, self.NEST) and not branch:
            inner = depth + 1
            self.deepest = max(self.deepest, inner)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool) and node.value not in (0, 1, -1):
            self.numbers += 1
        if isinstance(node, ast.Call):
            n, x = 0, node
            while isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute):
                n, x = n + 1, x.func.value
            self.chain = max(self.chain, n)
        for field, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    # An elif is the only statement of an else; it goes no deeper.
                    chained = isinstance(node, ast.If) and field == "orelse" and len(node.orelse) == 1 and isinstance(child, ast.If) and child.col_offset == node.col_offset
                    self.walk(child, depth if chained else inner, chained)


def _python_functions(path: str, source: str) -> list[tuple]:
    tree = ast.parse(source)
    out = []
    for f in ast.walk(tree):
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        m = _Measures()
        for child in f.body:
            m.walk(child, 0)
        args = [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs, *filter(None, (f.args.vararg, f.args.kwarg))]
        names = [a.arg for a in args if not (a.arg in ("self", "cls") and a.annotation is None)]
        chunks = sum(isinstance(x, _Measures.NEST) for x in f.body)
        out.append((path, f.name, f.lineno, f.end_lineno - f.lineno + 1, m.cc, m.cognitive, m.deepest, len(names), chunks, m.chain, m.booleans, m.numbers, ast.get_docstring(f) is not None, names))
    return out


def python_functions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Functions of Python sources by the language's own parser; a source that doesn't parse gives one row with a null name."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, source in zip(b["path"], b["content"], strict=True):
                try:
                    rows += _python_functions(p, source or "")
                except (SyntaxError, ValueError, RecursionError):
                    rows.append((p, None, *[None] * (len(names) - 2)))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("line", "length", "cc", "cognitive", "nesting", "params", "chunks", "chain", "booleans", "numbers")})

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInPandas(run, SCHEMA)


def _rows(f: DataFrame, kind: str, when: Column, severity: Column | str, value: Column) -> DataFrame:
    s = F.lit(severity) if isinstance(severity, str) else severity
    return f.where(when).select("path", F.lit(kind).alias("type"), s.alias("severity"), F.col("name").alias("function_name"), F.col("line").cast("int").alias("line"), value.cast("double").alias("metric_value"))


def threshold_findings(f: DataFrame, t: dict[str, int] = THRESHOLDS) -> DataFrame:
    """Complexity, nesting, length, parameters and cognitive complexity: five filters over one table, no shuffle."""
    c = F.col
    return union([
        _rows(f, "ComplexMethod", c("cc") > t["complexMethodThreshold"], F.when(c("cc") > t["criticalComplexityThreshold"], "critical").otherwise("high"), c("cc")),
        _rows(f, "DeepNesting", c("nesting") > t["deepNestingThreshold"], F.when(c("nesting") > t["criticalNestingThreshold"], "critical").when(c("nesting") > t["highNestingThreshold"], "high").otherwise("medium"), c("nesting")),
        _rows(f, "LargeMethod", c("length") > t["largeMethodLines"], "medium", c("length")),
        _rows(f, "LongParameterList", c("params") > t["longParameterList"], "medium", c("params")),
        _rows(f, "CognitiveComplexity", c("cognitive") > t["cognitiveComplexityThreshold"], F.when(c("cognitive") > t["criticalCognitiveThreshold"], "critical").otherwise("high"), c("cognitive")),
    ])


def shape_findings(f: DataFrame, t: dict[str, int] = THRESHOLDS) -> DataFrame:
    """Findings that need the parser's counts: chunks, logical operators, call chains, numbers."""
    c = F.col
    return union([
        _rows(f, "BumpyRoad", c("chunks") >= t["bumpyRoadChunkThreshold"], "medium", c("chunks")),
        _rows(f, "TidyOpportunity", c("chunks").isin(2, 3), "low", c("chunks")),
        _rows(f, "ComplexConditional", c("booleans") >= t["booleanChainThreshold"], "medium", c("booleans")),
        _rows(f, "MessageChain", c("chain") >= t["chainThreshold"], "medium", c("chain")),
        _rows(f, "MagicNumber", c("numbers") >= 3, "low", c("numbers")),
    ])


def complexity_mass(f: DataFrame) -> DataFrame:
    """Files of three functions or more where complex ones hold more than 60 % of the mass cc * sqrt(length)."""
    mass = F.col("cc") * F.sqrt("length")
    m = f.groupBy("path").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("cc") > 10, mass).otherwise(0.0)) / F.sum(mass)).alias("share"))
    return m.where("n >= 3 and share > 0.60").select("path", F.lit("ComplexityMassConcentration").alias("type"), F.when(F.col("share") > 0.80, "critical").otherwise("high").alias("severity"), F.lit(None).cast("string").alias("function_name"), F.lit(1).alias("line"), F.col("share").alias("metric_value"))


def data_clumps(f: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of a file's functions with least parameter names in common, once for each set of names."""
    a = f.select("path", F.col("name").alias("na"), F.col("line").alias("la"), F.col("parameters").alias("pa")).where(F.size("pa") >= least)
    b = a.toDF("path", "nb", "lb", "pb")
    both = a.join(b, "path").where("la < lb").withColumn("names", F.array_sort(F.array_intersect("pa", "pb"))).where(F.size("names") >= least)
    first = both.groupBy("path", "names").agg(F.min(F.struct("la", "na")).alias("f"))
    return first.select("path", F.lit("DataClumps").alias("type"), F.lit("medium").alias("severity"), F.col("f.na").alias("function_name"), F.col("f.la").alias("line"), F.size("names").cast("double").alias("metric_value"))


def doc_coverage(f: DataFrame) -> DataFrame:
    """Files with three public functions of more than three lines and fewer than 80 % documented."""
    d = f.where("length > 3 and not startswith(name, '_')").groupBy("path").agg(F.count("*").alias("n"), F.avg(F.col("documented").cast("double")).alias("share"))
    return d.where("n >= 3 and share < 0.8").select("path", F.lit("LowDocCoverage").alias("type"), F.when(F.col("share") < 0.5, "medium").otherwise("low").alias("severity"), F.lit(None).cast("string").alias("function_name"), F.lit(1).alias("line"), F.col("share").alias("metric_value"))


def fragmented(f: DataFrame, least: int = 8) -> DataFrame:
    """Files with least functions of complexity 1 and fewer than four lines."""
    d = f.where("cc = 1 and length < 4").groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return d.select("path", F.lit("FragmentedCode").alias("type"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("function_name"), F.lit(1).alias("line"), F.col("n").cast("double").alias("metric_value"))


def split_residue(f: DataFrame, files: DataFrame, least: int = 4) -> DataFrame:
    """Callers with least private helpers of complexity above 2 that are named once outside their definition, in that caller."""
    h = f.where("cc > 2 and startswith(name, '_')").select("path", F.col("name").alias("h"), F.col("line").alias("hl"))
    text = files.select(F.col("path").cast("string").alias("path"), F.split("content", "\n", -1).alias("_l"))
    body = F.array_join(F.slice("_l", F.col("line"), F.col("length")), "\n")
    calls = f.select("path", "name", "line", "length").join(text, "path").select("path", "name", "line", body.alias("b")).join(h, "path").where("hl <> line")
    used = calls.withColumn("n", F.regexp_count("b", F.concat(F.lit(r"\b"), "h", F.lit(r"\s*\(")))).where("n > 0")
    one = used.groupBy("path", "h").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.first("name").alias("name"), F.first("line").alias("line")).where("c = 1 and n = 1")
    d = one.groupBy("path", "name", "line").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    return d.select("path", F.lit("SplitResidue").alias("type"), F.lit("medium").alias("severity"), F.col("name").alias("function_name"), "line", F.col("k").cast("double").alias("metric_value"))


def maintainability(cc: Column, volume: Column, lines: Column) -> Column:
    """Index from 0 to 100."""
    return F.greatest(F.lit(0.0), (171 - 5.2 * F.log(F.greatest(volume, F.lit(1))) - 0.23 * cc - 16.2 * F.log(F.greatest(lines, F.lit(1)))) * 100 / 171)


def rollup(f: DataFrame) -> DataFrame:
    """Per file: functions, greatest and rounded mean complexity and nesting; cognitive complexity stays 0."""
    mean = lambda x: F.floor(F.avg(x) + 0.5).cast("bigint")
    return f.groupBy("path").agg(F.count("*").alias("functions"), F.max("cc").alias("max_cc"), mean("cc").alias("mean_cc"), F.max("nesting").alias("max_nesting"), mean("length").alias("mean_length"), F.lit(0).alias("cognitive"))
