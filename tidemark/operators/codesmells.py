"""Findings from source text: exceptions, asynchronous code, calls of language models, assumptions, type escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.textsmells import _found, by_line, by_match, union

# The patterns below decide what is found.
EMPTY_CATCH = r"catch\s*\([^)]*\)\s*\{\s*(?://[^\n]*)?\s*\}"
ANY_CATCH = r"catch\s*\(\w+\)\s*\{(?!\s*(?://[^\n]*)?\s*\})(?!\s*throw\s+\w+\s*;?\s*\})[^}]*\}"
LOST_CAUSE_JS = r"throw\s+new\s+\w*Error\s*\(\s*\w+\.message\s*\)"
JVM_BROAD, LOST_CAUSE_JVM = r"catch\s*\(\s*(?:final\s+)?(?:Exception|Throwable)\s+\w+\s*\)", r"throw\s+new\s+\w+\s*\(\s*\w+\.getMessage\(\)\s*\)"
UNREACHABLE_JVM = JVM_BROAD + r"(?=[\s\S]{0,600}?\bcatch\s*\()"
PASS_EXCEPT = r"(?m)^[ \t]*except\b[^:\n]*:[ \t]*(?:#[^\n]*)?\n(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*pass[ \t]*(?:#[^\n]*)?$"
BROAD_EXCEPT = r"(?m)^[ \t]*except(?:[ \t]+Exception(?:[ \t]+as[ \t]+\w+)?)?[ \t]*:(?![ \t]*(?:#[^\n]*)?\n(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*pass[ \t]*(?:#[^\n]*)?(?:\n|$))"
LOST_CAUSE_PY = r"^\s*raise\s+\w+\([^)]*str\(\w+\)[^)]*\)\s*$"
ASYNC_TOKENS = r"\basync\s+function\s*\*?\s*\w*\s*\([^)]*\)[^{};\n]*\{|\bawait\b|\bnew\s+Promise\s*\(|[{}\n]"
TRY_TOKENS = r"\btry\s*\{|\breturn\s+await\s+(?!Promise\.(?:all|race|allSettled|any)\b)|[{}\n]"
ONE_ARGUMENT = r"\bnew\s+Promise\s*\(\s*(?:async\s*)?\(\s*(?!reject\b)\w+\s*\)"
NESTED_THEN = r"\.then\s*\([^()]*\n?[^()]*(?:\([^()]*\)[^()]*)*\breturn\b(?:[^\n]*\n){0,3}?[^\n]*\.then\s*\("
INFERENCE = r"(?:client|openai|anthropic)\.(?:chat\.completions|messages|responses)\.create\s*\(|(?:new\s+)?(?:ChatOpenAI|ChatAnthropic)\s*\("
PINNABLE = r"(?i)^(?:gpt-|claude-|gemini-|text-davinci|text-embedding|o1|o3|o4|mistral|llama)"
TYPE_ESCAPE = r"@ts-(?:ignore|nocheck|expect-error)\b|:\s*any\b|\bas\s+any\b|<any>"


def exceptions(files: DataFrame, path: str = "path", content: str = "content", language: str = "language") -> DataFrame:
    """Swallowed, broad and cause-losing handlers for JavaScript, Python and JVM languages."""
    kind, lang = "ExceptionHandlingAntiPattern", F.col(language)
    js, jvm, py = files.where(lang.isin("typescript", "javascript")), files.where(lang.isin("java", "kotlin", "scala")), files.where(lang == "python")
    m = lambda f, p, s: by_match(f, kind, p, s, path, content)
    return union([
        m(js, EMPTY_CATCH, "medium"), m(js, ANY_CATCH, "low"), m(js, LOST_CAUSE_JS, "high"),
        m(jvm, EMPTY_CATCH, "medium"), m(jvm, JVM_BROAD, "low"), m(jvm, LOST_CAUSE_JVM, "high"), m(jvm, UNREACHABLE_JVM, "medium"),
        m(py, PASS_EXCEPT, "medium"), m(py, BROAD_EXCEPT, "low"), by_line(py, kind, LOST_CAUSE_PY, "high", path, content),
    ])


def _scanned(content: str, tokens: str, opens: str, on, closed) -> Column:
    """Lines that one scan over the tokens of a text finds, in order of their discovery.

    The state holds the line, the depth of braces, the blocks that a token starting with opens has opened, each with its
    line and depth, and the lines found. on(state, token) gives (blocks, found) for tokens other than braces and line
    breaks; closed(ended) the lines found when blocks end.
    """
    block = "array<struct<line:int,depth:int>>"
    start = F.struct(F.lit(1).alias("line"), F.lit(0).alias("depth"), F.array().cast(block).alias("blocks"), F.array().cast("array<int>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
        opening = t.startswith(opens) & t.endswith("{")
        other = ~(t.endswith("{") | (t == "}") | (t == "\n"))
        blocks, found = on(s, t)
        ended = F.filter(s["blocks"], lambda x: x["depth"] == s["depth"])
        kept = F.filter(s["blocks"], lambda x: x["depth"] != s["depth"])
        opened = F.concat(s["blocks"], F.array(F.struct(s["line"].alias("line"), (s["depth"] + 1).alias("depth"))))
        return F.struct(
            (s["line"] + breaks).cast("int").alias("line"),
            F.when(t.endswith("{"), s["depth"] + 1).when(t == "}", s["depth"] - 1).otherwise(s["depth"]).cast("int").alias("depth"),
            F.when(opening, opened).when(t == "}", kept).when(other, blocks).otherwise(s["blocks"]).alias("blocks"),
            F.when(t == "}", F.concat(s["found"], closed(ended))).when(other, found).otherwise(s["found"]).alias("found"),
        )

    return F.aggregate(F.regexp_extract_all(content, F.lit(tokens), F.lit(0)), start, step, lambda s: s["found"])


def asynchronous(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Async functions that await nothing, awaited returns outside try, nested reactions, executors without reject."""
    kind, none = "AsyncAntiPattern", F.array().cast("array<int>")
    # A function's block goes as soon as something in it awaits; those left when their brace closes are found.
    idle = _scanned(content, ASYNC_TOKENS, "async", lambda s, t: (F.array().cast("array<struct<line:int,depth:int>>"), s["found"]), lambda ended: F.transform(ended, lambda x: x["line"]))
    plain = files.withColumn(content, F.regexp_replace(content, r"//[^\n]*", ""))
    late = _scanned(content, TRY_TOKENS, "try", lambda s, t: (s["blocks"], F.when(F.size(s["blocks"]) == 0, F.concat(s["found"], F.array(s["line"]))).otherwise(s["found"])), lambda ended: none)
    hits = lambda lines, severity: F.transform(lines, lambda x: F.struct(x.alias("line"), F.lit(severity).alias("severity")))
    return union([
        _found(files.where(F.col(content).rlike(r"\basync\s+function\b")), kind, hits(idle, "medium"), path),
        _found(plain.where(F.col(content).rlike(r"\breturn\s+await\b")), kind, hits(late, "low"), path),
        by_match(files, kind, NESTED_THEN, "low", path, content), by_match(files, kind, ONE_ARGUMENT, "low", path, content),
    ])


def model_calls(files: DataFrame, path: str = "path", content: str = "content", reach: int = 800) -> DataFrame:
    """Findings for each call of a language model, from the text up to its closing bracket or reach signs."""
    parts = F.split(content, INFERENCE, -1)
    n = F.regexp_count(F.col(content), F.lit(INFERENCE))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # The window ends where the brackets balance; two levels inside cover calls as they are written.
    window = lambda x: F.coalesce(F.nullif(F.regexp_extract(F.substring(x, 1, reach), r"^((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", 1), F.lit("")), F.substring(x, 1, reach))
    sites = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct((1 + F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + breaks(x))).alias("line"), window(F.get(parts, i)).alias("w")))
    s = files.where(F.col(content).rlike(INFERENCE)).select(F.col(path).alias("path"), F.col(content).rlike(r"(?:new\s+)?(?:OpenAI|Anthropic)\s*\(\s*\{[^}]*\b(?:timeout|max_retries|maxRetries)\b").alias("_t"), F.explode(sites).alias("s"))
    w = F.col("s.w")
    model = F.regexp_extract(w, r"model\s*[:=]\s*[\"']([^\"']+)[\"']", 1)
    rules = [
        ("LlmUnboundedCall", ~w.rlike(r"\b(?:max_tokens|maxTokens|max_completion_tokens|max_output_tokens)\b") & ~w.rlike(r"\b(?:timeout|max_retries|maxRetries)\b") & ~F.col("_t")),
        ("LlmUnpinnedModel", model.rlike(PINNABLE) & ~model.rlike(r"-\d{4}-?\d{2}-?\d{2}")),
        ("LlmNoSystemMessage", w.rlike(r"\bmessages\b") & ~w.rlike(r"[\"']?role[\"']?\s*:\s*[\"'](?:system|developer)[\"']|\bsystem\s*[:=]")),
        ("LlmNoStructuredOutput", ~w.rlike(r"\b(?:response_format|output_schema|outputSchema|responseFormat|json_schema|jsonSchema|structuredOutputs)\b")),
        ("LlmUnsetTemperature", ~w.rlike(r"\btemperature\b")),
    ]
    kinds = F.filter(F.array(*(F.when(c, k) for k, c in rules)), lambda x: x.isNotNull())
    return s.select("path", F.explode(kinds).alias("type"), F.lit("medium").alias("severity"), F.lit(None).cast("string").alias("function_name"), F.col("s.line").cast("int").alias("line"), F.lit(None).cast("double").alias("metric_value"))


def assumptions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Inline types of four fields, comparisons with literals, unguarded finds, awaits without try."""
    return union([
        by_match(files, "AbstractionLeakage", r":\s*\{\s*(?:\w+\??\s*:\s*[^;,{}]+[;,]\s*){3,}\w+\??\s*:\s*[^;,{}]+[;,]?\s*\}", "medium", path, content),
        by_line(files, "HardcodedAssumption", r"^(?!.*(?://|/\*))(?!\s*(?:const|final)\s+[A-Z_]+\b).*(?:===?|!==?|[<>]=?)\s*(?!0\b|1\b)(?:\d{1,10}\b|[\"'][^\"']+[\"'])", "low", path, content),
        by_line(files, "MissingEdgeCase", r"^(?!.*\?\.).*\.find\s*\([^\n]*\)\.\w+", "medium", path, content),
        by_match(files, "MissingEdgeCase", r"\basync\s+function\b(?=[\s\S]{0,600}?\bawait\b)(?![\s\S]{0,600}?\btry\s*\{)", "low", path, content),
    ])


def type_escapes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return by_match(files, "TypeSafetyEscape", TYPE_ESCAPE, "medium", path, content)


def style(files: DataFrame, convention: str, path: str = "path", content: str = "content") -> DataFrame:
    """Declared names that don't follow the declared convention, camel or snake."""
    other = r"[a-z0-9]+_[a-z0-9_]+" if convention == "camel" else r"[a-z]+[A-Z]\w*"
    return by_match(files, "StyleInconsistency", rf"\b(?:const|let|var|def|function)\s+{other}\b", "low", path, content)
