"""How ready code is for assistants: names, context size, documentation, types, signs of generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import js_round, ladder

# Short names that are well known, words that are no names, and sizes of context.
KNOWN_SHORT = (
    "i", "j", "k", "n", "m", "id", "db", "ui", "os", "fs", "io", "on", "no", "to", "in", "is", "as",
    "of", "or", "el", "fn", "cb", "ev", "ok", "ip", "pi", "pk", "rx", "tx",
)
RESERVED = (
    "const", "let", "var", "function", "return", "if", "else", "for", "while", "do", "switch", "case", "break",
    "continue", "default", "new", "try", "catch", "finally", "throw", "typeof", "instanceof", "in", "of", "class",
    "extends", "implements", "interface", "type", "enum", "import", "from", "export", "as", "async", "await", "yield",
    "this", "super", "true", "false", "null", "undefined", "void", "delete", "static", "public", "private",
    "protected", "readonly", "abstract", "override", "declare", "namespace", "module", "with", "string", "number",
    "boolean", "bigint", "symbol", "object", "any", "unknown", "never", "def", "lambda", "pass", "global", "nonlocal",
    "and", "or", "not", "is", "None", "True", "False", "self", "cls", "elif", "except", "raise", "assert", "print",
    "package", "final", "volatile", "transient", "synchronized", "throws", "native", "strictfp", "using", "sealed",
    "virtual", "out", "ref", "params", "func", "go", "chan", "select", "defer", "fallthrough", "range", "struct",
    "map", "fn", "mut", "pub", "crate", "mod", "impl", "trait", "where", "unsafe", "match", "move", "array", "echo",
    "isset", "unset", "foreach", "endforeach", "endif", "endwhile", "end", "begin", "ensure", "unless", "until",
    "when", "then", "redo", "retry", "guard", "inout", "protocol", "extension", "mutating",
)
TIERS = (4096, 8192, 16384, 32768, 65536, 131072)


def without_comments(x: Column) -> Column:
    """Comments and strings replaced by blanks, in a fixed order."""
    # The eight patterns and their order.
    for pattern, by in ((r"/\*[\s\S]*?\*/", " "), (r"//[^\n]*", " "), (r"(^|\s)#[^\n]*", "$1"), (r'"""[\s\S]*?"""', " "), (r"'''[\s\S]*?'''", " "), (r"`(?:\\.|[^`\\])*+`", " "), (r'"(?:\\.|[^"\\])*+"', " "), (r"'(?:\\.|[^'\\])*+'", " ")):
        x = F.regexp_replace(x, pattern, by)
    return x


def identifiers(x: Column) -> Column:
    """Distinct names that begin with a small letter or underscore."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\b([a-z_][a-zA-Z0-9_]*)\b"), F.lit(1)))


def naming_clarity(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """10 less .5 for each one-letter name, .3 for each two-letter name and 1.5 for mixed casing, over distinct names."""
    ids = F.filter(identifiers(without_comments(F.col(content))), lambda x: ~x.isin(*RESERVED))
    n = lambda keep: F.size(F.filter("_i", keep))
    out = files.select(path, ids.alias("_i")).select(
        path,
        n(lambda x: (F.length(x) == 1) & ~x.isin(*KNOWN_SHORT)).alias("single"),
        n(lambda x: (F.length(x) == 2) & ~x.isin(*KNOWN_SHORT)).alias("cryptic"),
        ((n(lambda x: (F.length(x) > 1) & x.rlike("[a-z][A-Z]") & ~x.contains("_")) > 0) & (n(lambda x: (F.length(x) > 1) & x.contains("_") & ~x.rlike("[a-z][A-Z]")) > 0)).cast("int").alias("mixed"),
    )
    score = 10 - 0.5 * F.col("single") - 0.3 * F.col("cryptic") - 1.5 * F.col("mixed")
    return out.withColumn("score", js_round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)) * 10) / 10)


def approx_tokens(x: Column) -> Column:
    return F.ceil(F.length(x) / 4)


def context_fit(bodies: DataFrame, path: str = "path", content: str = "content", most: int = 2000) -> DataFrame:
    """10 times the share of functions of at most 2000 tokens; the smallest context that holds the item at floor(.9 n) - 1."""
    t = bodies.select(path, approx_tokens(F.col(content)).alias("t")).groupBy(path).agg(F.count("*").alias("n"), F.avg("t").alias("mean"), F.max("t").alias("max"), F.count(F.when(F.col("t") > most, 1)).alias("over"), F.sort_array(F.collect_list("t")).alias("_s"))
    p90 = F.get("_s", F.greatest(F.lit(0), F.floor(F.size("_s") * 0.9).cast("int") - 1))
    tier = F.lit(TIERS[-1])
    for x in reversed(TIERS):
        tier = F.when(p90 <= x, x).otherwise(tier)
    return t.select(path, "n", js_round(F.col("mean")).alias("mean_tokens"), F.col("max").alias("max_tokens"), "over", (js_round((10 - 10 * F.col("over") / F.col("n")) * 10) / 10).alias("score"), tier.alias("context"))


def doc_debt(df: DataFrame, cognitive: str = "cognitive", coverage: str = "coverage") -> DataFrame:
    """min(1, cognitive / 50) * (1 - coverage); .6 high, .3 medium."""
    index = F.least(F.lit(1.0), F.col(cognitive) / 50) * (1 - F.col(coverage))
    return df.withColumn("doc_debt", index).withColumn("severity", F.when(F.col("doc_debt") > 0, ladder(F.col("doc_debt"), [(">=", 0.6, "high"), (">=", 0.3, "medium")], "low")))


def intent_clarity(df: DataFrame, doc: str = "doc", types: str = "types", names: str = "names") -> DataFrame:
    """.40 documentation + .35 types + .25 names; under .40 high, under .65 medium."""
    out = df.withColumn("clarity", 0.40 * F.col(doc) + 0.35 * F.col(types) + 0.25 * F.col(names))
    return out.withColumn("severity", ladder(F.col("clarity"), [("<", 0.40, "high"), ("<", 0.65, "medium")]))


def type_coverage(files: DataFrame, path: str = "path", content: str = "content", language: str = "language") -> DataFrame:
    """Share of parameters and results with types, times ten: counted for Python and TypeScript, by doc tags for
    JavaScript, Ruby and PHP, 10 where the language asks for types, 5 for others."""
    x, lang = F.col(content), F.col(language)
    sigs = F.regexp_extract_all(x, F.lit(r"\bdef\s+\w+\s*\(([^()]*)\)\s*(?:->[^:\n]+)?:"), F.lit(0))
    names = F.filter(F.flatten(F.transform(sigs, lambda s: F.split(F.regexp_extract(s, r"\(([^()]*)\)", 1), ","))), lambda p: ~F.trim(p).isin("", "self", "cls", "*", "/"))
    py = (F.size(F.filter(names, lambda p: p.contains(":"))) + F.size(F.filter(sigs, lambda s: s.contains("->")))) / F.greatest(F.size(names) + F.size(sigs), F.lit(1))
    ts_params = F.filter(F.flatten(F.transform(F.regexp_extract_all(x, F.lit(r"\bfunction\s*\w*\s*\(([^()]*)\)"), F.lit(1)), lambda s: F.split(s, ","))), lambda p: F.trim(p) != "")
    ts = F.size(F.filter(ts_params, lambda p: p.contains(":"))) / F.greatest(F.size(ts_params), F.lit(1))
    tags = F.least(F.lit(1.0), F.regexp_count(x, F.lit(r"@(?:param|returns?)\b")) / F.greatest(3 * F.regexp_count(x, F.lit(r"\b(?:function|def)\b")), F.lit(1)))
    score = F.when(lang.isin("java", "kotlin", "csharp", "go", "rust", "swift"), 10.0).when(lang == "python", F.when(F.size(sigs) == 0, 10.0).otherwise(10 * py)).when(lang == "typescript", F.when(F.size(ts_params) == 0, 10.0).otherwise(10 * ts)).when(lang.isin("javascript", "ruby", "php"), 10 * tags).otherwise(5.0)
    return files.select(path, score.alias("score"))


def generated_signs(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Four heuristics from 0 to 1 weighted .30, .25, .25, .20: comment share, long names, boilerplate, even structure; .5 or more likely."""
    x = F.col(content)
    lines = F.greatest(F.size(F.split(x, "\n", -1)), F.lit(1))
    comments = F.least(F.lit(1.0), F.regexp_count(x, F.lit(r"(?m)^\s*(?://|#|\*)")) / lines / 0.4)
    ids = identifiers(without_comments(x))
    names = F.least(F.lit(1.0), F.size(F.filter(ids, lambda v: F.length(v) > 15)) / F.greatest(F.size(ids), F.lit(1)) / 0.3)
    boiler = F.least(F.lit(1.0), F.regexp_count(x, F.lit(r"(?i)\b(?:try|catch|except|validate|handle|helper|utility)\b")) / lines / 0.2)
    even = F.least(F.lit(1.0), F.regexp_count(x, F.lit(r"(?m)^\s*$")) / lines / 0.25)
    out = files.select(path, comments.alias("comments"), names.alias("names"), boiler.alias("boilerplate"), even.alias("structure"))
    out = out.withColumn("score", 0.30 * F.col("comments") + 0.25 * F.col("names") + 0.25 * F.col("boilerplate") + 0.20 * F.col("structure"))
    return out.withColumn("likely", F.col("score") >= 0.5)


def git_score(first_added: Column, commits: Column) -> Column:
    """A large first commit with few after it."""
    return F.when((first_added > 200) & (commits <= 2), 0.7).when((first_added > 100) & (commits <= 5), 0.4).otherwise(0.2)


def readiness(dims: DataFrame, names: tuple[str, ...], weights: tuple[float, ...] = (0.20, 0.25, 0.20, 0.20, 0.15)) -> DataFrame:
    """One row: the mean of each dimension and their weighted sum."""
    m = dims.agg(*(F.avg(n).alias(n) for n in names))
    return m.withColumn("readiness", sum((F.col(n) * w for n, w in zip(names, weights, strict=True)), F.lit(0.0)))


def language_votes(tokens: Column, words: dict[str, tuple[str, ...]], margin: float = 1.5) -> Column:
    """The language whose stop words come up more than margin times as often as any other's; else unknown."""
    votes = {k: F.size(F.filter(tokens, lambda t, v=v: t.isin(*v))) for k, v in words.items()}
    out = F.lit("unknown")
    for k, n in votes.items():
        rest = F.greatest(*(m for o, m in votes.items() if o != k), F.lit(0)) if len(votes) > 1 else F.lit(0)
        out = F.when((n > 0) & (n > rest * margin), k).otherwise(out)
    return out
