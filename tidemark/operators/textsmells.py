"""Findings from text by patterns: debt notes, magic numbers, weak cryptography, unsafe sinks, injection.

Line detectors work on arrays of lines inside the row: no explode before a match, no shuffle. Every detector returns
(path, type, severity, function_name, line, metric_value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java counts any letter as part of a word at \b, though not for \w; the patterns, as JavaScript and RE2, mean ASCII.
WORD_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def ascii_words(pattern: str) -> str:
    return pattern.replace(r"\b", WORD_EDGE)


# The patterns below decide what is found.
SATD_LINE = r"(?i)(?:(?:^|\s)\*|//|#|--|;)\s*(TODO|FIXME|HACK|XXX|BUG|KLUDGE)\b(.{0,80})"
SATD_TIERS = [(r"(?i)\b(HACK|XXX|BUG)\b", "critical"), (r"(?i)\b(FIXME|BROKEN)\b", "high"), (r"(?i)\b(TODO|TEMP|WORKAROUND|KLUDGE)\b", "medium"), (r"(?i)\b(REFACTOR)\b", "low")]
AI_TERM, AI_DEBT, AI_DOUBT = r"(?i)\b(LLM|AI|GPT|ChatGPT|Copilot|Gemini|Claude)\b", r"(?i)\b(TODO|FIXME|HACK|XXX)\b", r"(?i)\b(no clue|not sure|don't understand|unclear why|unsure)\b"
COMMENT_LINE = r"//|#\s|--\s|;\s|\*\s|/\*|^\s*(\*|//|#|--|;)"
MAGIC = r"(?<![.\w])(-?)(\b[2-9]\b|\b[1-9]\d+\b)(?!\.\d)"
CONSTANT_LINE = r"^[A-Z_][A-Z0-9_]*(?:\s*:\s*[\w<>\[\]|,\s]+)?\s*=(?!=)"
TYPED_CONSTANT = r"\b(?:final|const)\b[^=\n]*\b[A-Z_][A-Z0-9_]+\b[^=\n]*=(?!=)"
SKIPPED_STARTS = ("import ", "using ", "package ", "require(", "from ")
SKIPPED_ENDS = (".json", ".yml", ".yaml", ".xml", ".toml", ".ini", ".cfg")
DESERIALIZERS = [
    (("python",), r"\bpickle\.(?:load|loads|Unpickler)\s*\("),
    (("python",), r"\byaml\.(?:load|unsafe_load)\s*\((?![^\n]*SafeLoader)"),
    (("java", "kotlin", "scala"), r"\bnew\s+ObjectInputStream\s*\("),
    (("php",), r"\bunserialize\s*\("),
    (("ruby",), r"\bMarshal\.(?:load|restore)\s*\("),
    (("typescript", "javascript"), r"\bvm\.runInNewContext\s*\("),
    (("typescript", "javascript"), r"\beval\s*\(\s*(?!['\"`\s])"),
]
HTTP_SINK = r"\b(?:fetch|axios\.(?:get|post|put|delete|patch|request)|requests\.(?:get|post|put|delete|patch)|http\.(?:get|request)|urllib\.request\.urlopen)\s*\("
REQUEST_DATA = r"\breq\.(?:query|params|body|url)\b|\brequest\.(?:GET|POST|args|form|data|url)\b|\bc\.Query\s*\(|\bc\.Param\s*\(|\br\.URL\.Query\s*\(|\br\.FormValue\s*\("
WEAK_HASHES = [
    (("typescript", "javascript"), r"(?i)\bcreateHash\s*\(\s*['\"](?:md5|sha1|sha-1|des|rc4|3des)['\"]\s*\)"),
    (("python",), r"\bhashlib\.(?:md5|sha1)\s*\("),
    (("java", "kotlin", "scala"), r"\bMessageDigest\.getInstance\s*\(\s*[\"'](?:MD5|SHA-1|SHA1)[\"']\s*\)"),
    (("ruby",), r"\bDigest::(?:MD5|SHA1)\b"),
    (("php",), r"(?i)\bhash\s*\(\s*'(?:md5|sha1)'"),
    (("go",), r"\b(?:md5\.New\s*\(\)|sha1\.New\s*\(\)|md5\.Sum\s*\(|sha1\.Sum\s*\()"),
]
WEAK_RANDOM = [(("typescript", "javascript"), r"\bMath\.random\s*\(\s*\)"), (("python",), r"\brandom\.random\s*\(\s*\)")]
SECRET_NAME = r"(?i)\b(?:token|secret|session|nonce|key|password|passwd|apikey|api_key|csrf|salt)\b"
SHORT_RSA = r"(?:generate_private_key|RSA\.generate|generateKeyPair\s*\(\s*['\"]rsa['\"])\s*\([^)]*(?:1024|512)"
FIXED_IV = r"(?:const|let|var|val)\s+(?:iv|IV|nonce|NONCE)\s*=\s*(?:Buffer\.from\s*\(|b'|bytes\.fromhex\s*\()\s*['\"][0-9a-fA-F]+['\"]"
INJECTIONS = [
    ("SqlInjectionRisk", "critical", r"(?:db|pool|connection|knex|sequelize|client)\.(?:query|raw|execute)\s*\(\s*(?:[\"'`][^\"'`]*[\"'`]\s*\+|`[^`]*\$\{)"),
    ("XssRisk", "high", r"(?i)res\s*\.\s*(?:send|write)\s*\(\s*(?:[\"'`][^\"'`]*[\"'`]\s*\+|\+?\s*(?:req|[a-z_$][a-z0-9_$]*)\s*\.)"),
    ("XssRisk", "high", r"\binnerHTML\s*=(?!\s*[\"'`])"),
    ("CommandInjectionRisk", "medium", r"(?i)(?:const|let|var)\s+[a-z_$][a-z0-9_$]*\s*=\s*[\"'`][^\"'`]*[\"'`]\s*\+\s*[a-z_$][a-z0-9_$]*"),
    ("CommandInjectionRisk", "critical", r"(?:spawnSync|spawnFileSync|fork)\s*\(\s*['\"`][^'\"`]*['\"`]\s*,\s*\[[^\]]*\$\{"),
    ("PathTraversalRisk", "high", r"(?i)fs\s*\.\s*(?:readFile|writeFile|readFileSync|writeFileSync|appendFile|appendFileSync)\s*\(\s*(?:[\"'`][^\"'`]*[\"'`]\s*\+|\+?\s*[a-z_$][a-z0-9_$]*\s*\+)"),
    ("PathTraversalRisk", "high", r"path\s*\.\s*(?:join|resolve)\s*\([^)]*req\s*\.\s*(?:params|query|body)"),
]
STATIC_SCORE = {"critical": 0.9, "high": 0.75, "medium": 0.55}


def _lines(content: str) -> Column:
    return F.split(content, "\n", -1)


def _exploded(files: DataFrame, hits: Column, path: str) -> DataFrame:
    """A row for each hit. A plain explode would be given a filter on the size of hits, which evaluates them twice."""
    return files.select(F.col(path).alias("path"), F.explode_outer(hits).alias("h")).where("h is not null")


def _found(files: DataFrame, kind: str, hits: Column, path: str) -> DataFrame:
    """hits: array of struct(line, severity)."""
    rows = _exploded(files, hits, path)
    return rows.select("path", F.lit(kind).alias("type"), F.col("h.severity").alias("severity"), F.lit(None).cast("string").alias("function_name"), F.col("h.line").cast("int").alias("line"), F.lit(None).cast("double").alias("metric_value"))


def _hit(line: Column, severity: str | Column) -> Column:
    return F.struct(line.alias("line"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))


def line_hits(pattern: str, severity, content: str = "content") -> Column:
    """A hit for each line that matches; severity is a name or a function of the line."""
    of = severity if callable(severity) else lambda x: F.lit(severity)
    pattern = ascii_words(pattern)
    tagged = F.transform(_lines(content), lambda x, i: _hit(i + 1, F.when(x.rlike(pattern), of(x))))
    return F.filter(tagged, lambda h: h["severity"].isNotNull())


def by_line(files: DataFrame, kind: str, pattern: str, severity, path: str = "path", content: str = "content") -> DataFrame:
    """One finding for each line that matches; severity is a name or a function of the line."""
    return _found(files.where(F.col(content).rlike("(?m)" + ascii_words(pattern))), kind, line_hits(pattern, severity, content), path)


def in_one_scan(files: DataFrame, hits: dict[str, Column], path: str = "path") -> DataFrame:
    """The findings of several detectors, given as arrays of hits by type, from one pass over the files."""
    none = F.array().cast("array<struct<type:string,line:int,severity:string>>")
    named = lambda kind, found: F.transform(found, lambda h: F.struct(F.lit(kind).alias("type"), h["line"].cast("int").alias("line"), h["severity"].alias("severity")))
    every = F.concat(*(F.coalesce(named(kind, found), none) for kind, found in hits.items()))
    rows = _exploded(files, every, path)
    return rows.select("path", "h.type", "h.severity", F.lit(None).cast("string").alias("function_name"), "h.line", F.lit(None).cast("double").alias("metric_value"))


def by_match(files: DataFrame, kind: str, pattern: str, severity: str, path: str = "path", content: str = "content", near: str | None = None, reach: int = 3) -> DataFrame:
    """One finding for each match in the whole text, at its line; with near, only if a line within reach matches that.

    The text is cut at the matches; a match's line is one more than the line breaks before it.
    """
    pattern, near = ascii_words(pattern), near and ascii_words(near)
    parts = F.split(content, pattern, -1)
    texts = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # One pass over part and match, match by match, with the line breaks so far.
    state = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("lines"))
    step = lambda s, x: F.struct((s["line"] + breaks(x["part"]) + breaks(x["text"])).cast("int").alias("line"), F.concat(s["lines"], F.array((s["line"] + breaks(x["part"])).cast("int"))).alias("lines"))
    pairs = F.transform(texts, lambda x, i: F.struct(F.get(parts, i).alias("part"), x.alias("text")))
    hits = F.transform(F.aggregate(pairs, state, step, lambda s: s["lines"]), lambda x: _hit(x, severity))
    if near:
        lines = _lines(content)
        around = lambda h: F.array_join(F.slice(lines, F.greatest(h["line"] - reach, F.lit(1)), F.least(h["line"], F.lit(reach + 1)) + reach), "\n")
        hits = F.filter(hits, lambda h: around(h).rlike(near))
    return _found(files.where(F.col(content).rlike(pattern)), kind, hits, path)


def satd(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return by_line(files, "SATD", SATD_LINE, "low", path, content)


def satd_tiers(comments: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Severity of comments by the first tier that matches."""
    tier = F.lit(None).cast("string")
    for pattern, severity in reversed(SATD_TIERS):
        tier = F.when(F.col(content).rlike(ascii_words(pattern)), severity).otherwise(tier)
    return comments.withColumn("severity", tier).where("severity is not null")


def ai_satd(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Comment lines with both an assistant's name and a debt mark; medium if they show doubt."""
    both = lambda x: x.rlike(ascii_words(AI_TERM)) & x.rlike(ascii_words(AI_DEBT)) & x.rlike(COMMENT_LINE)
    tagged = F.transform(_lines(content), lambda x, i: F.struct((i + 1).alias("line"), F.when(both(x), F.when(x.rlike(ascii_words(AI_DOUBT)), "medium").otherwise("low")).alias("severity")))
    return _found(files.where(F.col(content).rlike(ascii_words(AI_DEBT)) & F.col(content).rlike(ascii_words(AI_TERM))), "AiAttributedSATD", F.filter(tagged, lambda h: h["severity"].isNotNull()), path)


def _holds_code(path: str) -> Column:
    fine = F.lit(True)
    for end in SKIPPED_ENDS:
        fine = fine & ~F.col(path).cast("string").endswith(end)
    return fine


def magic_hits(content: str = "content") -> Column:
    trimmed = F.transform(_lines(content), lambda x: F.trim(x))  # F.trim itself would take the index as what to trim

    def counted(x: Column) -> Column:
        skip = (x == "") | x.startswith("//") | x.startswith("#") | x.startswith("*") | x.rlike(CONSTANT_LINE) | x.rlike(ascii_words(TYPED_CONSTANT))
        for start in SKIPPED_STARTS:
            skip = skip | x.startswith(start)
        return F.when(skip, 0).otherwise(F.regexp_count(x, F.lit(ascii_words(MAGIC))))

    return F.flatten(F.transform(trimmed, lambda x, i: F.array_repeat(_hit(i + 1, "low"), counted(x))))


def magic_numbers(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One finding for each number but 0, 1 and -1, outside constants, comments, imports and data files."""
    return _found(files.where(_holds_code(path)), "MagicNumber", magic_hits(content), path)


def large_files(files: DataFrame, path: str = "path", content: str = "content", most: int = 500) -> DataFrame:
    n = F.size(_lines(content))
    rows = files.select(F.col(path).alias("path"), n.alias("_n")).where(F.col("_n") > most)
    return rows.select("path", F.lit("LargeFile").alias("type"), F.lit("medium").alias("severity"), F.lit(None).cast("string").alias("function_name"), F.lit(1).alias("line"), F.col("_n").cast("double").alias("metric_value"))


def _gated(files: DataFrame, kind: str, table: list, severity: str, path: str, content: str, language: str, **more) -> list[DataFrame]:
    return [by_match(files.where(F.col(language).isin(*langs)), kind, p, severity, path, content, **more) for langs, p in table]


def unsafe_deserialization(files: DataFrame, path: str = "path", content: str = "content", language: str = "language") -> DataFrame:
    return union(_gated(files, "UnsafeDeserialization", DESERIALIZERS, "critical", path, content, language))


def ssrf(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return by_match(files, "SsrfRisk", HTTP_SINK, "high", path, content, near=REQUEST_DATA, reach=3)


def weak_cryptography(files: DataFrame, path: str = "path", content: str = "content", language: str = "language") -> DataFrame:
    kind = "CryptographicMisuseRisk"
    out = _gated(files, kind, WEAK_HASHES, "critical", path, content, language) + _gated(files, kind, WEAK_RANDOM, "high", path, content, language, near=SECRET_NAME, reach=5)
    return union([*out, by_match(files, kind, SHORT_RSA, "critical", path, content), by_match(files, kind, FIXED_IV, "critical", path, content)])


def injections(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return union([by_match(files, kind, pattern, severity, path, content) for kind, severity, pattern in INJECTIONS])


SECRET = r"(?i)\b[\w.-]*(?:token|secret|passw(?:or)?d|api_?key)[\w.-]*\s*[:=]\s*[\"']([^\"'\s]{16,})[\"']"


def secret_hits(content: str = "content", least: float = 3.0) -> Column:
    value = lambda x: F.regexp_extract(x, ascii_words(SECRET), 1)

    def entropy(v: Column) -> Column:
        signs = F.split(v, "")
        share = lambda c: F.size(F.filter(signs, lambda x: x == c)) / F.length(v)
        return F.aggregate(F.array_distinct(F.filter(signs, lambda x: x != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))

    tagged = F.transform(_lines(content), lambda x, i: _hit(i + 1, F.when((value(x) != "") & (entropy(value(x)) >= least), F.lit("critical"))))
    # Most texts have none, and a text without one has no line with one.
    return F.when(F.col(content).rlike(ascii_words(SECRET)), F.filter(tagged, lambda h: h["severity"].isNotNull()))


def secrets(files: DataFrame, path: str = "path", content: str = "content", least: float = 3.0) -> DataFrame:
    """Values of 16 signs or more given to a name that sounds secret, with an entropy per sign of at least least. Own design."""
    return _found(files.where(F.col(content).rlike(ascii_words(SECRET))), "HardcodedCredential", secret_hits(content, least), path)


def text_findings(files: DataFrame, path: str = "path", content: str = "content", most: int = 500) -> DataFrame:
    """Debt notes, magic numbers, large files and secrets, from one pass."""
    large = F.when(F.size(_lines(content)) > most, F.array(_hit(F.lit(1), "medium")))
    return in_one_scan(files, {"SATD": F.when(F.col(content).rlike("(?m)" + ascii_words(SATD_LINE)), line_hits(SATD_LINE, "low", content)), "MagicNumber": F.when(_holds_code(path), magic_hits(content)), "LargeFile": large, "HardcodedCredential": secret_hits(content)}, path)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def combined_score(static: Column, assessed: Column) -> Column:
    return 0.4 * static + 0.6 * assessed


def disagreement(static: Column, assessed: Column) -> Column:
    gap = F.abs(static - assessed)
    return F.when(gap > 0.5, "high").when(gap > 0.25, "medium").otherwise("none")


def security_risk(findings: DataFrame, assessed: float = 0.5, path: str = "path") -> DataFrame:
    """min(10, 10 * mean combined score) of each file; the assessment is a constant until a model gives one."""
    static = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in STATIC_SCORE.items() for x in p)), F.col("severity")), F.lit(0.3))
    return findings.groupBy(path).agg(F.count("*").alias("findings"), F.least(F.lit(10.0), 10 * F.avg(combined_score(static, F.lit(assessed)))).alias("risk"))


def scan_cost(findings: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """400 tokens in and 150 out for each finding, prices a million."""
    return findings.agg(F.count("*").alias("findings")).withColumns({"tokens_in": F.col("findings") * 400, "tokens_out": F.col("findings") * 150}).withColumn("cost", (F.col("tokens_in") * input_price + F.col("tokens_out") * output_price) / 1e6)
