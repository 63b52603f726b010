"""Queries of the source detectors over code with known findings: each part is a file that holds one of the snippets.

The tables hold no code, so a detector would find nothing in them. The DuckDB side doesn't repeat patterns: it lists, for
each snippet, the findings that it must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import codesmells, readiness, textsmells
from tidemark.plans.queries import query, table

#: Language and lines of each snippet; a file begins with one line of its own, so a snippet's first line is line 2.
SNIPPETS = [
    ("typescript", "// TODO: split this"),
    ("python", "# FIXME the AI wrote this, not sure why"),
    ("typescript", "db.query('select * from t where id = ' + id)"),
    ("typescript", "box.innerHTML = value"),
    ("typescript", "fs.readFile('/data/' + name)"),
    ("typescript", "const line = 'ls ' + folder"),
    ("python", "\nrow = pickle.loads(blob)"),
    ("python", "mark = hashlib.md5(blob)"),
    ("typescript", "try { go() } catch (e) {}"),
    ("python", "try:\n    go()\nexcept ValueError:\n    pass"),
    ("typescript", "async function f(a) {\n  if (a) { if (b) { c() } }\n}"),
    ("typescript", "const v: any = one"),
    ("typescript", "const r = fetch(req.query.url)"),
    ("java", 'MessageDigest.getInstance("MD5")'),
    ("typescript", "const p = new Promise((resolve) => later(resolve))"),
    ("typescript", "const apiToken = 'a8F3kQ9zLm2XpV7c'"),
    ("typescript", "async function f() {\n  await one()\n}\nasync function g() {\n}"),
    ("ruby", "Marshal.load(blob)"),
    ("typescript", "total = rate * 42 + 7 - 1"),
    ("typescript", "MAX_SIZE = 42"),
    ("typescript", "function f() {\n  return await g()\n}"),
    ("java", "try { go(); } catch (Exception e) { log(e); }"),
    ("typescript", "items.find(x => x.id)"),
    ("python", "value = one"),
    ("typescript", "client.chat.completions.create({ model: 'gpt-4o', messages: m })"),
    ("typescript", "const q = \"tokens are '12345678901234567890' here\""),
    ("go", "h := md5.New()"),
    ("php", "$x = unserialize($blob);"),
    ("typescript", "do_work(path.join(root, req.query.file))"),
]


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda i: F.get(F.array(*(F.lit(x[i]) for x in SNIPPETS)), (F.col("p_partkey") % len(SNIPPETS)).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("path"), of(0).alias("language"), F.concat(F.lit("let whole\n"), of(1), F.lit("\n")).alias("content"))


def expected(*rows: tuple[int, str, str, int]) -> str:
    """rows: snippet, type, severity, line."""
    listed = ", ".join(f"({k}, '{kind}', '{severity}', {line})" for k, kind, severity, line in rows) or "(-1, '', '', 0)"
    return f"select p_partkey path, type, severity, line from part join (values {listed}) t(k, type, severity, line) on p_partkey % {len(SNIPPETS)} = k"


def detector(name: str, *rows: tuple[int, str, str, int]):
    """Registers a function from files (path, language, content) to findings."""

    def add(f):
        query(name, expected(*rows))(lambda spark, sf: f(code_files(spark, sf)).select("path", "type", "severity", "line"))
        return f

    return add


@detector("DET20_satd_text", (0, "SATD", "low", 2), (1, "SATD", "low", 2))
def _satd(files):
    return textsmells.satd(files)


@detector("DET22_ai_satd", (1, "AiAttributedSATD", "medium", 2))
def _ai_satd(files):
    return textsmells.ai_satd(files)


@detector("DET34_injections", (2, "SqlInjectionRisk", "critical", 2), (3, "XssRisk", "high", 2), (4, "PathTraversalRisk", "high", 2), (5, "CommandInjectionRisk", "medium", 2), (28, "PathTraversalRisk", "high", 2))
def _injections(files):
    return textsmells.injections(files)


@detector("DET31_unsafe_deserialization", (6, "UnsafeDeserialization", "critical", 3), (17, "UnsafeDeserialization", "critical", 2), (27, "UnsafeDeserialization", "critical", 2))
def _unsafe(files):
    return textsmells.unsafe_deserialization(files)


@detector("DET33_weak_cryptography", (7, "CryptographicMisuseRisk", "critical", 2), (13, "CryptographicMisuseRisk", "critical", 2), (26, "CryptographicMisuseRisk", "critical", 2))
def _weak(files):
    return textsmells.weak_cryptography(files)


@detector("DET32_ssrf", (12, "SsrfRisk", "high", 2))
def _ssrf(files):
    return textsmells.ssrf(files)


@detector("DET29_exceptions", (8, "ExceptionHandlingAntiPattern", "medium", 2), (9, "ExceptionHandlingAntiPattern", "medium", 4), (21, "ExceptionHandlingAntiPattern", "low", 2))
def _exceptions(files):
    return codesmells.exceptions(files)


@detector("DET30_asynchronous", (10, "AsyncAntiPattern", "medium", 2), (14, "AsyncAntiPattern", "low", 2), (16, "AsyncAntiPattern", "medium", 5), (20, "AsyncAntiPattern", "low", 3))
def _async(files):
    return codesmells.asynchronous(files)


@detector("DET23_type_escapes", (11, "TypeSafetyEscape", "medium", 2))
def _escapes(files):
    return codesmells.type_escapes(files)


@detector("DET35_secrets_own_design", (15, "HardcodedCredential", "critical", 2))
def _secrets(files):
    return textsmells.secrets(files)


@detector("DET19_magic_numbers_code", (18, "MagicNumber", "low", 2), (18, "MagicNumber", "low", 2), (25, "MagicNumber", "low", 2))
def _magic(files):
    return textsmells.magic_numbers(files)


@detector(
    "DET39_model_calls",
    (24, "LlmUnboundedCall", "medium", 2), (24, "LlmUnpinnedModel", "medium", 2), (24, "LlmNoSystemMessage", "medium", 2),
    (24, "LlmNoStructuredOutput", "medium", 2), (24, "LlmUnsetTemperature", "medium", 2),
)
def _calls(files):
    return codesmells.model_calls(files)


@query("DET44_naming", "with n as (select p_partkey path, p_partkey % 5 k from part) select path, case when k % 2 = 1 then 2 else 1 end single, case when k >= 2 then 1 else 0 end cryptic, case when k = 4 then 1 else 0 end mixed, floor((10 - 0.5 * (case when k % 2 = 1 then 2 else 1 end) - 0.3 * (case when k >= 2 then 1 else 0 end) - 1.5 * (case when k = 4 then 1 else 0 end)) * 10 + 0.5)::double / 10 score from n")
def det_naming(spark, sf):
    k = F.col("p_partkey") % 5
    lines = F.concat(F.lit("const i = id; let x = total; // q w\nconst text = 'u v';\n"), F.when(k % 2 == 1, "let y = 1\n").otherwise("for (let j = 0; ;) {}\n"), F.when(k >= 2, "let zz = 1\n").otherwise("let db = 1\n"), F.when(k == 4, "let aName = a_name\n").otherwise("let bName = 1\n"))
    return readiness.naming_clarity(table(spark, sf, "part").select(F.col("p_partkey").alias("path"), lines.alias("content")))
