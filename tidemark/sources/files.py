"""Source files, JSON stores and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.paths import detect_language

# Folders and endings that a project walk leaves out.
SKIPPED_FOLDERS = ("node_modules", "dist", "build", "out", "coverage", "vendor", "target", "__pycache__", "venv", "env", "bower_components", "tmp", "logs")
SKIPPED_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip", ".gz", ".lock", ".map")


def project_files(spark: SparkSession, path: str, most: int = 500_000) -> DataFrame:
    """(path, language, content) of a tree, without large files, skipped folders, dot folders and binary endings."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most)
    below = F.element_at(F.split("path", r"\Q" + path.rstrip("/").split(":", 1)[-1] + r"\E", 2), -1)
    bad = below.rlike("/(" + "|".join(SKIPPED_FOLDERS) + r")/|/\.[^/]+/") | F.lower("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in SKIPPED_ENDINGS) + ")$")
    return f.where(~bad).select("path", detect_language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"))


def glob_pattern(glob: str) -> str:
    """A glob with **, * and ? as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], "\\" + glob[i] if not glob[i].isalnum() else glob[i])
            i += 1
    return f"^{out}$"


def discover(files: DataFrame, include: tuple[str, ...] = ("**/*.ts", "**/*.tsx"), exclude: tuple[str, ...] = ("**/node_modules/**", "**/dist/**", "**/tests/**", "**/*.d.ts"), path: str = "path") -> DataFrame:
    keep = F.col(path).rlike("|".join(map(glob_pattern, include)))
    return files.where(keep & ~F.col(path).rlike("|".join(map(glob_pattern, exclude)))) if exclude else files.where(keep)


def one_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.lit(path).alias("path"), detect_language(F.lit(path)).alias("language"), F.col("value").alias("content"))


IMPORTS = {
    "typescript": r"""(?:import|export)\s[^'"]*?from\s*['"](\.[^'"]+)['"]|require\(\s*['"](\.[^'"]+)['"]\s*\)""",
    "python": r"(?m)^\s*from\s+(\.[\w.]*)\s+import",
    "ruby": r"""require_relative\s+['"]([^'"]+)['"]""",
    "php": r"""(?:require|include)(?:_once)?\s*\(?\s*['"](\.[^'"]+)['"]""",
    "c": r"""#include\s+"([^"]+)\"""",
    "rust": r"(?m)^\s*mod\s+(\w+)\s*;",
    "go": r"""(?m)^\s*(?:import\s+)?"(\.[^"]+)\"""",
}


def imports(files: DataFrame, path: str = "path", content: str = "content", language: str = "language") -> DataFrame:
    """(src, dst): relative imports with their paths joined and made plain; .ts is added where TypeScript leaves it out."""
    found = F.array().cast("array<string>")
    alias = {"javascript": "typescript", "cpp": "c"}
    for lang, pattern in IMPORTS.items():
        names = [lang, *(k for k, v in alias.items() if v == lang)]
        both = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
        if lang == "typescript":
            both = F.concat(both, F.regexp_extract_all(content, F.lit(pattern), F.lit(2)))
        found = F.when(F.col(language).isin(*names), both).otherwise(found)
    rows = files.select(F.col(path).alias("src"), F.col(language).alias("_l"), F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("_s"))
    folder = F.when(F.col("src").contains("/"), F.regexp_replace("src", "/[^/]*$", "")).otherwise("")
    steps = F.filter(F.split(F.concat_ws("/", folder, F.col("_s")), "/"), lambda x: ~x.isin("", "."))
    # A step up takes the last folder away; one step after another, inside the row.
    plain = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    dst = F.array_join(plain, "/")
    dst = F.when(F.col("_l").isin("typescript", "javascript") & ~F.regexp_extract(dst, "([^/]*)$", 1).contains("."), F.concat(dst, F.lit(".ts"))).otherwise(dst)
    return rows.select("src", dst.alias("dst")).where("src <> dst").distinct()


GOAL = "file_path string, goal_type string, target_score double, status string, created_at timestamp, updated_at timestamp, expires_at timestamp, note string, current_score double, previous_score double, set_by string"


def json_store(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON rows with a declared schema; a missing path is an empty store."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def goals(store: DataFrame, prefix: str = "") -> DataFrame:
    return store.where(F.lower("file_path").startswith(prefix.lower()))


def upsert(store: DataFrame, new: DataFrame, key: str = "file_path", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """new rows in place of the store's with the same key; columns in keep stay as they were."""
    old = store.select(key, *(F.col(c).alias(f"_{c}") for c in keep))
    fresh = new.join(old, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in store.columns))
    return store.join(new.select(key), key, "left_anti").unionByName(fresh)


def remove(store: DataFrame, keys: DataFrame, key: str = "file_path") -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def calibration(defaults: dict, path: str | None) -> dict:
    """Defaults with a JSON file's values over them; a missing or broken file leaves the defaults."""
    import json

    if path is None:
        return dict(defaults)
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return dict(defaults)
    return {**defaults, **{k: v for k, v in got.items() if k in defaults}}


def benchmark_records(spark: SparkSession) -> DataFrame:
    """Ten made-up labelled records, half of them with defects."""
    bad = "def f(a, b, c, d, e):\n" + "".join(f"    if a > {i}:\n        b += {i}\n" for i in range(12)) + "    return b\n"
    good = "def add(a, b):\n    return a + b\n"
    return spark.createDataFrame([(f"r{i}", "python", bad if i < 5 else good, i < 5, int(i < 5)) for i in range(10)], "path string, language string, content string, has_bug boolean, bug_count int")
