"""What a path tells: language, role, module, candidate tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.tables import BOTS, EXTENSIONS, NAMES, SECURITY_IN_TESTS


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), "([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def detect_language(path: Column) -> Column:
    """By extension as written, then lower-cased, then by name; else unsupported."""
    of = F.create_map(*(F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts.split() for x in (e, lang)))
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    base = base_name(path)
    ext = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    return F.coalesce(F.try_element_at(of, ext), F.try_element_at(of, F.lower(ext)), F.try_element_at(names, F.lower(base)), F.lit("unsupported"))


def role_of(path: Column) -> Column:
    """test, controller, service, entity, util or unknown: the first that fits."""
    p = F.lower(F.translate(path, "\\", "/"))
    base = F.regexp_extract(p, "([^/]*)$", 1)
    folder = lambda names: p.rlike(f"(^|/)({names})/")
    ending = lambda names: base.rlike(f"({names})\\.[a-z0-9]+$")
    test = folder("__tests__|tests?") | base.rlike(r"\.(test|spec)\.") | base.rlike(r"_test\.go$") | base.rlike(r"test\.[a-z0-9]+$") | base.rlike("(^|[._-])test[._-]")
    return (
        F.when(test, "test")
        .when(folder("controllers?") | ending("controller|handler|router"), "controller")
        .when(folder("services?") | ending("service|manager|facade"), "service")
        .when(folder("models?|entity|entities|domain") | ending("entity|model"), "entity")
        .when(folder("utils?|helpers?|lib") | ending("utils|helper"), "util")
        .otherwise("unknown")
    )


def role_multiplier(role: Column, smell: Column) -> Column:
    # Role, finding type, factor.
    table = [("controller", "GodClass", 0.75), ("controller", "BrainMethod", 0.8), ("util", "GodClass", 0.85), ("entity", "GodClass", 1.2), ("entity", "DataClumps", 1.15), ("service", "FeatureEnvy", 1.2)]
    out = F.lit(1.0)
    for r, t, x in table:
        out = F.when((role == r) & (smell == t), x).otherwise(out)
    return out


def test_multiplier(role: Column, smell: Column, description: Column) -> Column:
    """Less weight for security findings in tests or in string literals."""
    return F.when(~smell.isin(*SECURITY_IN_TESTS), 1.0).when(role == "test", 0.4).when(description.rlike("(?i)string literal"), 0.5).otherwise(1.0)


def churn_multiplier(rate: Column) -> Column:
    return F.when(rate >= 80, 1.5).when(rate >= 40, 1.2).otherwise(1.0)


def is_bot(author: Column, email: Column) -> Column:
    """A [bot] suffix, an automated mail domain, or one of the known names."""
    named = F.lit(False)
    for x in BOTS:
        named = named | F.lower(author).contains(x)
    return F.coalesce(author.endswith("[bot]") | F.lower(email).contains("noreply.github.com") | named, F.lit(False))


def candidate_tests(path: Column) -> Column:
    """Seven usual places of a source file's tests, paths being relative to the project."""
    name, folder = base_name(path), dir_name(path)
    base, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    at = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    in_src = F.regexp_extract(path, "^(.*?)(?:^|/)src/(.*)$", 2)
    package = F.regexp_extract(path, "^(.*?)(?:^|/)src/", 1)
    return F.array(
        *(at(folder, "/", base, kind, e) for e in (ext, ".ts") for kind in (".test", ".spec")),
        at("tests/", F.regexp_replace(path, r"\.tsx?$", ""), ".test.ts"),
        at("__tests__/", base, ".test.ts"),
        F.when(in_src != "", at(F.when(package != "", F.concat(package, F.lit("/"))).otherwise(""), "tests/", F.regexp_replace(in_src, r"\.([^./]*)$", ".test.$1"))).otherwise(at(folder, "/tests/", base, ".test", ext)),
    )
