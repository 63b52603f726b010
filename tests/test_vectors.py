"""Closed-form results and small texts, a positive case and a near miss each."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric, paths
from tidemark.operators import clones, codesmells, coupling, functions, graph, history, packages, plugins, readiness, rules, scoring, stats, textsmells
from tidemark.sources import files, gitlog, labels, sinks
from tidemark.streaming import goals


def value(df, col=None):
    r = df.first()
    return r[col] if col else r[0]


def smells(spark, *kinds):
    return spark.createDataFrame([("a", k) for k in kinds], "path string, type string")


def texts(spark, *rows):
    return spark.createDataFrame([(f"f{i}", lang, x) for i, (lang, x) in enumerate(rows)], "path string, language string, content string")


@pytest.mark.parametrize("kinds, want", [((), 10.0), (("ComplexMethod",), 8.5), (("DeepNesting",), 8.8), (("BumpyRoad",), 9.2), (("LargeMethod",), 9.4), (("ComplexConditional",), 9.5), (("LargeFile",), 9.7)])
def test_score(spark, kinds, want):
    f = spark.createDataFrame([("a",)], "path string")
    assert value(scoring.score(f, smells(spark, *kinds)), "score") == pytest.approx(want)


def test_raw_score(spark):
    f = spark.createDataFrame([("a",)], "path string")
    s = smells(spark, "MagicNumber", "MagicNumber", "DeepNesting", "LongParameterList", "CognitiveComplexity", "BrainMethod")
    assert value(scoring.score(f, s), "raw") == pytest.approx(5.834314575050762)


@pytest.mark.parametrize("counts, want", [({"a": 10}, 0.0), ({"a": 5, "b": 5}, 1.0), ({"a": 7, "b": 3}, 0.8812908992306927)])
def test_entropy(spark, counts, want):
    rows = [("p", a) for a, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "path string, author string")
    assert value(history.entropy(history.commit_shares(df)), "entropy") == pytest.approx(want)


@pytest.mark.parametrize("shares, want", [([0.8, 0.2], 1), ([0.35, 0.30, 0.35], 2)])
def test_bus_factor(spark, shares, want):
    df = spark.createDataFrame([("p", str(i), s) for i, s in enumerate(shares)], "path string, author string, share double")
    assert value(history.bus_factor_estimate(df), "bus_factor") == want


def test_trend(spark):
    df = spark.createDataFrame([("one", 1, 5.0), *[("flat", i, 2.0) for i in range(4)], *[("up", i, 2.0 * i) for i in range(5)]], "g string, x int, y double")
    got = {r["g"]: r["slope"] for r in history.trend(df, "g", "x", "y").collect()}
    assert got == {"one": 0.0, "flat": 0.0, "up": pytest.approx(2.0)}


def test_sample_points():
    assert history.sample_points(3, 5) == [0, 1, 2] and history.sample_points(100, 5) == [0, 25, 50, 74, 99] and history.sample_points(9, 1) == [0]


def test_calibration_error(spark):
    clean = spark.createDataFrame([(10.0, 1)] * 20, "s double, l int")
    assert value(scoring.expected_calibration_error(scoring.calibration_error(clean, "s", "l"))) == pytest.approx(0.0)
    off = spark.createDataFrame([(9.6, 1)] * 10, "s double, l int")
    assert value(scoring.expected_calibration_error(scoring.calibration_error(off, "s", "l"))) == pytest.approx(0.04)


CASE1 = ([0.1, 0.2, 0.15, 0.35, 0.25, 0.4, 0.3, 0.45, 0.5, 0.22, 0.55, 0.6, 0.4, 0.7, 0.65, 0.5, 0.8, 0.75, 0.6, 0.9], [0.3, 0.25, 0.4, 0.5, 0.35, 0.45, 0.55, 0.3, 0.6, 0.5, 0.45, 0.5, 0.35, 0.55, 0.6, 0.4, 0.65, 0.5, 0.55, 0.7], [0] * 10 + [1] * 10)
CASE3 = ([2.0, 2, 3, 3, 4, 1, 3, 4, 4, 5, 5, 5], [3.0, 2, 2, 4, 3, 3, 2, 4, 3, 4, 5, 4], [0] * 6 + [1] * 6)


@pytest.mark.parametrize("case, want", [(CASE1, (0.97, 0.74, 2.3038429434, 0.0212314615)), (CASE3, (0.9166666667, 0.75, 1.3912166873, 0.1641597285))])
def test_delong(spark, case, want):
    a, b, lab = case
    df = spark.createDataFrame(list(zip(map(float, a), map(float, b), lab, strict=True)), "a double, b double, l int")
    r = stats.delong(df, "a", "b", "l").first()
    assert (r.auc_a, r.auc_b, r.z) == pytest.approx(want[:3]) and r.p == pytest.approx(want[3], abs=1e-5)
    assert value(stats.auroc(df, "a", "l"), "auroc") == pytest.approx(1 - want[0])


def test_normal_cdf(spark):
    r = spark.range(1).select(numeric.normal_cdf(F.lit(1.96)).alias("a"), numeric.normal_cdf(F.lit(1.96), legacy=True).alias("b"), numeric.normal_cdf(F.lit(-1.0)).alias("c")).first()
    assert r.a == pytest.approx(0.975, abs=1e-4) and 2 * (1 - r.b) == pytest.approx(0.0056, abs=1e-3) or r.b != r.a
    assert r.c == pytest.approx(0.1587, abs=1e-4)


def test_rounding(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (8.35,), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.js_to_fixed(2)("x")).collect()] == [1.0, 2.67, 8.35, None]
    assert [r[0] for r in spark.createDataFrame([(-2.5,), (2.5,)], "x double").select(numeric.js_round(F.col("x"))).collect()] == [-2, 3]


def test_correlation_without_variance(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert value(stats.pearson_correlation(df, "x", "y")) == 0.0 and value(stats.spearman_correlation(df, "x", "y")) == 0.0


def test_bootstrap_holds_the_estimate(spark):
    df = spark.createDataFrame([(float(i % 17), int(i % 17 < 8 + i % 5)) for i in range(200)], "s double, l int")
    r, a = stats.bootstrap_auroc(df, "s", "l", 200).first(), value(stats.auroc(df, "s", "l"), "auroc")
    assert r.low <= a <= r.high


GRAPH = [("a", "b"), ("a", "c"), ("b", "c"), ("d", "a"), ("e", "d"), ("e", "c")]


def test_graph(spark):
    e = spark.createDataFrame(GRAPH, "src string, dst string")
    assert {r.node: r.fan_in for r in graph.degrees(e).collect()}["c"] == 3
    assert {r.node: r.cost for r in graph.propagation_cost(e).collect()}["c"] == pytest.approx(0.8)
    two = spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    assert [(r.size, r.members) for r in graph.cycles(graph.strong_components(two)).collect()] == [(2, ["x", "y"])]


def test_paths(spark):
    rows = [("a/b.ts", "typescript", "unknown"), ("x/Dockerfile", "dockerfile", "unknown"), ("s.R", "r", "unknown"), ("src/tests/a.py", "python", "test"), ("app/controllers/u.rb", "ruby", "controller"), ("a/userService.java", "java", "service"), ("lib/z.unknown", "unsupported", "util")]
    df = spark.createDataFrame([(p,) for p, _, _ in rows], "p string").select("p", paths.detect_language(F.col("p")).alias("l"), paths.role_of(F.col("p")).alias("r"))
    assert {tuple(r) for r in df.collect()} == set(rows)


def test_bots_and_tests(spark):
    df = spark.createDataFrame([("x[bot]", "a@b"), ("Renovate Bot", "a@b"), ("ann", "1@users.noreply.github.com"), ("ann", "a@b")], "a string, e string")
    assert [r[0] for r in df.select(paths.is_bot(F.col("a"), F.col("e"))).collect()] == [True, True, True, False]
    f = spark.createDataFrame([("src/a.ts", 7), ("src/b.ts", 3), ("src/b.test.ts", 0), ("src/c.ts", 0)], "path string, exports int")
    assert [(r.path, r.severity) for r in history.untested(f).collect()] == [("src/a.ts", "high")]


def test_satd(spark):
    f = texts(spark, ("python", "x = 1\n# TODO: mend\n"), ("python", "todo list\nmethod()"), ("python", "# TODO from ChatGPT, not sure why\n"))
    assert [(r.path, r.line) for r in textsmells.satd(f).orderBy("path").collect()] == [("f0", 2), ("f2", 1)]
    assert [(r.path, r.severity) for r in textsmells.ai_satd(f).collect()] == [("f2", "medium")]


def test_magic_numbers(spark):
    f = texts(spark, ("python", "x = 42 + 7\nMAX_SIZE = 100\n# 99\ny = 1 - 0\nz = 3.5"), ("java", "private static final int MAX_RETRY = 3;"))
    assert [(r.path, r.line) for r in textsmells.magic_numbers(f).collect()] == [("f0", 1), ("f0", 1)]


def test_security(spark):
    f = texts(
        spark,
        ("python", "import pickle\npickle.loads(x)\nyaml.load(x)\nyaml.load(x, Loader=SafeLoader)"),
        ("javascript", "const u = req.query.url\n\nfetch(u)\n" + "\n" * 9 + "fetch(v)\neval(x)\neval('1')"),
        ("python", "token = random.random()\nhashlib.md5(x)"),
        ("python", "\n" * 3 + "p = random.random()"),
        ("javascript", "db.query('select ' + x)\nel.innerHTML = y\nel.innerHTML = 'z'"),
    )
    assert [(r.path, r.line) for r in textsmells.unsafe_deserialization(f).orderBy("path", "line").collect()] == [("f0", 2), ("f0", 3), ("f1", 14)]
    assert [(r.path, r.line) for r in textsmells.ssrf(f).collect()] == [("f1", 3)]
    assert sorted((r.path, r.line, r.severity) for r in textsmells.weak_cryptography(f).collect()) == [("f2", 1, "high"), ("f2", 2, "critical")]
    assert sorted((r.type, r.line) for r in textsmells.injections(f).collect() if r.path == "f4") == [("SqlInjectionRisk", 1), ("XssRisk", 2)]


def test_secrets(spark):
    f = texts(spark, ("python", 'token = "3f9a8c7b6d5e4f3a2b1c0d9e8f7a6b5c4d3e2f1a"'), ("python", 'token = "aaaaaaaaaaaaaaaaaaaaaaaa"'), ("python", 'name = "3f9a8c7b6d5e4f3a2b1c0d9e8f7a"'))
    assert [r.path for r in textsmells.secrets(f).collect()] == ["f0"]


def test_exceptions(spark):
    f = texts(spark, ("javascript", "try { a() } catch (e) {}\ntry { a() } catch (e) { log(e) }\ntry { a() } catch (e) { throw e }\nthrow new MyError(e.message)"), ("python", "try:\n    a()\nexcept ValueError:\n    pass\ntry:\n    a()\nexcept Exception as e:\n    raise X(str(e))\n"), ("java", "catch (Exception e) { log(); }\ncatch (IOException e) { throw new X(e.getMessage()); }"))
    got = sorted((r.path, r.line, r.severity) for r in codesmells.exceptions(f).collect())
    assert got == [("f0", 1, "medium"), ("f0", 2, "low"), ("f0", 4, "high"), ("f1", 3, "medium"), ("f1", 7, "low"), ("f1", 8, "high"), ("f2", 1, "low"), ("f2", 1, "medium"), ("f2", 2, "high")]


def test_model_calls(spark):
    f = texts(spark, ("typescript", "\nclient.messages.create({ model: 'claude-x', messages: m })\n"), ("typescript", "client.messages.create({ model: 'gpt-4o-2024-08-06', max_tokens: 5, temperature: 0, response_format: r, system: s, messages: m })"))
    got = sorted((r.path, r.type, r.line) for r in codesmells.model_calls(f).collect())
    assert got == [("f0", t, 2) for t in ("LlmNoStructuredOutput", "LlmNoSystemMessage", "LlmUnboundedCall", "LlmUnpinnedModel", "LlmUnsetTemperature")]


def test_python_functions(spark):
    src = "def f(self, a, b, c, d, e):\n    if a and b and c and d:\n        for x in a:\n            while x:\n                if x:\n                    x = 42 + 43 + 44\n    elif b:\n        pass\n    return a.b().c().d().e()\n"
    r = functions.python_functions(texts(spark, ("python", src), ("python", "def broken(:"))).orderBy("path").collect()
    assert (r[0]["cc"], r[0].nesting, r[0].params, r[0].chain, r[0].booleans, r[0].numbers) == (9, 4, 5, 4, 3, 3)
    assert r[1]["name"] is None
    f = functions.python_functions(texts(spark, ("python", src)))
    assert sorted(x.type for x in functions.threshold_findings(f).collect()) == ["DeepNesting", "LongParameterList"]
    assert {x.type for x in functions.shape_findings(f).collect()} == {"ComplexConditional", "MessageChain", "MagicNumber"}


def test_tier_b(spark):
    f = texts(spark, ("bash", "run() {\n  if a; then b; fi\n}\nfunction other {\n  for x in y; do z && w; done\n}"))
    assert [(r["name"], r.line, r["cc"], r.length) for r in functions.tier_b(f, "bash").orderBy("line").collect()] == [("run", 1, 2, 3), ("other", 4, 3, 3)]


def test_packages(spark):
    assert [packages.typo(*x) for x in (("lodahs", "lodash"), ("reqest", "request"), ("requ3sts", "requests"), ("expres5", "express"), ("numpt", "numpy"), ("requests", "request"), ("left-pad", "leftpad"))] == ["transpose", "indel", "keyslip", "homoglyph", "keyslip", None, None]
    i = spark.createDataFrame([("a", "lodahs"), ("a", "react"), ("b", "fakelib")], "path string, name string")
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    p = spark.createDataFrame([("lodash", 0), ("request", 1)], "name string, ord bigint")
    got = {(r.name, r.reason) for r in packages.slopsquatting(i, one("zzz"), one("react"), one("fakelib"), p).collect()}
    assert got == {("lodahs", "typosquat:transpose"), ("fakelib", "invented")}
    h = packages.hallucinated(spark.createDataFrame([("a", "./x", 1), ("a", "@s/p/q", 2), ("a", "fs", 3), ("a", "ghost/sub", 4)], "path string, name string, line int"), one("@s/p"), one("fs"))
    assert [(r.package, r.line) for r in h.collect()] == [("ghost", 4)]


def test_clones(spark):
    block = "\n".join(["if x > 1:", "  return x", "for i in y:", "  z(i)", "w = 5", "q(w)"])
    f = texts(spark, ("python", block + "\n\nother = 1\n" + "\n".join(f"v{i} = {i}" for i in range(6)) + "\n" + block), ("python", "a = 1\n" + block))
    r = clones.duplicate_code(f).collect()
    assert [(x.path, x.kind, x.a_start, x.lines) for x in r if x.kind == "exact"] == [("f0", "exact", 1, 6)]
    assert {(x.a, x.b) for x in clones.cross_file_pairs(clones.windows(f)).collect()} == {("f0", "f1")}


def test_gate_and_verdict(spark):
    before = spark.createDataFrame([("a", "SATD", None), ("a", "XssRisk", "f")], "path string, type string, function_name string")
    after = spark.createDataFrame([("a", "SATD", None), ("a", "XssRisk", "g"), ("b", "LargeFile", None)], "path string, type string, function_name string")
    new = rules.new_findings(before, after)
    assert {(r.path, r.type) for r in new.collect()} == {("a", "XssRisk"), ("b", "LargeFile")}
    s = spark.createDataFrame([("a", 9.0, 9.0), ("b", 9.0, 8.9), ("c", 5.0, 5.5), ("d", 8.0, 8.0)], "path string, before double, after double")
    assert {r.path: r.reason for r in rules.gate(s, new).collect()} == {"a": "new_security", "b": "score_drop", "c": "below_floor", "d": "ok"}


def test_git_texts(spark):
    sha = "a" * 40
    lines = spark.createDataFrame([("l", i, x) for i, x in enumerate([sha, "", "src/a.ts", "doc/b.md", "b" * 40, "", "c" * 40, "src/c.ts"])], "file string, seq int, text string")
    assert {(r.sha[0], r.seq, r.path) for r in gitlog.name_only(lines, "src/").collect()} == {("a", 0, "src/a.ts"), ("c", 2, "src/c.ts")}
    t = spark.createDataFrame([("3\t4\ta.ts",), ("-\t-\tb.png",), ("x",), ("@@ -1,2 +10,3 @@ f",), ("@@ -1 +7 @@",), ("@@ -1 +7,0 @@",), ("author-mail <a@b>",)], "text string")
    assert [tuple(r) for r in gitlog.numstat(t).collect()] == [("a.ts", 3, 4)]
    assert {tuple(r) for r in gitlog.hunks(t).collect()} == {(10, 12), (7, 7)}
    assert [tuple(r) for r in gitlog.blame(t).collect()] == [("a@b", 1)]
    f = spark.createDataFrame([("p", "a\nb\nc")], "path string, content string")
    d = spark.createDataFrame([("p", "@@ -2,1 +2,2 @@\n-b\n+B\n+BB")], "path string, diff string")
    assert value(gitlog.apply_unified_diff(f, d), "content") == "a\nB\nBB\nc"


def test_imports(spark):
    f = spark.createDataFrame([("src/a/x.ts", "typescript", "import y from '../b/y'\nimport z from './z.js'\nimport r from 'react'")], "path string, language string, content string")
    assert {r.dst for r in files.imports(f).collect()} == {"src/b/y.ts", "src/a/z.js"}


def test_stores_and_sinks(spark, tmp_path):
    assert files.json_store(spark, str(tmp_path / "none"), files.GOAL).count() == 0
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "file_path string, created_at int, x int")
    new = spark.createDataFrame([("a", 9, 7), ("c", 9, 8)], "file_path string, created_at int, x int")
    assert {tuple(r) for r in files.upsert(old, new).collect()} == {("a", 1, 7), ("b", 1, 6), ("c", 9, 8)}
    f = spark.createDataFrame([("./a", "XssRisk", "high", 3), ("./a", "SATD", "low", None)], "path string, type string, severity string, line int")
    import json

    rep = json.loads(value(sinks.sarif(f, "t"), "report"))
    assert len(rep["runs"][0]["results"]) == 2
    assert {json.loads(r.issue)["location"]["path"] for r in sinks.gitlab(f).collect()} == {"a"}
    assert {tuple(r) for r in sinks.rules(f).collect()} == {("HAC102", "XssRisk", 79), ("SATD", "SATD", None)}
    sinks.append_json(f, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("x = 1")
    (tmp_path / "p" / "node_modules").mkdir()
    (tmp_path / "p" / "node_modules" / "b.js").write_text("y")
    assert [r.language for r in files.project_files(spark, str(tmp_path / "p")).collect()] == ["python"]


def test_labels(spark):
    c = spark.createDataFrame([("a", "s1", "Fix crash"), ("a", "s2", "work"), ("b", "s2", "work")], "path string, sha string, message string")
    assert {(r.path, r.has_bug, r.bug_count) for r in labels.from_fix_commits(c).collect()} == {("a", True, 1), ("b", False, 0)}


def test_plugins(spark):
    reg = plugins.Registry()
    p = plugins.Plugin("no-tabs", lambda code, lang, path: [{"type": "Tabs", "line": 1}] if "\t" in code else [], ("python",), {"Tabs": 0.4})
    assert reg.register(p) == [] and reg.weight("Tabs") == 0.4 and reg.weight("SATD") == 0.6
    with pytest.raises(ValueError, match="registered"):
        reg.register(p)
    f = texts(spark, ("python", "\tx"), ("java", "\tx"))
    assert [r.path for r in plugins.run(f, reg).collect()] == ["f0"]
    assert plugins.conforms(p, ["\t"], ["x"]) == []


def test_readiness(spark):
    f = texts(spark, ("python", "a = 1\nqz = 2\nuser_name = 3\nuserName = 4\n# b c d"))
    r = readiness.naming_clarity(f).first()
    assert (r.single, r.cryptic, r.mixed, r.score) == (1, 1, 1, pytest.approx(7.7))
    b = spark.createDataFrame([("p", "x" * 400)] * 9 + [("p", "x" * 12000)], "path string, content string")
    r = readiness.context_fit(b).first()
    assert (r.n, r.over, r.score, r.context) == (10, 1, 9.0, 4096)


def test_method_coupling(spark):
    rows = [(i, m) for i in range(7) for m in "ab"] + [(10 + i, m) for i in range(4) for m in "cd"] + [(20 + i, "a") for i in range(3)]
    df = spark.createDataFrame(rows, "sha int, method string")
    assert {(r.a, r.b, r.together) for r in coupling.method_coupling(df).collect()} == {("a", "b", 7), ("c", "d", 4)}


def test_goals_stream_equals_batch(spark, tmp_path):
    rows = [("a", f"2024-01-0{i}", s) for i, s in enumerate([9.0, 8.5, 6.0, 9.0], 1)] + [("b", "2024-01-01", 5.0)]
    df = spark.createDataFrame(rows, "path string, t string, score double").select("path", F.col("t").cast("timestamp").alias("ts"), "score")
    df.write.parquet(str(tmp_path / "in"))
    q = goals.follow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("goals").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    want = {(r.path, r.score, r.status) for r in goals.follow_batch(df).collect()}
    assert {(r.path, r.score, r.status) for r in spark.table("goals").collect()} == want and ("a", 9.0, "failed") in want


def test_exact_log():
    assert math.isclose(scoring.WEIGHTS["HardcodedApiKey"], 2.0)


def test_clones_cover_whole_texts(spark):
    block = [f"if a{k}: return b{k}" for k in range(8)]
    text = "\n".join([f"x{i} = {i}" for i in range(2100)] + block + ["y = 0"] * 7 + block)
    files = spark.createDataFrame([(1, text), (2, "\n".join(block))], "path long, content string")
    w = clones.windows(files).cache()
    assert w.where("path = 1").count() == 2123 - 5 and clones.windows(files, most=2000).where("path = 1").count() == 1995
    assert clones.shared_windows(w).count() == 3 and clones.cross_file_pairs(w).count() == 6
    assert (2101, 2116, 8) in {(r.a_start, r.b_start, r.lines) for r in clones.regions(w).collect()}
    assert [(r.a_start, r.b_start, r.lines) for r in clones.duplicate_code(files).where("kind = 'exact'").collect()] == [(2101, 2116, 8)]


def test_similar_by_rare_grams_equals_all_pairs(spark):
    import random

    rnd = random.Random(3)
    sets = []
    for g in range(12):
        base = rnd.sample(range(60), rnd.randrange(1, 30))
        for _ in range(4):
            sets.append({x for x in base if rnd.random() > 0.15} | set(rnd.sample(range(200), rnd.randrange(0, 4))))
    df = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "path int, gram int")
    for least in (0.5, 0.7, 0.9):
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(r.a, r.b) for r in clones.similar(df, least).collect()} == want and want


def test_numbers_and_words_beside_letters_beyond_ascii(spark):
    f = texts(spark, ("python", "2İ2 = é25\nx\n2\n  import 7"), ("python", "# TODOé"), ("python", "étoken = 'aB3dE6gH9jK2mN5p'"))
    assert sorted((r.path, r.line) for r in textsmells.magic_numbers(f).collect()) == [("f0", 1), ("f0", 1), ("f0", 1), ("f0", 3)]
    assert [(r.path, r.line) for r in textsmells.satd(f).collect()] == [("f1", 1)]
    assert [(r.path, r.line) for r in textsmells.secrets(f).collect()] == [("f2", 1)]


def test_pairs_and_thirds_over_many_tasks_equal_brute_force(spark, monkeypatch):
    import itertools
    import random

    monkeypatch.setattr(coupling, "TASK_ROWS", 40, raising=False)
    rng = random.Random(3)
    rows = [(g, rng.randrange(12), rng.choice([None, 0, 1, 2, 3])) for g in range(100) for _ in range(rng.randrange(1, 6))]
    df = spark.createDataFrame([*rows, *rows[:50], (None, 1, 0), (None, 2, 0), (7, None, 0)], "sha int, path int, at int")
    sets, at = {}, {}
    for g, x, t in rows:
        sets.setdefault(g, set()).add(x)
        at[g] = min((v for v in (at.get(g), t, 0 if g == 7 else None) if v is not None), default=None)
    count = lambda gs: __import__("collections").Counter(p for g in gs for p in itertools.combinations(sorted(sets[g]), 2))
    got = coupling.together(df, "sha", "path")
    assert {(r.a, r.b): r.together for r in got.collect()} == count(sets)
    assert {(r.sha, r.a, r.b) for r in coupling.pairs(df, "sha", "path").collect()} == {(g, *p) for g in sets for p in itertools.combinations(sorted(sets[g]), 2)}
    assert got.rdd.getNumPartitions() == -(-df.count() // 40)
    for chronological in (False, True):
        key = (lambda g: (at[g] is not None, at[g] or 0, g)) if chronological else (lambda g: (at[g] is None, -(at[g] or 0), g))
        order = sorted(sets, key=key)
        ends = {"early": order[: len(order) // 3], "late": order[len(order) - len(order) // 3 :]}
        together, touches = {p: count(gs) for p, gs in ends.items()}, {p: __import__("collections").Counter(x for g in gs for x in sets[g]) for p, gs in ends.items()}
        of = lambda p, a, b: together[p][a, b] / max(touches[p][a], touches[p][b], 1)
        want = {(a, b): (pytest.approx(of("early", a, b)), pytest.approx(of("late", a, b))) for a, b in together["early"] | together["late"]}
        s = coupling.stability(df.where("sha is not null"), "at", chronological=chronological)
        assert {(r.a, r.b): (r.early, r.late) for r in s.collect()} == want
        assert "WindowExec" not in s._jdf.queryExecution().toString() and "Exchange SinglePartition" not in s._jdf.queryExecution().executedPlan().toString()


def test_similar_compares_whole_sets_only_where_the_rarest_grams_leave_it_possible(spark):
    import random

    rng = random.Random(5)
    base = [{int(rng.paretovariate(0.6)) for _ in range(rng.randrange(1, 40))} for _ in range(60)]
    sets = dict(enumerate(base + [{x for x in s if rng.random() > 0.1} | {rng.randrange(50)} for s in base]))
    df = spark.createDataFrame([(p, g) for p, s in sets.items() for g in s], "path int, gram long")
    for least in (0.1, 0.5, 0.7, 1.0):
        want = {(a, b): pytest.approx(j) for a in sets for b in sets if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= least}
        found = clones.similar(df, least)
        assert {(r.a, r.b): r.jaccard for r in found.collect()} == want and (want or least == 1.0)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "array_intersect" in plan if least >= 0.5 else "RepartitionByExpression" in plan
