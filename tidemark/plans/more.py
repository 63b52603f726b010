"""More registered queries: paths, methods, architecture, readiness, packages, sinks, rules and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.functions.tables import EXTENSIONS
from tidemark.operators import coupling, functions, graph, history, packages, readiness, rules, scoring, stats, textsmells
from tidemark.plans.queries import FINDINGS, REACH, SUPPLIERS, big, findings, query, r6, table, trade
from tidemark.sources import sinks

# ---- paths: names of files made from parts

ENDINGS = [".ts", ".py", ".JAVA", ".test.ts", "_test.go", "Service.cs", "Controller.rb", ".R", ".unknown", ".spec.js", "Entity.kt", "Dockerfile"]
FOLDERS = ["src/api", "src/models", "lib", "tests/unit", ".", "services/a/utils"]
_PATHS = f"""f as (select p_partkey id, case p_partkey % 6 {" ".join(f"when {i} then '{x}'" for i, x in enumerate(FOLDERS))} end || '/' || case when p_partkey % 12 = 11 then 'd' || p_partkey || '/' else replace(p_name, ' ', '') || p_partkey end
|| case p_partkey % 12 {" ".join(f"when {i} then '{x}'" for i, x in enumerate(ENDINGS))} end as path from part)"""


def part_files(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda values, key: F.get(F.array(*(F.lit(x) for x in values)), key.cast("int"))
    k = F.col("p_partkey")
    name = F.when(k % 12 == 11, F.concat(F.lit("d"), k, F.lit("/"))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), k))
    return table(spark, sf, "part").select(k.alias("id"), F.concat(of(FOLDERS, k % 6), F.lit("/"), name, of(ENDINGS, k % 12)).alias("path"))


_LANGUAGES = ", ".join(f"('{e}', '{lang}')" for lang, es in EXTENSIONS.items() for e in es.split())


@query("PRJ01_language", f"""with {_PATHS}, m(e, lang) as (values {_LANGUAGES}), x as (select id, path, regexp_extract(path, '[^/](\\.[^./]*)$', 1) e, regexp_extract(path, '([^/]*)$', 1) base from f)
select id, path, coalesce(a.lang, b.lang, case when lower(base) in ('dockerfile', 'makefile') then lower(base) when lower(base) = 'gnumakefile' then 'makefile' end, 'unsupported') as language from x left join m a on a.e = x.e left join m b on b.e = lower(x.e)""")
def prj_language(spark, sf):
    return part_files(spark, sf).select("id", "path", paths.detect_language(F.col("path")).alias("language"))


@query("PRJ02_role", f"""with {_PATHS}, x as (select id, lower(path) p, regexp_extract(lower(path), '([^/]*)$', 1) base from f)
select id, case when regexp_matches(p, '(^|/)(__tests__|tests?)/') or contains(base, '.test.') or contains(base, '.spec.') or ends_with(base, '_test.go') or regexp_matches(base, 'test\\.[a-z0-9]+$') or regexp_matches(base, '(^|[._-])test[._-]') then 'test'
when regexp_matches(p, '(^|/)controllers?/') or regexp_matches(base, '(controller|handler|router)\\.[a-z0-9]+$') then 'controller' when regexp_matches(p, '(^|/)services?/') or regexp_matches(base, '(service|manager|facade)\\.[a-z0-9]+$') then 'service'
when regexp_matches(p, '(^|/)(models?|entity|entities|domain)/') or regexp_matches(base, '(entity|model)\\.[a-z0-9]+$') then 'entity' when regexp_matches(p, '(^|/)(utils?|helpers?|lib)/') or regexp_matches(base, '(utils|helper)\\.[a-z0-9]+$') then 'util' else 'unknown' end as role from x""")
def prj_role(spark, sf):
    return part_files(spark, sf).select("id", paths.role_of(F.col("path")).alias("role"))


@query("PRJ05_bots", "select c_custkey, c_custkey % 5 = 0 or c_custkey % 7 = 0 or c_custkey % 11 = 0 as bot from customer")
def prj_bots(spark, sf):
    k = F.col("c_custkey")
    author = F.when(k % 5 == 0, F.concat("c_name", F.lit("[bot]"))).when(k % 7 == 0, F.lit("Renovate Update")).otherwise(F.col("c_name"))
    email = F.when(k % 11 == 0, "1+x@users.NoReply.github.com").otherwise("a@b.org")
    return table(spark, sf, "customer").select("c_custkey", paths.is_bot(author, email).alias("bot"))


# ---- methods

_CHANGED = "one as (select distinct l_orderkey g, l_suppkey x from lineitem), n as (select x, count(*) n from one group by 1)"
_COUPLED = f"{_CHANGED}, c as (select a.x a, b.x b, count(*) together from one a join one b on a.g = b.g and a.x < b.x group by 1, 2 having count(*) >= 2), s as (select a, b, together, together / greatest(p.n, q.n) v from c join n p on p.x = a join n q on q.x = b)"
_LEVEL = "case when v >= 0.8 then 'high' when v >= 0.65 then 'medium' else 'low' end"


def _coupled(spark, sf):
    changed = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_suppkey").alias("method"))
    return coupling.method_coupling(changed, least=0.03, min_together=2)


@query("TMP05_method_coupling", f"with {_COUPLED} select a, b, together, floor(v * 1e6 + 0.5) / 1e6 strength, {_LEVEL} severity from s where v >= 0.03")
def tmp_method_coupling(spark, sf):
    return _coupled(spark, sf).withColumn("strength", r6("strength"))


@query("TMP06_coupling_findings", f"with {_COUPLED} select 'MethodTemporalCoupling' as type, case when {_LEVEL} = 'high' then 'medium' else 'low' end severity, a, b from s where v >= 0.03")
def tmp_coupling_findings(spark, sf):
    return coupling.coupling_findings(_coupled(spark, sf))


# A function for each line item: a supplier is a file, a part a name.
_FUNCTIONS = "fn as (select l_suppkey path, l_partkey % 40 as name, l_orderkey line, l_linenumber k, cast(l_quantity as int) cc, cast(l_quantity * 2 as int) length, l_linenumber % 7 nesting, l_partkey % 9 params from lineitem)"


def part_functions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(c("l_suppkey").alias("path"), (c("l_partkey") % 40).cast("string").alias("name"), c("l_orderkey").alias("line"), c("l_linenumber").alias("k"), c("l_quantity").cast("int").alias("cc"), (c("l_quantity") * 2).cast("int").alias("length"), (c("l_linenumber") % 7).alias("nesting"), (c("l_partkey") % 9).alias("params"))


@query("TMP20_brain_methods", f"""with {_FUNCTIONS}, o as (select *, sum(cc) over (partition by path, name) own from fn), z as (select *, own / greatest(max(own) over (partition by path), 1) central from o),
u as (select *, least(cc / 20, 1) a, least(length / 100, 1) b, least(nesting / 5, 1) c, least(params / 6, 1) d, least(central, 1) e from z), s as (select *, 0.30::double * a + 0.25::double * b + 0.25::double * c + 0.10::double * d + 0.10::double * e score, (a > 0.5)::int + (b > 0.5)::int + (c > 0.5)::int + (d > 0.5)::int + (e > 0.5)::int factors from u)
select path, line, k, floor(score * 1e6 + 0.5) / 1e6 score, factors from s where score >= 0.55 and factors >= 3""")
def tmp_brain(spark, sf):
    return history.brain_methods(part_functions(spark, sf)).select("path", "line", "k", r6("score").alias("score"), "factors")


@query("DET08_complexity_mass", f"""with {_FUNCTIONS}, m as (select path, count(*) n, sum(case when cc > 10 then cc * sqrt(length) else 0 end) / sum(cc * sqrt(length)) share from fn group by 1)
select path, case when share > 0.8 then 'critical' else 'high' end severity, floor(share * 1e6 + 0.5) / 1e6 share from m where n >= 3 and share > 0.6""")
def det_mass(spark, sf):
    return functions.complexity_mass(part_functions(spark, sf)).select("path", "severity", r6("metric_value").alias("share"))


@query("DET28_fragmented", "select l_suppkey path, count(*) n from lineitem where l_quantity < 4 group by 1 having count(*) >= 8")
def det_fragmented(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), F.when(F.col("l_quantity") < 4, 1).otherwise(3).alias("cc"), F.col("l_quantity").alias("length"))
    return functions.fragmented(f).select("path", F.col("metric_value").cast("bigint").alias("n"))


@query("DET17_doc_coverage", """with d as (select l_suppkey path, count(*) n, avg(case when l_returnflag = 'R' then 1.0 else 0.0 end) share from lineitem where l_quantity > 3 group by 1)
select path, case when share < 0.5 then 'medium' else 'low' end severity, floor(share * 1e6 + 0.5) / 1e6 share from d where n >= 3 and share < 0.8""")
def det_doc_coverage(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), F.lit("f").alias("name"), F.col("l_quantity").alias("length"), (F.col("l_returnflag") == "R").alias("documented"))
    return functions.doc_coverage(f).select("path", "severity", r6("metric_value").alias("share"))


@query("JN15_data_clumps", """with a as (select l_orderkey path, l_linenumber line, list_sort(list_distinct([l_partkey % 5, l_suppkey % 5, l_linenumber % 5, 7])) p from lineitem), w as (select * from a where len(p) >= 3),
b as (select x.path, x.line, list_sort(list_intersect(x.p, y.p)) names from w x join w y on x.path = y.path and x.line < y.line), g as (select path, names, min(line) line from b where len(names) >= 3 group by 1, 2) select path, line, cast(len(names) as bigint) shared from g""")
def jn_clumps(spark, sf):
    of = lambda *x: F.array_distinct(F.array(*(c.cast("string") for c in x)))
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.lit("f").alias("name"), F.col("l_linenumber").alias("line"), of(F.col("l_partkey") % 5, F.col("l_suppkey") % 5, F.col("l_linenumber") % 5, F.lit(7)).alias("parameters"))
    return functions.data_clumps(f).select("path", "line", F.col("metric_value").cast("bigint").alias("shared"))


@query("TMP21_untested", f"""with {_PATHS}, x as (select id, path, id % 8 exports from f), t as (select path from x),
n as (select id, path, exports, regexp_replace(path, '/[^/]*$', '') d, regexp_extract(path, '([^/]*)$', 1) nm from x where exports > 0), b as (select *, regexp_replace(nm, '\\.[^.]*$', '') base, regexp_extract(nm, '(\\.[^.]*)$', 1) ext from n),
c as (select id, unnest([d || '/' || base || '.test' || ext, d || '/' || base || '.spec' || ext, d || '/' || base || '.test.ts', d || '/' || base || '.spec.ts', 'tests/' || regexp_replace(path, '\\.tsx?$', '') || '.test.ts', '__tests__/' || base || '.test.ts',
case when starts_with(path, 'src/') then 'tests/' || regexp_replace(substr(path, 5), '\\.([^./]*)$', '.test.\\1') else d || '/tests/' || base || '.test' || ext end]) p from b)
select id, exports, case when exports >= 6 then 'high' when exports >= 3 then 'medium' else 'low' end severity from x where exports > 0 and id not in (select id from c where p in (select path from t))""")
def tmp_untested(spark, sf):
    f = part_files(spark, sf).withColumn("exports", F.col("id") % 8)
    return history.untested(f).join(f.select("path", "id"), "path").select("id", "exports", "severity")


# ---- architecture

_PROFILE = f"""{REACH}, d as (select dst node, count(*) d from r where src <> dst group by 1), g as (select node, sum(i) i, sum(o) o from (select src node, 0 i, 1 o from e union all select dst, 1, 0 from e) group by 1),
k as (select a.src node, min(a.dst) c from r a join r z on z.src = a.dst and z.dst = a.src group by 1), m as (select n.node, least(n.node, coalesce(c, n.node)) component from n left join k on k.node = n.node), y as (select component, count(*) size from m group by 1),
p as (select n.node, i fan_in, o fan_out, o / (i + o) instability, coalesce(d.d, 0) / (select count(*) from n) as cost, y.size > 1 in_cycle from n join g on g.node = n.node left join d on d.node = n.node join m on m.node = n.node join y on y.component = m.component),
q as (select *, greatest(0, least(1, 0.35::double * fan_in / greatest((select max(fan_in) from p), 1) + 0.40::double * cost + 0.15::double * in_cycle::int)) change_cost from p), v as (select *, case when change_cost >= 0.6 then 'high' when change_cost >= 0.35 then 'medium' else 'low' end severity from q)"""


@query("ARC05_module_profile", f"{_PROFILE} select node, cast(fan_in as bigint) fan_in, cast(fan_out as bigint) fan_out, in_cycle, floor(change_cost * 1e6 + 0.5) / 1e6 change_cost, severity from v")
def arc_profile(spark, sf):
    return graph.module_profile(trade(spark, sf)).select("node", *big("fan_in", "fan_out"), "in_cycle", r6("change_cost").alias("change_cost"), "severity")


@query("ARC07_summary", f"{_PROFILE} select count(*) modules, floor(avg(cost) * 1e6 + 0.5) / 1e6 mean_cost, floor(avg(instability) * 1e6 + 0.5) / 1e6 mean_instability, count(*) filter (in_cycle) in_cycles, count(*) filter (severity = 'high') high from v")
def arc_summary(spark, sf):
    return graph.summary(graph.module_profile(trade(spark, sf))).withColumns({"mean_cost": r6("mean_cost"), "mean_instability": r6("mean_instability")})


@query("ARC09_report_links", f"{_PROFILE} select src, dst from e where src in (select node from v where severity = 'high') and dst in (select node from v where severity = 'high')")
def arc_links(spark, sf):
    e = trade(spark, sf)
    return graph.report(graph.module_profile(e), e, "high")[1]


# ---- readiness and security

@query("DET41_doc_debt", "with d as (select p_partkey, least(1, p_size / 50) * (1 - p_partkey % 11 / 10) v from part) select p_partkey, floor(v * 1e6 + 0.5) / 1e6 doc_debt, case when v <= 0 then null when v >= 0.6 then 'high' when v >= 0.3 then 'medium' else 'low' end severity from d")
def det_doc_debt(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("cognitive"), (F.col("p_partkey") % 11 / 10).alias("coverage"))
    return readiness.doc_debt(d).select("p_partkey", r6("doc_debt").alias("doc_debt"), "severity")


@query("DET42_intent_clarity", "with d as (select p_partkey, 0.40::double * (p_partkey % 11 / 10) + 0.35::double * (p_size % 11 / 10) + 0.25::double * (p_partkey % 7 / 6) v from part) select p_partkey, floor(v * 1e6 + 0.5) / 1e6 clarity, case when v < 0.40 then 'high' when v < 0.65 then 'medium' end severity from d")
def det_intent(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 11 / 10).alias("doc"), (F.col("p_size") % 11 / 10).alias("types"), (F.col("p_partkey") % 7 / 6).alias("names"))
    return readiness.intent_clarity(d).select("p_partkey", r6("clarity").alias("clarity"), "severity")


@query("DET46_context_fit", """with t as (select source path, ceil(length(text) / 4) t from documents where text is not null), s as (select path, count(*) n, avg(t) mean, max(t) mx, count(*) filter (t > 2000) o, list_sort(list(t)) l from t group by 1),
p as (select *, l[greatest(0, cast(floor(n * 0.9) as int) - 1) + 1] p90 from s)
select path, n, cast(floor(mean + 0.5) as bigint) mean_tokens, cast(mx as bigint) max_tokens, o as "over", floor((10 - 10 * o / n) * 10 + 0.5) / 10 score, case when p90 <= 4096 then 4096 when p90 <= 8192 then 8192 when p90 <= 16384 then 16384 when p90 <= 32768 then 32768 when p90 <= 65536 then 65536 else 131072 end as context from p""")
def det_context(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select(F.col("source").alias("path"), F.col("text").alias("content"))
    return readiness.context_fit(d)


@query("DET49_disagreement", "with d as (select p_partkey, p_size / 50 s, p_partkey % 11 / 10 a from part) select p_partkey, floor((0.4::double * s + 0.6::double * a) * 1e6 + 0.5) / 1e6 combined, case when abs(s - a) > 0.5 then 'high' when abs(s - a) > 0.25 then 'medium' else 'none' end gap from d")
def det_disagreement(spark, sf):
    s, a = F.col("p_size") / 50, F.col("p_partkey") % 11 / 10
    return table(spark, sf, "part").select("p_partkey", r6(textsmells.combined_score(s, a)).alias("combined"), textsmells.disagreement(s, a).alias("gap"))


_GRADE = "case when l_quantity < 2 then 'critical' when l_quantity < 4 then 'high' when l_quantity < 7 then 'medium' else 'low' end"


@query("DET50_security_risk", f"""with f as (select l_suppkey * 1000 + l_orderkey % 100 path, {_GRADE} g from lineitem), s as (select path, case g when 'critical' then 0.9 when 'high' then 0.75 when 'medium' then 0.55 else 0.3 end::double v from f)
select path, count(*) findings, floor(least(10.0, 10 * avg(0.4::double * v + 0.3::double)) * 1e6 + 0.5) / 1e6 risk from s group by 1""")
def det_risk(spark, sf):
    return textsmells.security_risk(findings(spark, sf)[1]).withColumn("risk", r6("risk"))


@query("DET51_scan_cost", "select count(*) findings, count(*) * 400 tokens_in, count(*) * 150 tokens_out, floor((count(*) * 400 * 3.0::double + count(*) * 150 * 15.0::double) / 1e6 * 1e6 + 0.5) / 1e6 as cost from lineitem")
def det_cost(spark, sf):
    return textsmells.scan_cost(findings(spark, sf)[1], 3.0, 15.0).withColumn("cost", r6("cost"))


@query("MTH04_git_score", "select l_orderkey, l_linenumber, case when l_quantity * 6 > 200 and l_linenumber <= 2 then 0.7 when l_quantity * 6 > 100 and l_linenumber <= 5 then 0.4 else 0.2 end::double score from lineitem")
def mth_git_score(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", readiness.git_score(F.col("l_quantity") * 6, F.col("l_linenumber")).alias("score"))


_CDF = "case when {z} >= 0 then (1 + {e}) / 2 else (1 - {e}) / 2 end"
_ERF = "(1 - t{k} * (0.254829592 + t{k} * (-0.284496736 + t{k} * (1.421413741 + t{k} * (-1.453152027 + t{k} * 1.061405429::double)))) * exp(-x{k} * x{k}))"


@query("MTH03_normal_cdf", f"""with a as (select s_suppkey, (s_suppkey - 50) / 20 z from supplier), b as (select *, abs(z) / sqrt(2) x0, abs(z) x1 from a), c as (select *, 1 / (1 + 0.3275911::double * x0) t0, 1 / (1 + 0.3275911::double * x1) t1 from b)
select s_suppkey, floor(({_CDF.format(z="z", e=_ERF.format(k=0))}) * 1e6 + 0.5) / 1e6 cdf, floor(({_CDF.format(z="z", e=_ERF.format(k=1))}) * 1e6 + 0.5) / 1e6 legacy from c""")
def mth_cdf(spark, sf):
    from tidemark.functions.numeric import normal_cdf

    z = (F.col("s_suppkey") - 50) / 20
    return table(spark, sf, "supplier").select("s_suppkey", r6(normal_cdf(z)).alias("cdf"), r6(normal_cdf(z, legacy=True)).alias("legacy"))


# ---- packages

_IMPORTS = "i as (select p_partkey path, replace(p_name, ' ', '-') as name, p_size line from part)"


@query("DET38_hallucinated", f"""with {_IMPORTS}, k as (select replace(p_name, ' ', '-') as name from part group by 1 having count(*) > 12)
select path, name as package, min(line) line from i where name not in (select name from k) and name not like 'red-%' group by 1, 2""")
def det_hallucinated(spark, sf):
    name = F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")
    part = table(spark, sf, "part")
    known = part.groupBy(name).agg(F.count("*").alias("n")).where("n > 12").select("name")
    builtins = part.select(name).where("name like 'red-%'").distinct()
    return packages.hallucinated(part.select(F.col("p_partkey").alias("path"), name, F.col("p_size").alias("line")), known, builtins)


@query("JN13_slopsquatting", f"""with {_IMPORTS}, n as (select name, count(*) n from i group by 1) select path, i.name, 'invented' as reason from i join n on n.name = i.name where n.n <= 15 and i.name not like 'red-%' and n.n % 3 <> 0""")
def jn_slopsquatting(spark, sf):
    name = F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")
    i = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), name)
    n = i.groupBy("name").agg(F.count("*").alias("n"))
    none = spark.createDataFrame([], "name string, ord bigint")
    return packages.slopsquatting(i, n.where("n % 3 = 0"), i.select("name").where("name like 'red-%'").distinct(), n.where("n <= 15"), none).select("path", "name", "reason")


# ---- sinks

@query("SNK02_line_hash", f"""with {_PATHS} select id, substr(sha256(path || 'tidemark/rule' || (id % 90)), 1, 16) || ':1' as hash, case when id % 4 <= 1 then 'error' when id % 4 = 2 then 'warning' else 'note' end as level from f""")
def snk_hash(spark, sf):
    grade = F.get(F.array(*(F.lit(x) for x in ("critical", "high", "medium", "low"))), (F.col("id") % 4).cast("int"))
    return part_files(spark, sf).select("id", sinks.line_hash(F.col("path"), F.lit("tidemark/rule"), F.col("id") % 90).alias("hash"), sinks.sarif_level(grade).alias("level"))


@query("SNK04_gitlab", f"""with {_PATHS} select id, md5(path || 'SATD' || (id % 90)) fingerprint, case id % 4 when 0 then 'critical' when 1 then 'major' when 2 then 'minor' else 'info' end severity, regexp_replace(path, '^\\./', '') as location, id % 90 as line from f""")
def snk_gitlab(spark, sf):
    grade = F.get(F.array(*(F.lit(x) for x in ("critical", "high", "medium", "low"))), (F.col("id") % 4).cast("int"))
    f = part_files(spark, sf).select("path", F.lit("SATD").alias("type"), grade.alias("severity"), (F.col("id") % 90).alias("line"))
    j = lambda at: F.get_json_object("issue", at)
    issues = sinks.gitlab(f).select("path", j("$.fingerprint").alias("fingerprint"), j("$.severity").alias("severity"), j("$.location.path").alias("location"), j("$.location.lines.begin").cast("bigint").alias("line"))
    return issues.join(part_files(spark, sf), "path").select("id", "fingerprint", "severity", "location", "line")


# ---- rules, sets, orders

_SCORES = "p as (select s_suppkey path, least(10.0, greatest(0.0, s_acctbal / 1000))::double score from supplier)"


def supplier_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 1000)).alias("score"))


@query("RUL03_pre_commit", f"with {_SCORES} select path, score >= 7 safe from p")
def rul_pre_commit(spark, sf):
    return rules.pre_commit(supplier_scores(spark, sf)).select("path", "safe")


@query("RUL11_edit_mode", f"with {FINDINGS} select type, metric * 6 as length, case when type in ('GodClass', 'FeatureEnvy', 'LargeFile', 'DataClumps') then 'fileRewrite' when type in ('MagicNumber', 'SATD', 'TypeSafetyEscape') or metric * 6 < 30 then 'patch' when metric * 6 <= 200 then 'funcRewrite' else 'fileRewrite' end mode, count(*) n from f group by all")
def rul_edit_mode(spark, sf):
    f = findings(spark, sf)[1].select("type", (F.col("metric_value") * 6).alias("length"))
    return f.select("type", "length", rules.edit_mode(F.col("type"), F.col("length")).alias("mode")).groupBy("type", "length", "mode").agg(F.count("*").alias("n"))


@query("SET02_bag_difference", """with a as (select l_orderkey k, list(l_partkey % 9 order by l_linenumber, l_partkey % 9) x from lineitem where l_linenumber <= 3 group by 1), b as (select l_orderkey k, list(l_partkey % 9 order by l_linenumber, l_partkey % 9) x from lineitem where l_linenumber >= 3 group by 1)
select a.k, array_to_string(list_filter(b.x, lambda v: not list_contains(a.x, v)), ',') introduced, array_to_string(list_filter(a.x, lambda v: not list_contains(b.x, v)), ',') fixed from a join b on a.k = b.k""")
def set_bag(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", (F.col("l_partkey") % 9).alias("v"))
    of = lambda some, out: li.where(some).groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "v"))), lambda s: s["v"]).alias(out))
    both = stats.with_difference(of("l_linenumber <= 3", "before").join(of("l_linenumber >= 3", "after"), "k"), "before", "after")
    return both.select("k", F.array_join("introduced", ",").alias("introduced"), F.array_join("fixed", ",").alias("fixed"))


@query("SRT01_worst_first", f"""with {FINDINGS}, r as (select path, type, row_number() over (partition by path order by metric, type) k from (select distinct path, type, metric from f)) select path, type from r where k = 1""")
def srt_first(spark, sf):
    f = findings(spark, sf)[1].select("path", "type", "metric_value").distinct()
    w = Window.partitionBy("path").orderBy("metric_value", "type")
    return f.withColumn("k", F.row_number().over(w)).where("k = 1").select("path", "type")


@query("SCO02_weights", "select type, w from (values " + ", ".join(f"('{k}', {float(v)}::double)" for k, v in sorted(scoring.WEIGHTS.items())) + ") t(type, w)")
def sco_weights(spark, sf):
    kinds = spark.createDataFrame([(k,) for k in scoring.WEIGHTS], "type string")
    return kinds.select("type", scoring.weight_of(F.col("type")).alias("w"))


@query("TMP24_trend_rollup", f"with {_SCORES}, {SUPPLIERS.replace('p as', 'u as')}, b as (select case when score >= 9 then 'healthy' when score >= 4 then 'warning' else 'alert' end label from p) select label, count(*) n from b group by 1")
def tmp_rollup(spark, sf):
    s = supplier_scores(spark, sf)
    return history.rollup(s.withColumn("label", F.when(F.col("score") >= 9, "healthy").when(F.col("score") >= 4, "warning").otherwise("alert")), "label")
