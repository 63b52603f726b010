"""The registered queries over the driver's tables, each with its DuckDB equivalent.

lineitem and orders stand for commit histories, events for sessions, documents for files, labels for defects; see the
README for the roles. Sums of doubles are compared after rounding to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.functions.numeric import js_round, ladder, mid_rank, normal_cdf, pearson
from tidemark.operators import clones, coupling, graph, history, rules, scoring, stats, textsmells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2001-12-01 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 1e6 + 0.5) / 1e6


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def commits(spark: SparkSession, sf: str, path: str = "l_partkey") -> DataFrame:
    """lineitem as commit-file rows: order, part (or supplier), time, lines added."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col(path).alias("path"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    """orders with customers' nations as authors of priority by month."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderpriority").alias("path"), F.col("c_nationkey").alias("author"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("sha"))


PEOPLE = "p as (select o_orderpriority path, c_nationkey author, o_orderdate ts, o_orderkey sha from orders join customer on o_custkey = c_custkey)"
COMMITS = "c as (select l_orderkey sha, l_partkey path, l_shipdate ts, cast(l_quantity as bigint) added, cast(l_linenumber as bigint) deleted from lineitem)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


# ---- history


@query("TMP01_hotspots", f"""with {COMMITS}, e as (select path, sum(added + deleted) churn, count(distinct sha) commits from c where ts >= timestamp '1998-01-01' group by path having count(distinct sha) >= 3),
b as (select e.*, p_size complexity from e join part on p_partkey = path), m as (select greatest(max(churn), 1) mc, greatest(max(complexity), 1) mm from b),
s as (select path, churn, commits, complexity, (churn / mc) * (complexity / mm) score from b, m)
select path, cast(churn as bigint) churn, cast(commits as bigint) commits, cast(complexity as bigint) complexity, floor(score * 1e6 + 0.5) / 1e6 score, case when score > 0.7 then 'critical' else 'warning' end severity from s where score > 0.4 order by s.score desc, path limit 10""")
def hotspots(spark, sf):
    c = commits(spark, sf).where(F.col("ts") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("complexity"))
    return history.hotspots(c, size).select("path", *big("churn", "commits", "complexity"), r6("score").alias("score"), "severity")


@query("TMP02_ranked_hotspots", """with c as (select l_partkey path, count(distinct l_orderkey) commits from lineitem group by 1), b as (select path, commits * p_size score from c join part on p_partkey = path), n as (select count(*) n from b),
r as (select path, score, row_number() over (order by score desc, path) - 1 idx from b)
select path, cast(score as bigint) score, cast(idx as bigint) idx, case when idx / n < 0.01 then 'high' when idx / n < 0.05 then 'medium' else 'low' end severity, cast(floor(idx / n * 100 + 0.5) as bigint) percentile from r, n where idx < greatest(10, ceil(n / 10.0))""")
def ranked_hotspots(spark, sf):
    c = history.change_frequency(commits(spark, sf))
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("cx"))
    return history.ranked_hotspots(c.join(size, "path"), "path", "commits", "cx").select("path", *big("score", "idx"), "severity", *big("percentile"))


@query("TMP07_code_churn", f"""with {COMMITS}, s as (select path, sum(added + deleted) churn from c group by path), r as (select s.path, churn, churn / greatest(coalesce(p_size, 0), 1) * 100.0 rate from s left join part on p_partkey = s.path)
select path, cast(churn as bigint) churn, floor(rate * 1e6 + 0.5) / 1e6 rate, case when rate > 80 then 'high' when rate > 40 then 'medium' when rate > 25 then 'low' end severity from r""")
def code_churn(spark, sf):
    loc = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("loc"))
    return history.code_churn(commits(spark, sf), loc).select("path", *big("churn"), r6("rate").alias("rate"), "severity")


@query("TMP08_congestion", f"with {PEOPLE} select path, count(distinct author) authors, case when count(distinct author) >= 10 then 'high' when count(distinct author) >= 5 then 'medium' when count(distinct author) >= 3 then 'low' end severity from p group by path")
def congestion(spark, sf):
    return history.congestion(people(spark, sf))


@query("TMP09_sprint_congestion", """with m as (select max(ts) t from events), e as (select event_type path, count(distinct user_id) authors from events, m where ts >= t - interval 14 days group by 1)
select path, authors, case when authors >= 5 then 'high' when authors >= 3 then 'medium' end severity from e""")
def sprint_congestion(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("path"), F.col("user_id").alias("author"), "ts")
    last = e.agg(F.max("ts")).first()[0]
    return history.sprint_congestion(e, F.lit(last).cast("timestamp_ntz"))


@query("TMP11_entropy", f"""with {PEOPLE}, n as (select path, author, count(*) n from p group by 1, 2), s as (select path, n / sum(n) over (partition by path) s from n)
select path, floor((case when count(*) <= 1 then 0.0 else least(-sum(s * log2(s)) / log2(count(*)), 1.0) end) * 1e6 + 0.5) / 1e6 entropy from s group by path""")
def entropy(spark, sf):
    return history.entropy(history.commit_shares(people(spark, sf))).select("path", r6("entropy").alias("entropy"))


@query("TMP13_bus_factor", f"""with {PEOPLE}, n as (select path, author, count(*) n from p group by 1, 2), s as (select path, author, n, n / sum(n) over (partition by path) s from n),
h as (select path, s, sum(s) over (partition by path order by s desc, author rows unbounded preceding) held, row_number() over (partition by path order by s desc, author) k from s),
r as (select path, count(*) authors, case when count(*) <= 1 then 0.0 else least(-sum(s * log2(s)) / log2(count(*)), 1.0) end e, coalesce(min(case when held > 0.5 then k end), max(k)) bus_factor from h group by path)
select path, authors, floor(e * 1e6 + 0.5) / 1e6 entropy, bus_factor, e < 0.3 or bus_factor = 1 at_risk from r""")
def bus_factor(spark, sf):
    return history.bus_factor(people(spark, sf)).select("path", "authors", r6("entropy").alias("entropy"), *big("bus_factor"), "at_risk")


@query("TMP12_bus_factor_estimate", f"""with {PEOPLE}, n as (select path, author, count(*) n from p group by 1, 2), s as (select path, author, n / sum(n) over (partition by path) s from n),
h as (select path, sum(s) over (partition by path order by s desc, author rows unbounded preceding) held, row_number() over (partition by path order by s desc, author) k from s)
select path, coalesce(min(case when held > 0.5 then k end), max(k)) bus_factor from h group by path""")
def bus_factor_estimate(spark, sf):
    return history.bus_factor_estimate(history.commit_shares(people(spark, sf))).select("path", *big("bus_factor"))


@query("TMP10_knowledge_loss", f"""with {PEOPLE}, q as (select *, row_number() over (partition by path order by ts desc, sha desc) - 1 seq from p), g as (select path, author, count(*) dl, min(seq) f, max(seq) l from q group by 1, 2),
d as (select path, author, greatest(0.0, 3.293 * (case when l = max(l) over (partition by path) then 1.0 else 0.0 end) + 0.998 * dl - 0.321 * greatest(count(*) over (partition by path order by f) - 1 - 1, 0)) doa from g),
s as (select path, author, doa / sum(doa) over (partition by path) s from d), h as (select path, s, sum(s) over (partition by path order by s desc, author rows unbounded preceding) held, row_number() over (partition by path order by s desc, author) k from s)
select path, floor(max(s) * 1e6 + 0.5) / 1e6 owner_share, coalesce(min(case when held >= 0.5 then k end), max(k)) bus_factor, max(s) >= 0.8 at_risk from h group by path""")
def knowledge_loss(spark, sf):
    from pyspark.sql import Window

    p = people(spark, sf).withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("sha"))) - 1)
    return history.knowledge_loss(p).select("path", r6("owner_share").alias("owner_share"), *big("bus_factor"), "at_risk")


@query("TMP14_knowledge_loss_index", """with b as (select l_partkey path, l_suppkey author, cast(sum(l_quantity) as bigint) lines from lineitem group by 1, 2), a as (select distinct l_suppkey author from lineitem where l_shipdate >= timestamp '2001-06-01'),
r as (select path, sum(case when a.author is null then lines else 0 end) lost, sum(lines) total from b left join a on a.author = b.author group by path)
select path, cast(lost as bigint) lost, cast(total as bigint) total, floor(lost / greatest(total, 1) * 1e6 + 0.5) / 1e6 as "index", case when lost / greatest(total, 1) >= 0.4 then 'high' when lost / greatest(total, 1) >= 0.2 then 'medium' end severity, lost / greatest(total, 1) > 0.4 orphaned from r""")
def knowledge_loss_index(spark, sf):
    li = table(spark, sf, "lineitem")
    blame = li.groupBy(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author")).agg(F.sum("l_quantity").cast("bigint").alias("lines"))
    active = li.where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).select(F.col("l_suppkey").alias("author"))
    return history.knowledge_loss_index(blame, active).select("path", *big("lost", "total"), r6("index").alias("index"), "severity", "orphaned")


@query("TMP15_trend", """with m as (select o_orderpriority path, cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) x, count(*) y from orders group by 1, 2)
select path, floor(coalesce(regr_slope(y, x), 0) * 1e6 + 0.5) / 1e6 slope, count(*) points, case when coalesce(regr_slope(y, x), 0) > 0.1 then 'rising' when coalesce(regr_slope(y, x), 0) < -0.1 then 'declining' else 'stable' end trend from m group by path""")
def trend(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("path"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("x")).agg(F.count("*").alias("y"))
    return history.trend(m, "path", "x", "y").select("path", r6("slope").alias("slope"), "points", "trend")


@query("TMP17_complexity_trend", """with v as (select l_partkey path, l_quantity cc, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_quantity) - 1 i, count(*) over (partition by l_partkey) n from lineitem),
s as (select * from v where n <= 5 or i in (floor(0 * (n - 1) / 4 + 0.5), floor(1 * (n - 1) / 4 + 0.5), floor(2 * (n - 1) / 4 + 0.5), floor(3 * (n - 1) / 4 + 0.5), floor(4 * (n - 1) / 4 + 0.5)))
select path, floor(coalesce(regr_slope(cc, i), 0) * 1e6 + 0.5) / 1e6 slope, count(*) points from s group by path""")
def complexity_trend(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("seq"), F.col("l_quantity").alias("cc"))
    return history.complexity_trend(v).select("path", r6("slope").alias("slope"), "points")


@query("TMP16_sample_points", "select cast(i as bigint) i from unnest([0, 25, 50, 74, 99]) t(i)")
def sample_points(spark, sf):
    return spark.createDataFrame([(i,) for i in history.sample_points(100, 5)], "i bigint")


@query("TMP18_decay_index", """with d as (select s_suppkey path, least(10.0, greatest(0.0, s_acctbal / 1000)) a, least(10, s_nationkey % 11) b, s_suppkey % 7 c, s_nationkey % 5 d, s_suppkey % 3 e from supplier), x as (select path, 0::double + 0.35::double * a + 0.25::double * b + 0.2::double * c + 0.1::double * d + 0.1::double * e v from d)
select path, floor(v * 1e6 + 0.5) / 1e6 decay, case when v < 3 then 'healthy' when v < 6 then 'warning' when v < 8 then 'degraded' else 'critical' end band from x""")
def decay_index(spark, sf):
    s = table(spark, sf, "supplier")
    d = s.select(F.col("s_suppkey").alias("path"), (F.col("s_acctbal") / 1000).alias("a"), (F.col("s_nationkey") % 11).alias("b"), (F.col("s_suppkey") % 7).alias("c"), (F.col("s_nationkey") % 5).alias("d"), (F.col("s_suppkey") % 3).alias("e"))
    return history.decay_index(d, ("a", "b", "c", "d", "e")).select("path", r6("decay").alias("decay"), "band")


@query("TMP19_change_frequency", "select l_partkey path, count(distinct l_orderkey) commits from lineitem where l_shipdate >= timestamp '2000-12-01' group by 1")
def change_frequency(spark, sf):
    return history.change_frequency(history.since(commits(spark, sf), "2001-12-01 00:00:00", 365))


@query("MTH01_complexity_score", "select p_partkey path, floor((p_size + length(p_name) + log10(greatest(p_retailprice, 1))) * 1e6 + 0.5) / 1e6 score from part")
def complexity_score(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("path"), r6(history.complexity_score(F.col("p_size"), F.length("p_name"), F.col("p_retailprice"))).alias("score"))


# ---- co-change

SUPPLIED = "one as (select distinct l_orderkey g, l_suppkey x from lineitem)"


@query("JN01_pairs", f"with {SUPPLIED} select a.x a, b.x b, count(*) together from one a join one b on a.g = b.g and a.x < b.x group by 1, 2")
def pairs(spark, sf):
    return coupling.together(commits(spark, sf, "l_suppkey"), "sha", "path")


@query("TMP03_temporal_coupling", f"""with {SUPPLIED}, m as (select * from one where g in (select g from one group by g having count(*) >= 2)), t as (select x, count(*) n from m group by x), c as (select a.x a, b.x b, count(*) together from m a join m b on a.g = b.g and a.x < b.x group by 1, 2 having count(*) >= 3),
s as (select a, b, together, together / least(ta.n, tb.n) v from c join t ta on ta.x = a join t tb on tb.x = b)
select a, b, together, floor(v * 1e6 + 0.5) / 1e6 strength, case when v > 0.7 then 'high' when v > 0.5 then 'medium' else 'low' end severity from s where v >= 0.02""")
def temporal_coupling(spark, sf):
    return coupling.temporal_coupling(commits(spark, sf, "l_suppkey"), least=0.02, other_module=False).withColumn("strength", r6("strength"))


@query("TMP04_file_coupling", f"""with {SUPPLIED}, t as (select x, count(*) n from one group by x), c as (select a.x a, b.x b, count(*) together from one a join one b on a.g = b.g and a.x < b.x group by 1, 2),
s as (select a, b, together, together / greatest(ta.n, tb.n) v from c join t ta on ta.x = a join t tb on tb.x = b)
select a, b, together, floor(v * 1e6 + 0.5) / 1e6 strength, case when v >= 0.7 then 'high' when v >= 0.5 then 'medium' else 'low' end severity from s where v >= 0.02""")
def file_coupling(spark, sf):
    return coupling.file_coupling(commits(spark, sf, "l_suppkey"), least=0.02).withColumn("strength", r6("strength"))


@query("WIN07_stability", f"""with {SUPPLIED}, g as (select g, row_number() over (order by g) - 1 i from (select distinct g from one)), n as (select count(*) n from g), p as (select x, o.g, case when i < n // 3 then 'early' when i >= n - n // 3 then 'late' end part from one o join g on g.g = o.g, n), q as (select * from p where part is not null),
t as (select part, x, count(*) n from q group by 1, 2), c as (select a.part, a.x a, b.x b, count(*) k from q a join q b on a.g = b.g and a.x < b.x group by 1, 2, 3), s as (select c.part, a, b, k / greatest(ta.n, tb.n) v from c join t ta on ta.x = a and ta.part = c.part join t tb on tb.x = b and tb.part = c.part)
select a, b, floor(coalesce(max(case when part = 'early' then v end), 0) * 1e6 + 0.5) / 1e6 early, floor(coalesce(max(case when part = 'late' then v end), 0) * 1e6 + 0.5) / 1e6 late,
case when coalesce(max(case when part = 'late' then v end), 0) - coalesce(max(case when part = 'early' then v end), 0) > 0.1 then 'tightening' when coalesce(max(case when part = 'late' then v end), 0) - coalesce(max(case when part = 'early' then v end), 0) < -0.1 then 'loosening' else 'stable' end stability from s group by 1, 2""")
def stability(spark, sf):
    return coupling.stability(commits(spark, sf, "l_suppkey"), "sha", chronological=True).select("a", "b", r6("early").alias("early"), r6("late").alias("late"), "stability")


@query("JN04_changed_methods", """with h as (select l_suppkey % 10 path, l_orderkey % 50 sha, l_linenumber * 10 s, l_linenumber * 10 + cast(l_quantity as int) e from lineitem), m as (select s_suppkey % 10 path, s_suppkey // 2 sha, s_name "name", s_nationkey * 4 line, 6 length from supplier)
select distinct m.sha, m.path, m.name, cast(m.line as bigint) line from m join h on h.sha = m.sha and h.path = m.path where h.e >= m.line and h.s <= m.line + m.length - 1""")
def changed_methods(spark, sf):
    h = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("path"), (F.col("l_orderkey") % 50).alias("sha"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"))
    m = table(spark, sf, "supplier").select((F.col("s_suppkey") % 10).alias("path"), F.floor(F.col("s_suppkey") / 2).alias("sha"), F.col("s_name").alias("name"), (F.col("s_nationkey") * 4).alias("line"), F.lit(6).alias("length"))
    return coupling.changed_methods(h, m).select("sha", "path", "name", *big("line"))


# ---- scores

# A finding for each line item: its return flag, ship mode of quantity and discount choose the type.
KINDS = ["ComplexMethod", "DeepNesting", "SATD", "MagicNumber", "GodClass", "BrainMethod", "SqlInjectionRisk", "DuplicateCode", "LargeMethod", "TidyOpportunity"]
_W = "case type " + " ".join(f"when '{k}' then {scoring.WEIGHTS[k]}" for k in KINDS) + " end"
_KIND = "case (l_partkey + l_linenumber) % 10 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
FINDINGS = f"f as (select l_suppkey * 1000 + l_orderkey % 100 path, {_KIND} as type, cast(l_quantity as double) metric from lineitem)"
SUPPLIERS = "p as (select distinct l_suppkey * 1000 + l_orderkey % 100 path from lineitem)"


def findings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem")
    path = (F.col("l_suppkey") * 1000 + F.col("l_orderkey") % 100).alias("path")
    kind = F.get(F.array(*(F.lit(k) for k in KINDS)), ((F.col("l_partkey") + F.col("l_linenumber")) % 10).cast("int"))
    f = li.select(path, kind.alias("type"), F.col("l_quantity").alias("metric_value"), F.col("l_linenumber").alias("line"), F.when(F.col("l_quantity") < 2, "critical").when(F.col("l_quantity") < 4, "high").when(F.col("l_quantity") < 7, "medium").otherwise("low").alias("severity"), F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).alias("function_name"))
    return li.select(path).distinct(), f


@query("SCO08_raw_score", f"with {FINDINGS}, {SUPPLIERS}, n as (select path, type, count(*) n from f group by 1, 2), s as (select path, sum({_W} * sqrt(n)) v, sum(n) k from n group by 1) select p.path, cast(coalesce(k, 0) as bigint) smells, floor((10.0 - coalesce(v, 0)) * 1e6 + 0.5) / 1e6 raw from p left join s on s.path = p.path")
def raw_score(spark, sf):
    return scoring.score(*findings(spark, sf)).select("path", "smells", r6("raw").alias("raw"))


@query("SCO04_subscores", f"""with {FINDINGS}, {SUPPLIERS}, n as (select path, type, avg(case when type = 'ComplexMethod' and metric >= 15 and metric < 25 then 1.0 else {_W} end) w, count(*) n from f group by 1, 2),
s as (select path, sum(case when type in ('SqlInjectionRisk') then w * sqrt(n) else 0 end) a, sum(case when type in ('ComplexMethod', 'DeepNesting', 'BrainMethod') then w * sqrt(n) else 0 end) b, sum(case when type in ('GodClass', 'LargeMethod', 'SATD') then w * sqrt(n) else 0 end) c, sum(case when type = 'DuplicateCode' then w * sqrt(n) else 0 end) d from n group by 1)
select p.path, floor(greatest(1.0, 10 - coalesce(a, 0)) * 1e6 + 0.5) / 1e6 security, floor(greatest(1.0, 10 - coalesce(b, 0)) * 1e6 + 0.5) / 1e6 complexity, floor(greatest(1.0, 10 - coalesce(c, 0)) * 1e6 + 0.5) / 1e6 maintainability, floor(greatest(1.0, 10 - coalesce(d, 0)) * 1e6 + 0.5) / 1e6 duplication from p left join s on s.path = p.path""")
def subscores(spark, sf):
    return scoring.subscores(*findings(spark, sf), rounded=False).select("path", *(r6(d).alias(d) for d in scoring.DIMENSIONS))


@query("SCO05_co_occurrence", f"""with {FINDINGS}, g as (select path, max(case when type = 'GodClass' then 1 else 0 end) * max(case when type = 'BrainMethod' then 1 else 0 end) b from f group by 1)
select distinct f.path, f.type, floor((case when type = 'GodClass' and b = 1 then {_W} * 1.2 else {_W} end) * 1e6 + 0.5) / 1e6 weight from f join g on g.path = f.path""")
def co_occurrence(spark, sf):
    return scoring.co_occurrence(findings(spark, sf)[1]).select("path", "type", r6("weight").alias("weight"))


@query("SCO06_calibration", """with d as (select 1 + 9 * least(n_chars, 20000) / 20000.0 s, quality q from documents join labels on labels.doc_id = documents.doc_id), b as (select greatest(0, least(9, floor((s - 1) / 0.9))) as bin, s, q from d)
select cast(bin as bigint) as bin, count(*) n, floor(avg(s) / 10 * 1e6 + 0.5) / 1e6 predicted, floor(avg(q) * 1e6 + 0.5) / 1e6 observed from b group by 1""")
def calibration(spark, sf):
    d = labelled(spark, sf).withColumn("s", 1 + 9 * F.least(F.col("n_chars"), F.lit(20000)) / 20000.0)
    return scoring.calibration_error(d, "s", "quality").select("bin", "n", r6("predicted").alias("predicted"), r6("observed").alias("observed"))


@query("SCO06_ece", """with d as (select 1 + 9 * least(n_chars, 20000) / 20000.0 s, quality q from documents join labels on labels.doc_id = documents.doc_id), b as (select greatest(0, least(9, floor((s - 1) / 0.9))) as bin, count(*) n, avg(s) / 10 p, avg(q) o from d group by 1) select floor(sum(n * abs(p - o)) / sum(n) * 1e6 + 0.5) / 1e6 ece from b""")
def ece(spark, sf):
    d = labelled(spark, sf).withColumn("s", 1 + 9 * F.least(F.col("n_chars"), F.lit(20000)) / 20000.0)
    return scoring.expected_calibration_error(scoring.calibration_error(d, "s", "quality")).select(r6("ece").alias("ece"))


@query("SCO07_iso5055", f"with {FINDINGS}, {SUPPLIERS}, n as (select path, type, count(*) n from f group by 1, 2), s as (select path, sum(case when type in ('SqlInjectionRisk') then 1.5 * sqrt(n) else 0 end) a, sum(case when type in ('SATD', 'TidyOpportunity') then (case type when 'SATD' then 0.6 else 0.5 end) * sqrt(n) else 0 end) b from n group by 1) select p.path, floor(greatest(1.0, 10 - coalesce(a, 0)) * 1e6 + 0.5) / 1e6 security, floor(greatest(1.0, 10 - coalesce(b, 0)) * 1e6 + 0.5) / 1e6 maintainability from p left join s on s.path = p.path")
def iso5055(spark, sf):
    out = scoring.iso5055(*findings(spark, sf), {"security": ("SqlInjectionRisk",), "maintainability": ("SATD", "TidyOpportunity")})
    return out.select("path", r6("security").alias("security"), r6("maintainability").alias("maintainability"))


@query("PRJ03_categorize", "select s_suppkey path, case when s_acctbal / 1000 >= 9 then 'green' when s_acctbal / 1000 >= 6 then 'yellow' else 'red' end category from supplier")
def categorize(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), scoring.categorize(F.col("s_acctbal") / 1000).alias("category"))


# ---- rules


@query("PRJ08_new_findings", """with f as (select l_suppkey path, l_returnflag as type, case when l_tax > 0.04 then l_linestatus end fn, l_shipdate d from lineitem), b as (select distinct path, type, fn from f where d < timestamp '1996-01-01'), a as (select * from f where d >= timestamp '2001-06-01')
select a.path, a.type, a.fn function_name, count(*) n from a where not exists (select 1 from b where b.path = a.path and b.type = a.type and b.fn is not distinct from a.fn) group by 1, 2, 3""")
def new_findings(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_returnflag").alias("type"), F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).alias("function_name"), "l_shipdate")
    old, new = f.where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")), f.where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    return rules.new_findings(old, new).groupBy("path", "type", "function_name").agg(F.count("*").alias("n"))


@query("PRJ07_without_redundant", f"""with f as (select l_suppkey * 1000 + l_orderkey % 100 path, {_KIND} as type, case when l_tax > 0.04 then l_linestatus end fn from lineitem), h as (select distinct path, fn from f where type in ('ComplexMethod', 'DeepNesting', 'LargeMethod', 'BrainMethod'))
select path, type, count(*) n from f where not (type = 'TidyOpportunity' and exists (select 1 from h where h.path = f.path and h.fn is not distinct from f.fn)) group by 1, 2""")
def without_redundant(spark, sf):
    return rules.without_redundant(findings(spark, sf)[1]).groupBy("path", "type").agg(F.count("*").alias("n"))


@query("JN14_change_set", """with b as (select c_nationkey path, avg(c_acctbal) / 1000 score from customer group by 1), a as (select s_nationkey path, avg(s_acctbal) / 1000 score from supplier group by 1)
select coalesce(a.path, b.path) path, case when b.score is null then case when a.score < 7 then 'new_unhealthy' else 'new' end when a.score is null then 'removed' when a.score - b.score < -0.5 then 'regression' when a.score - b.score > 0.5 then 'improvement' else 'unchanged' end change from b full join a on a.path = b.path""")
def change_set(spark, sf):
    return rules.change_set(*_two_scores(spark, sf)).select("path", "change")


def _two_scores(spark, sf):
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("path")).agg((F.avg("c_acctbal") / 1000).alias("score"))
    a = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("path")).agg((F.avg("s_acctbal") / 1000).alias("score"))
    return b, a


@query("RUL04_overall_safe", """with b as (select c_nationkey path, avg(c_acctbal) / 1000 score from customer group by 1), a as (select s_nationkey path, avg(s_acctbal) / 1000 score from supplier group by 1), c as (select case when b.score is null then a.score < 7 else coalesce(a.score - b.score < -0.5, false) end bad, b.score is not null and coalesce(a.score - b.score < -0.5, false) reg from b full join a on a.path = b.path)
select bool_and(not bad) safe, count(*) filter (where reg) regressions from c""")
def overall_safe(spark, sf):
    return rules.overall_safe(rules.change_set(*_two_scores(spark, sf)))


@query("RUL01_gate", f"""with {FINDINGS}, b as (select path, max(case when type = 'SqlInjectionRisk' then 1 else 0 end) sec from f group by 1), s as (select path, 10 - path % 7 before, 10 - path % 5 * 1.2 after from b)
select s.path, cast(before as double) before, cast(after as double) after, case when sec = 1 or after < 6 or after - before < -0.05 then 'deny' else 'allow' end decision, case when sec = 1 then 'new_security' when after < 6 then 'below_floor' when after - before < -0.05 then 'score_drop' else 'ok' end reason from s join b on b.path = s.path""")
def gate(spark, sf):
    f = findings(spark, sf)[1]
    s = f.select("path").distinct().select("path", (10.0 - F.col("path") % 7).alias("before"), (10.0 - F.col("path") % 5 * 1.2).alias("after"))
    return rules.gate(s, f)


@query("RUL05_verdict", f"""with f as (select l_suppkey * 1000 + l_orderkey % 100 path, {_KIND} as type, l_linenumber line, case when l_quantity < 2 then 3 when l_quantity < 4 then 2 when l_quantity < 7 then 1 else 0 end r from lineitem), {SUPPLIERS},
w as (select path, type, r, row_number() over (partition by path order by r desc, line, type) k from f)
select p.path, cast(10 - p.path % 7 as double) score, 10 - p.path % 7 >= 9.5 loop_complete, type next_type, case r when 3 then 'critical' when 2 then 'high' when 1 then 'medium' when 0 then 'low' end next_severity from p left join (select * from w where k = 1) w on w.path = p.path""")
def verdict(spark, sf):
    p, f = findings(spark, sf)
    return rules.verdict(p.withColumn("score", 10.0 - F.col("path") % 7), f)


@query("RUL06_business_case", "with s as (select s_suppkey path, s_acctbal / 1000 score from supplier), g as (select path, score, greatest(0.0, 9.5 - score) gain from s) select path, floor(gain * 1e6 + 0.5) / 1e6 gain, floor(gain * 4 * 1e6 + 0.5) / 1e6 saving_percent, case when gain > 2 then 'high' when gain > 0.5 then 'medium' else 'low' end priority from g")
def business_case(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_acctbal") / 1000).alias("score"))
    return rules.business_case(s).select("path", r6("gain").alias("gain"), r6("saving_percent").alias("saving_percent"), "priority")


@query("RUL09_audit_penalty", "select l_suppkey * 1000 + l_orderkey % 100 path, floor(sum(case when l_quantity < 4 then 0.3 when l_quantity < 7 then 0.15 else 0.05 end) * 1e6 + 0.5) / 1e6 penalty from lineitem group by 1")
def audit_penalty(spark, sf):
    return rules.audit_penalty(findings(spark, sf)[1]).select("path", r6("penalty").alias("penalty"))


@query("RUL10_pick_worst", f"""with f as (select l_suppkey * 1000 + l_orderkey % 100 path, {_KIND} as type, case when l_quantity < 2 then 3 when l_quantity < 4 then 2 when l_quantity < 7 then 1 else 0 end r from lineitem), g as (select path, type, count(*) n, max(r) rank, {_W} w from f group by 1, 2),
k as (select *, w * (sqrt(n) - sqrt(n - 1)) gain, row_number() over (partition by path order by rank desc, w * (sqrt(n) - sqrt(n - 1)) desc, type) k from g) select path, type, n, cast(rank as bigint) rank, floor(gain * 1e6 + 0.5) / 1e6 gain from k where k = 1""")
def pick_worst(spark, sf):
    return rules.pick_worst(findings(spark, sf)[1]).select("path", "type", "n", *big("rank"), r6("gain").alias("gain"))


# ---- statistics


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id").withColumn("bug", 1 - F.col("quality"))


LABELLED = "d as (select documents.doc_id, lang, n_chars, quality, toxic, 1 - quality bug from documents join labels on labels.doc_id = documents.doc_id)"


@query("STA01_pearson", f"with {LABELLED} select floor(corr(n_chars, quality) * 1e6 + 0.5) / 1e6 r from d")
def sta_pearson(spark, sf):
    return stats.pearson_correlation(labelled(spark, sf), "n_chars", "quality").select(r6("r").alias("r"))


RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"


@query("STA02_spearman", f"with {LABELLED}, r as (select {RANK.format('n_chars')} a, {RANK.format('quality')} b from d) select floor(corr(a, b) * 1e6 + 0.5) / 1e6 rho from r")
def sta_spearman(spark, sf):
    return stats.spearman_correlation(labelled(spark, sf), "n_chars", "quality").select(r6("rho").alias("rho"))


@query("STA03_auroc", f"with {LABELLED}, r as (select bug, {RANK.format('n_chars')} k from d), s as (select sum(bug) p, count(*) - sum(bug) q, sum(bug * k) r from r) select cast(p as bigint) positives, cast(q as bigint) negatives, floor((1 - (r - p * (p + 1) / 2) / (p * q)) * 1e6 + 0.5) / 1e6 auroc from s")
def sta_auroc(spark, sf):
    return stats.auroc(labelled(spark, sf), "n_chars", "bug").select("positives", "negatives", r6("auroc").alias("auroc"))


@query("STA08_auroc_by_language", f"with {LABELLED}, r as (select lang, bug, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 k from d), s as (select lang, sum(bug) p, count(*) - sum(bug) q, sum(bug * k) r from r group by 1) select lang, cast(p as bigint) positives, cast(q as bigint) negatives, floor((case when p > 0 and q > 0 then 1 - (r - p * (p + 1) / 2) / (p * q) else 0.5 end) * 1e6 + 0.5) / 1e6 auroc from s")
def sta_auroc_by(spark, sf):
    return stats.auroc(labelled(spark, sf), "n_chars", "bug", "lang").select("lang", "positives", "negatives", r6("auroc").alias("auroc"))


@query("STA04_mann_whitney", f"with {LABELLED}, r as (select bug, n_chars, {RANK.format('n_chars')} k from d), t as (select sum(cast(c as double) ** 3 - c) t from (select count(*) c from d group by n_chars)), s as (select cast(sum(bug) as double) p, cast(count(*) - sum(bug) as double) q, sum(bug * k) r from r), u as (select p, q, least(r - p * (p + 1) / 2, p * q - (r - p * (p + 1) / 2)) u from s) select u, floor(least((u - p * q / 2 + 0.5) / sqrt(p * q / 12 * ((p + q + 1) - t / ((p + q) * (p + q - 1)))), 0) * 1e6 + 0.5) / 1e6 z from u, t")
def sta_mann_whitney(spark, sf):
    return stats.mann_whitney(labelled(spark, sf), "n_chars", "bug").select("u", r6("z").alias("z"))


@query("STA06_delong", f"""with d as (select n_chars a, documents.doc_id % 997 b, quality l from documents join labels on labels.doc_id = documents.doc_id), z as (select l, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 za, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 zb, rank() over (partition by l order by a) + (count(*) over (partition by l, a) - 1) / 2.0 ta, rank() over (partition by l order by b) + (count(*) over (partition by l, b) - 1) / 2.0 tb, sum(l) over () p, count(*) over () - sum(l) over () n from d),
v as (select l, case when l = 1 then (za - ta) / n else 1 - (za - ta) / p end va, case when l = 1 then (zb - tb) / n else 1 - (zb - tb) / p end vb from z), s as (select l, avg(va) ma, avg(vb) mb, (var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb)) / count(*) v from v group by l)
select floor(max(case when l = 1 then ma end) * 1e6 + 0.5) / 1e6 auc_a, floor(max(case when l = 1 then mb end) * 1e6 + 0.5) / 1e6 auc_b, floor((max(case when l = 1 then ma end) - max(case when l = 1 then mb end)) / sqrt(sum(v)) * 1e6 + 0.5) / 1e6 z from s""")
def sta_delong(spark, sf):
    d = labelled(spark, sf).withColumn("b", F.col("doc_id") % 997)
    return stats.delong(d, "n_chars", "b", "quality").select(r6("auc_a").alias("auc_a"), r6("auc_b").alias("auc_b"), r6("z").alias("z"))


@query("STA07_roc_thresholds", f"""with {LABELLED}, n as (select lang, sum(bug) p, count(*) - sum(bug) q, quantile_cont(n_chars, 0.9) p90 from d group by 1 having sum(bug) >= 5 and count(*) - sum(bug) >= 5), b as (select lang, n_chars, sum(bug) p, count(*) m from d group by 1, 2),
c as (select lang, n_chars, sum(p) over (partition by lang order by n_chars desc) tp, sum(m - p) over (partition by lang order by n_chars desc) fp from b), j as (select c.lang, n_chars, tp / n.p - fp / n.q j, p90 from c join n on n.lang = c.lang), k as (select *, row_number() over (partition by lang order by j desc, n_chars desc) k from j)
select lang, n_chars threshold, floor(j * 1e6 + 0.5) / 1e6 youden, floor(p90 * 1e6 + 0.5) / 1e6 p90 from k where k = 1""")
def sta_thresholds(spark, sf):
    return stats.roc_thresholds(labelled(spark, sf), "n_chars", "bug", "lang").select("lang", "threshold", r6("youden").alias("youden"), r6("p90").alias("p90"))


@query("STA09_validation", f"with {LABELLED}, r as (select bug, {RANK.format('n_chars')} k from d), s as (select sum(bug) p, count(*) - sum(bug) q, sum(bug * k) r from r), a as (select 1 - (r - p * (p + 1) / 2) / (p * q) a from s) select count(*) n, cast(sum(bug) as bigint) positives, floor(avg(case when bug = 1 then n_chars end) * 1e6 + 0.5) / 1e6 mean_pos, floor(avg(case when bug = 0 then n_chars end) * 1e6 + 0.5) / 1e6 mean_neg, floor(corr(n_chars, bug) * 1e6 + 0.5) / 1e6 r, floor(max(a) * 1e6 + 0.5) / 1e6 auroc from d, a")
def sta_report(spark, sf):
    return stats.validation_report(labelled(spark, sf), "n_chars", "bug").select("n", "positives", *(r6(x).alias(x) for x in ("mean_pos", "mean_neg", "r", "auroc")))


@query("STA10_sweep", f"with {LABELLED}, t as (select unnest([10.0, 500.0, 1000.0, 2000.0, 4000.0]) threshold), s as (select threshold, count(*) filter (where n_chars > threshold and bug = 1) tp, count(*) filter (where n_chars > threshold and bug = 0) fp, count(*) filter (where n_chars <= threshold and bug = 1) fn from d, t group by 1) select cast(threshold as double) threshold, tp, fp, fn, floor(2.0 * tp / greatest(2 * tp + fp + fn, 1) * 1e6 + 0.5) / 1e6 f1 from s")
def sta_sweep(spark, sf):
    return stats.threshold_sweep(labelled(spark, sf), "n_chars", "bug", (10, 500, 1000, 2000, 4000)).withColumn("f1", r6("f1"))


@query("STA11_baseline", "select lang, floor(avg(n_chars) * 1e3 + 0.5) / 1e3 mean, floor(case when count(n_chars) < 2 then 0 else stddev_pop(n_chars) end * 1e3 + 0.5) / 1e3 sd from documents group by 1")
def sta_baseline(spark, sf):
    return stats.baseline(table(spark, sf, "documents"), "n_chars", "lang").select("lang", (F.floor(F.col("mean") * 1e3 + 0.5) / 1e3).alias("mean"), (F.floor(F.col("sd") * 1e3 + 0.5) / 1e3).alias("sd"))


@query("STA12_outliers", "with b as (select avg(c_acctbal) m, stddev_pop(c_acctbal) s from customer) select c_custkey, c_acctbal from customer, b where c_acctbal < m - 1.5 * s")
def sta_outliers(spark, sf):
    return stats.outliers(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1.5)


@query("STA15_telemetry", """with e as (select event_type, user_id % 5 g, value p, value * 0.9 + event_id % 7 a from events) select event_type smell_type, g as language, count(*) n, floor(avg(p) * 1e6 + 0.5) / 1e6 mean_predicted, floor(avg(abs(p - a)) * 1e6 + 0.5) / 1e6 mae, floor(quantile_disc(abs(p - a), 0.5) * 1e6 + 0.5) / 1e6 p50, floor(quantile_disc(abs(p - a), 0.9) * 1e6 + 0.5) / 1e6 p90 from e group by 1, 2""")
def sta_telemetry(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("smell_type"), (F.col("user_id") % 5).alias("language"), F.col("value").alias("predicted_delta"), (F.col("value") * 0.9 + F.col("event_id") % 7).alias("actual_delta"))
    return stats.telemetry_aggregates(e).select("smell_type", "language", "n", *(r6(x).alias(x) for x in ("mean_predicted", "mae", "p50", "p90")))


@query("STA14_model_stats", """with l as (select event_type m, value - 40 d, user_id % 4 s from events), b as (select m, count(*) runs, avg(d) mean, stddev_pop(d) sd, avg(case when d >= 0 then 1.0 else 0.0 end) pass from l group by 1)
select m model_name, runs, floor(mean * 1e6 + 0.5) / 1e6 mean_delta, floor(sd * 1e6 + 0.5) / 1e6 sd_delta, floor(pass * 1e6 + 0.5) / 1e6 pass_rate from b""")
def sta_models(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("model_name"), (F.col("value") - 40).alias("delta"), F.array((F.col("user_id") % 4).cast("string")).alias("smells_introduced"))
    return stats.model_stats(e).select("model_name", "runs", *(r6(x).alias(x) for x in ("mean_delta", "sd_delta", "pass_rate")))


@query("ARR01_top_n", "select user_id, count(*) n from events group by 1 order by n desc, user_id limit 5")
def top_n(spark, sf):
    return stats.top_n(table(spark, sf, "events"), "user_id", 5)


@query("WIN02_mid_rank", "select c_custkey, rank() over (partition by c_mktsegment order by c_nationkey) + (count(*) over (partition by c_mktsegment, c_nationkey) - 1) / 2.0 r from customer")
def win_mid_rank(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", mid_rank("c_nationkey", "c_mktsegment").alias("r"))


# ---- graph

# An edge for each pair of nations that trades in more line items than a pair does on average.
TRADE = """t as (select s_nationkey src, c_nationkey dst, count(*) n from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey where s_nationkey <> c_nationkey group by 1, 2),
e as (select src, dst from t where n > (select avg(n) from t))"""


def trade(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c, s = (table(spark, sf, x) for x in ("lineitem", "orders", "customer", "supplier"))
    e = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = e.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    return graph.dependency_edges(pairs.join(pairs.agg(F.avg("n").alias("mean"))).where("n > mean"), "s_nationkey", "c_nationkey")


REACH = f"with recursive {TRADE}, r(src, dst) as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src), n as (select src node from e union select dst from e)"


@query("ARC01_edges", f"with {TRADE} select src, dst from e")
def edges(spark, sf):
    return trade(spark, sf)


@query("ARC02_degrees", f"with {TRADE}, x as (select src node, 0 i, 1 o from e union all select dst, 1, 0 from e) select node, cast(sum(i) as bigint) fan_in, cast(sum(o) as bigint) fan_out, floor(sum(o) / (sum(i) + sum(o)) * 1e6 + 0.5) / 1e6 instability from x group by 1")
def degrees(spark, sf):
    return graph.degrees(trade(spark, sf)).withColumn("instability", r6("instability"))


@query("ARC03_propagation", f"{REACH}, d as (select dst node, count(*) d from r where src <> dst group by 1) select n.node, coalesce(d, 0) dependants, floor(coalesce(d, 0) / (select count(*) from n) * 1e6 + 0.5) / 1e6 as cost from n left join d on d.node = n.node")
def propagation(spark, sf):
    return graph.propagation_cost(trade(spark, sf)).withColumn("cost", r6("cost"))


@query("ARC04_components", f"{REACH}, b as (select a.src node, min(a.dst) c from r a join r z on z.src = a.dst and z.dst = a.src group by 1) select n.node, least(n.node, coalesce(c, n.node)) component from n left join b on b.node = n.node")
def strong(spark, sf):
    return graph.strong_components(trade(spark, sf))


@query("ARC06_cycles", f"{REACH}, b as (select a.src node, min(a.dst) c from r a join r z on z.src = a.dst and z.dst = a.src group by 1), k as (select least(node, c) component from b) select component, count(*) size, case when count(*) > 5 then 'high' else 'medium' end severity from k group by 1 having count(*) > 1")
def cycle_list(spark, sf):
    return graph.cycles(graph.strong_components(trade(spark, sf))).select("component", "size", "severity")


@query("JN06_dead_exports", "select p_partkey path, p_brand as name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def dead_exports(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("name"))
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("path")).distinct()
    return graph.dead_exports(e, e.join(used, "path"))


# ---- duplicates

WINDOWS = """l as (select doc_id path, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) l from documents), i as (select path, l, unnest(range(1, len(l) - 4)) s from l where len(l) >= 6),
b as (select path, s as start, array_to_string(list_filter(l[s:s + 5], lambda x: x <> ''), chr(10)) b from i), w as (select path, start, sha1(b) hash from b where b <> '')"""


@query("DUP01_windows", f"with {WINDOWS} select path, cast(start as int) as start, hash from w")
def dup_windows(spark, sf):
    return clones.windows(files(spark, sf))


@query("DUP05_shared_windows", f"with {WINDOWS} select hash, count(distinct path) files, count(*) places from w group by 1 having count(distinct path) > 1")
def dup_shared(spark, sf):
    return clones.shared_windows(clones.windows(files(spark, sf)))


@query("JN10_cross_file_pairs", f"with {WINDOWS} select x.path a, x.start a_start, y.path b, y.start b_start from w x join w y on x.hash = y.hash and x.path < y.path")
def dup_pairs(spark, sf):
    return clones.cross_file_pairs(clones.windows(files(spark, sf))).select("a", *big("a_start"), "b", *big("b_start"))


@query("DUP02_regions", f"""with {WINDOWS}, p as (select x.path, x.start a, y.start b from w x join w y on x.path = y.path and x.hash = y.hash and x.start < y.start), n as (select *, case when lag(a) over o = a - 1 and lag(b) over o = b - 1 then 0 else 1 end n from p window o as (partition by path order by a, b)),
r as (select *, sum(n) over (partition by path order by a, b rows unbounded preceding) r from n) select path, cast(min(a) as bigint) a_start, cast(min(b) as bigint) b_start, cast(count(*) + 5 as bigint) lines from r group by path, r""")
def dup_regions(spark, sf):
    return clones.regions(clones.windows(files(spark, sf))).select("path", *big("a_start", "b_start", "lines"))


@query("DUP04_duplicate_code")
def dup_code(spark, sf):
    return clones.duplicate_code(files(spark, sf))


@query("DUP07_jaccard", """with g as (select distinct l_suppkey path, l_partkey gram from lineitem), n as (select path, count(*) n from g group by 1), b as (select x.path a, y.path b, count(*) k from g x join g y on x.gram = y.gram and x.path < y.path group by 1, 2)
select a, b, floor(k / (na.n + nb.n - k) * 1e6 + 0.5) / 1e6 jaccard from b join n na on na.path = a join n nb on nb.path = b where k / (na.n + nb.n - k) >= 0.1""")
def dup_jaccard(spark, sf):
    g = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("gram"))
    return clones.similar(g, 0.1).select("a", "b", r6("jaccard").alias("jaccard"))


@query("DUP06_token_grams")
def dup_grams(spark, sf):
    return clones.similar(clones.token_grams(files(spark, sf)).withColumn("gram", F.xxhash64("gram")))


# ---- text


@query("DET21_satd", r"""with l as (select doc_id path, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) line from documents) select path, 'SATD' as type, 'low' severity, cast(line as int) line from l where regexp_matches(x, '(?:(?:^|\s)\*|//|#|--|;)\s*(TODO|FIXME|HACK|XXX|BUG|KLUDGE)\b(.{0,80})', 'i')""")
def det_satd(spark, sf):
    return textsmells.satd(files(spark, sf)).select("path", "type", "severity", "line")


@query("DET19_magic_numbers")
def det_magic(spark, sf):
    return textsmells.magic_numbers(files(spark, sf))


@query("DET06_large_files", "select doc_id path, cast(len(string_split(text, chr(10))) as double) metric_value from documents where len(string_split(text, chr(10))) > 20")
def det_large(spark, sf):
    return textsmells.large_files(files(spark, sf), most=20).select("path", "metric_value")


@query("DET35_secrets")
def det_secrets(spark, sf):
    return textsmells.secrets(files(spark, sf))


# Each detector's rule in RE2's terms, which has no look-around: a number is the head of a run of word signs and points.
_SCORED = r"""l as (select doc_id path, unnest(string_split(text, chr(10))) x from documents), t as (select path, x, trim(x, ' ') t from l),
k as (select *, t = '' or starts_with(t, '//') or starts_with(t, '#') or starts_with(t, '*') or starts_with(t, 'import ') or starts_with(t, 'using ') or starts_with(t, 'package ') or starts_with(t, 'require(') or starts_with(t, 'from ')
or regexp_matches(t, '^[A-Z_][A-Z0-9_]*(?:\s*:\s*[\w<>\[\]|,\s]+)?\s*=($|[^=])') or regexp_matches(t, '\b(?:final|const)\b[^=\n]*\b[A-Z_][A-Z0-9_]+\b[^=\n]*=($|[^=])') skipped,
regexp_extract(x, '\b[\w.-]*(?:token|secret|passw(?:or)?d|api_?key)[\w.-]*\s*[:=]\s*["'']([^"''\s]{16,})["'']', 1, 'i') v from t),
h as (select *, list_sum([-(len([d for d in string_split(v, '') if d = c]) / length(v)) * log2(len([d for d in string_split(v, '') if d = c]) / length(v)) for c in list_distinct(string_split(v, ''))]) entropy from k),
c as (select path, count(*) filter (regexp_matches(x, '(?:(?:^|\s)\*|//|#|--|;)\s*(TODO|FIXME|HACK|XXX|BUG|KLUDGE)\b(.{0,80})', 'i')) satd,
coalesce(sum(case when skipped then 0 else len([w for w in regexp_extract_all(t, '[\w.]+') if regexp_full_match(w, '([2-9]|[1-9]\d+)(\.([^\d].*)?)?')]) end), 0) numbers, (count(*) > 20)::int large, count(*) filter (v <> '' and entropy >= 3) secrets from h group by 1)"""


@query("SCO01_score", f"""with {_SCORED}, s as (select doc_id path, coalesce(satd + numbers + large + secrets, 0) smells, 10 - {scoring.WEIGHTS['SATD']}::double * sqrt(coalesce(satd, 0)) - {scoring.WEIGHTS['MagicNumber']}::double * sqrt(coalesce(numbers, 0)) - {scoring.WEIGHTS['LargeFile']}::double * sqrt(coalesce(large, 0)) - {scoring.WEIGHTS['HardcodedCredential']}::double * sqrt(coalesce(secrets, 0)) raw from documents left join c on path = doc_id)
select path, cast(smells as bigint) smells, floor(raw * 1e6 + 0.5) / 1e6 raw, greatest(0, floor(raw * 10 + 0.5) / 10) score, case when greatest(0, floor(raw * 10 + 0.5) / 10) >= 9 then 'green' when greatest(0, floor(raw * 10 + 0.5) / 10) >= 4 then 'yellow' else 'red' end category from s""")
def sco_score(spark, sf):
    f = files(spark, sf)
    return scoring.score(f, textsmells.text_findings(f, most=20)).withColumn("raw", r6("raw"))


@query("STR05_tokens", "select doc_id, cast(ceil(length(text) / 4.0) as bigint) tokens from documents")
def str_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.ceil(F.length("text") / 4).cast("bigint").alias("tokens"))


@query("STR02_sha1", "select doc_id, sha1(text) sha1 from documents")
def str_sha1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("sha1"))


@query("DAT01_since_date", "select o_orderkey, cast(cast(o_orderdate as date) - 90 as date) since from orders")
def dat_since(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", history.since_date(F.col("o_orderdate").cast("date"), 90).alias("since"))


@query("PRJ04_ladder", "select s_suppkey, case when s_acctbal > 7000 then 'high' when s_acctbal >= 3000 then 'medium' when s_acctbal < 0 then 'negative' else 'low' end severity from supplier")
def prj_ladder(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", ladder(F.col("s_acctbal"), [(">", 7000, "high"), (">=", 3000, "medium"), ("<", 0, "negative")], "low").alias("severity"))


@query("PRJ06_churn_multiplier", "select p_partkey, case when p_size * 3 >= 80 then 1.5::double when p_size * 3 >= 40 then 1.2::double else 1.0::double end m from part")
def prj_churn(spark, sf):
    return table(spark, sf, "part").select("p_partkey", paths.churn_multiplier(F.col("p_size") * 3).alias("m"))


@query("MTH_js_round", "select s_suppkey, cast(floor(s_acctbal + 0.5) as bigint) r from supplier")
def mth_round(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", js_round(F.col("s_acctbal")).alias("r"))


@query("SRC14_holdout", """with h as (select d.doc_id path, n_chars / 1000.0 score, coalesce(quality, -1) quality, coalesce(toxic, 0) toxic from documents d left join labels l on l.doc_id = d.doc_id where n_chars >= 1000) select cast(floor(least(score, 9) / 2) as bigint) band, count(*) n, cast(sum(quality) as bigint) quality, cast(sum(toxic) as bigint) toxic from h group by 1""")
def src_holdout(spark, sf):
    from tidemark.sources.labels import holdout

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), (F.col("n_chars") / 1000.0).alias("score"))
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "path")
    h = holdout(d, lab, {"quality": -1, "toxic": 0}, least=1.0)
    return h.groupBy(F.floor(F.least(F.col("score"), F.lit(9)) / 2).alias("band")).agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))


@query("SRC12_fix_labels", "select l_partkey path, max(case when l_returnflag = 'R' then 1 else 0 end) has_bug, count(distinct case when l_returnflag = 'R' then l_orderkey end) bug_count from lineitem group by 1")
def src_fix_labels(spark, sf):
    from tidemark.sources.labels import from_fix_commits

    li = table(spark, sf, "lineitem")
    c = li.select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("sha"), F.when(F.col("l_returnflag") == "R", "fix: defect").otherwise("work").alias("message"))
    return from_fix_commits(c).select("path", F.col("has_bug").cast("int").alias("has_bug"), "bug_count")


@query("STM05_rolling", "select time_bucket(interval '14 days', ts, timestamp '1970-01-01') as start, event_type, count(distinct user_id) users from events group by 1, 2")
def stm_rolling(spark, sf):
    from tidemark.streaming.telemetry import rolling

    return rolling(table(spark, sf, "events"), "14 days", "event_type", "user_id")


from tidemark.plans import detectors as _detectors, more as _more  # noqa: E402,F401  registers the rest
