"""Revisit records of web archives: not-modified revisits get the payload and the headers of the response they stand for.

A revisit stands for the latest full response of the same canonical URL at or before its own time (as-of join). Its
validators are checked against that response: the entity tag if both have one (weak comparison), else the date of last
modification if both have one; a revisit whose validator differs stands for a version that was not archived. The
response's headers are updated by those of the revisit that a not-modified answer may change.

Records are ordered by URL and time over ranges of rows, not over the rows of a URL, so a URL may hold any share of
them: within a range a window gives the last response, and the last responses of the ranges before it are carried in,
one row for each range that a URL reaches into. Headers and payloads meet only the revisits that refer to them.

Defined results: of responses at one time the one of the greatest id counts; a revisit never stands for a revisit; a
revisit without an earlier response, url or time, or with a validator that differs, has a null source and payload and
its own headers, and `checked` says why ("none", "differs"); a response whose payload is null gives a null payload;
responses are their own source; ids are unique; header names count in small letters; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import stored
from tidemark.llm.urlfilter import host_of

RESPONSE, REVISIT = "response", "revisit"
#: Headers that belong to one connection or to the body that was sent, which a 304 may not change.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical(url: Column) -> Column:
    """Host in small letters without the default ports, path (/ if empty) and query; no scheme, no fragment. Null without ://."""
    host = F.regexp_replace(host_of(url), "(?::(?:80|443)?)$", "")
    rest = F.regexp_extract(url, "^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.contains("://"), F.concat(host, rest))


def _validators(headers: Column) -> list[Column]:
    return [F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "").alias("tag"), F.try_element_at(headers, F.lit("last-modified")).alias("modified")]


def _sources(keys: DataFrame) -> DataFrame:
    """(record_id, source) for the revisits of keys (at, time, type, record_id, tag, modified), none null but the last two."""
    order = ["at", "time", (F.col("type") == REVISIT).cast("int").alias("late"), "record_id"]  # responses go first
    rows = keys.select("at", "time", "type", order[2], "record_id", "tag", "modified")
    dealt = rows.repartitionByRange("at", "time", "late", "record_id").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "ordered")
    response = F.when(F.col("type") == RESPONSE, F.struct("record_id", "tag", "modified"))
    within = Window.partitionBy("part", "at").orderBy("time", "late", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.withColumn("last", F.last(response, ignorenulls=True).over(within))
    # The last response of a URL in each range it reaches into, and of the ranges before.
    ends = dealt.where(F.col("type") == RESPONSE).groupBy("at", "part").agg(F.max_by(F.struct("record_id", "tag", "modified"), F.struct("time", "record_id")).alias("end"))
    ranges = dealt.select("at", "part").distinct().join(ends, ["at", "part"], "left")
    before = Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("carried", F.last("end", ignorenulls=True).over(before)).where("carried is not null").select("at", "part", "carried")
    told = here.where(F.col("type") == REVISIT).join(carried, ["at", "part"], "left")
    return told.select("record_id", "tag", "modified", F.coalesce("last", "carried").alias("source"))


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, type, url, time, source_id, payload, checked, headers) from records (record_id, type, url, time,
    payload, and headers map<string,string> if there are any)."""
    kind = records.schema["record_id"].dataType
    headers = F.col("headers") if "headers" in records.columns else F.lit(None).cast("map<string,string>")
    small_names = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    records = records.select("record_id", "type", "url", "time", "payload", F.coalesce(small_names, F.create_map().cast("map<string,string>")).alias("headers"))
    keys = records.select("record_id", "type", "time", canonical(F.col("url")).alias("at"), *_validators(F.col("headers")))
    found = _sources(keys.where(F.col("at").isNotNull() & F.col("time").isNotNull() & F.col("record_id").isNotNull()))
    tags = F.col("tag") == F.col("source.tag")
    dates = F.col("modified") == F.col("source.modified")
    checked = (
        F.when(F.col("source").isNull(), "none")
        .when(tags.isNotNull(), F.when(tags, "etag").otherwise("differs"))
        .when(dates.isNotNull(), F.when(dates, "last-modified").otherwise("differs"))
        .otherwise("unchecked")
    )
    found = found.select("record_id", checked.alias("checked"), F.when(~checked.isin("none", "differs"), F.col("source.record_id")).alias("source_id"))
    revisits = records.where(F.col("type") == REVISIT).drop("payload").join(found, "record_id", "left")
    responses = records.where(F.col("type") == RESPONSE)
    payloads = responses.select(F.col("record_id").alias("source_id"), "payload", F.col("headers").alias("stored"))
    told = revisits.join(payloads, "source_id", "left")
    permitted = F.map_filter("headers", lambda name, _: ~name.isin(*KEPT_HEADERS))
    unchanged = F.map_filter("stored", lambda name, _: ~F.array_contains(F.map_keys(permitted), name))
    merged = F.when(F.col("source_id").isNull(), F.col("headers")).otherwise(F.map_concat(unchanged, permitted))
    out = ["record_id", "type", "url", "time", "source_id", "payload", "checked", "headers"]
    told = told.select("record_id", "type", "url", "time", F.col("source_id").cast(kind).alias("source_id"), "payload", F.coalesce("checked", F.lit("none")).alias("checked"), merged.alias("headers"))
    own = responses.select("record_id", "type", "url", "time", F.col("record_id").alias("source_id"), "payload", F.lit("own").alias("checked"), "headers")
    return own.select(*out).unionByName(told.select(*out))


def header_lines(headers: Column) -> Column:
    """The headers as lines in order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def records_of(pages: DataFrame, later: int = 1000) -> DataFrame:
    """Records over every page (page_id, url, html), as no table of records is given: its response at the time of its id,
    and a not-modified revisit, without payload, that much later.

    Both carry the hash of the URL as entity tag, weak in the revisit, so every revisit finds a response.
    """
    tag = F.concat(F.lit('"'), F.md5(canonical(F.col("url"))), F.lit('"'))
    head = lambda *more: F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in more)))
    full = head(("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length("html")), ("ETag", tag), ("Date", F.col("page_id")))
    short = head(("Content-Length", F.lit(0)), ("ETag", F.concat(F.lit("W/"), tag)), ("Date", F.col("page_id") + later))
    two = F.explode(F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.lit(RESPONSE).alias("type"), F.col("page_id").alias("time"), F.col("html").alias("payload"), full.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.lit(REVISIT).alias("type"), (F.col("page_id") + later).alias("time"), F.lit(None).cast("string").alias("payload"), short.alias("headers")),
    ))
    return pages.select("url", two.alias("r")).select("r.record_id", "r.type", "url", "r.time", "r.payload", "r.headers")
