"""Revisits of web archives against brute force and edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.queries import QUERIES

KIND = "record_id long, type string, url string, time long, payload string"


def got(spark, rows):
    return {r.record_id: (r.source_id, r.payload) for r in warc.resolve(spark.createDataFrame(rows, KIND)).collect()}


def test_edges(spark):
    a = "http://A.org/x"
    rows = [(1, "response", a, 5, "one"), (2, "response", "https://a.org:443/x#f", 9, "two"), (3, "response", a, 9, "three"), (4, "revisit", a, 4, None), (5, "revisit", "//a.org/x", 9, None), (6, "revisit", a, 8, None), (7, "revisit", "http://a.org:80/x#z", 9, None), (8, "revisit", a, 99, None), (9, "revisit", None, 99, None), (10, "revisit", a, None, None), (11, "revisit", "http://a.org/x?q", 99, None), (12, "response", "http://b.org", 1, None), (13, "revisit", "http://b.org/", 1, None), (14, "response", None, None, "own")]
    assert got(spark, rows) == {1: (1, "one"), 2: (2, "two"), 3: (3, "three"), 4: (None, None), 5: (None, None), 6: (1, "one"), 7: (3, "three"), 8: (3, "three"), 9: (None, None), 10: (None, None), 11: (None, None), 12: (12, None), 13: (12, None), 14: (14, "own")}


def test_as_of_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["response", "revisit"]), f"http://h{rnd.randrange(6)}.org/", rnd.randrange(40), None) for i in range(300)]
    rows = [(i, t, u, at, f"p{i}" if t == "response" else None) for i, t, u, at, _ in rows]
    want = {}
    for i, t, u, at, p in rows:
        before = [(y[3], y[0], y[4]) for y in rows if y[1] == "response" and y[2] == u and y[3] <= at]
        want[i] = (i, p) if t == "response" else max(before)[1:] if before else (None, None)
    assert got(spark, rows) == want


def test_query_covers_all_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op5_warc"](spark, sf).collect()
    assert len(rows) == 2 * len(pages) and {r.record_id for r in rows} == {2 * i + k for i in pages for k in (0, 1)}
    for r in rows:
        assert r.payload_sha256 == hashlib.sha256(pages[r.source_id // 2].encode()).hexdigest()


def test_validators_and_headers(spark):
    a = "http://a.org/x"
    full = {"ETag": '"1"', "Last-Modified": "Mon", "Content-Length": "9", "X-Old": "o", "Date": "d1"}
    rows = [
        (1, "response", a, 1, "one", full),
        (2, "revisit", a, 2, None, {"etag": 'W/"1"', "Date": "d2", "Content-Length": "0", "X-New": "n", "Connection": "close"}),
        (3, "revisit", a, 3, None, {"ETag": '"2"', "Last-Modified": "Mon"}),
        (4, "revisit", a, 4, None, {"LAST-MODIFIED": "Mon"}),
        (5, "revisit", a, 5, None, {"Last-Modified": "Tue"}),
        (6, "revisit", a, 6, None, None),
        (7, "revisit", a, 0, None, {"ETag": '"1"'}),
    ]
    df = spark.createDataFrame(rows, KIND + ", headers map<string,string>").withColumn("source_id", F.lit("clash"))
    got = {r.record_id: (r.source_id, r.checked, r.headers) for r in warc.resolve(df).collect()}
    small = {k.lower(): v for k, v in full.items()}
    assert got == {
        1: (1, "own", small),
        2: (1, "etag", {**small, "etag": 'W/"1"', "date": "d2", "x-new": "n"}),
        3: (None, "differs", {"etag": '"2"', "last-modified": "Mon"}),
        4: (1, "last-modified", small),
        5: (None, "differs", {"last-modified": "Tue"}),
        6: (1, "unchecked", small),
        7: (None, "none", {"etag": '"1"'}),
    }
    assert warc.resolve(df.limit(0)).count() == 0


def test_one_url_over_many_ranges(spark):
    rnd = random.Random(2)
    rows = [(i, "response" if rnd.random() < 0.02 else "revisit", "http://a.org/", rnd.randrange(3000), None) for i in range(3000)]
    df = spark.createDataFrame(rows, KIND).repartition(8)
    got = {r.record_id: r.source_id for r in warc.resolve(df).collect()}
    answers = sorted((t, i) for i, k, _, t, _ in rows if k == "response")
    for i, k, _, t, _ in rows:
        before = [x for x in answers if x[0] <= t]
        assert got[i] == (i if k == "response" else before[-1][1] if before else None)
