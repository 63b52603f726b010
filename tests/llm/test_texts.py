"""URL verdicts, quality, language, near duplicates: against brute force and held-out rows."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, langid, neardup, quality, urlfilter
from tidemark.llm.queries import URL_RULES


def test_url_rules(spark):
    rows = [("http://A.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("https://badexample.org", "badexample.org", "", None, "allow"), ("http://x.org/a", "x.org", "/a", "org/", "allow"), ("http://m.com/de/#t", "m.com", "/de/", "com/de/", "block"), ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://x.net/fr/?q#z", "x.net", "/fr/", None, "allow")]
    df = spark.createDataFrame([(i, r[0], None, "clash") for i, r in enumerate(rows)], "page_id long, url string, html string, trust string")
    got = {r.page_id: r for r in urlfilter.judge(df, URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert urlfilter.judge(df.limit(0), URL_RULES).count() == 0


def test_walks_equal_brute_force(spark):
    rnd = random.Random(1)
    hosts = [f"h{i}.net" for i in range(12)] + ["good.org", "bad.com", "good2.org"]
    links = {(a, b): rnd.randrange(1, 4) for a in hosts for b in rnd.sample(hosts, 3) if a != b}
    pages = []
    for a in hosts:
        tags = "".join(f'<a href="http://{b}/p{k}">x</a><A HREF=\'//{b.upper()}/q{k}\'>' if k == 0 else f'<a href="http://{b}/p{k}">' for (s, b), n in links.items() if s == a for k in range(n))
        pages.append((f"http://{a}/{'de/' if a == 'bad.com' else ''}", tags + '<a href="/own">'))
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    counts = {(a, b): n + 1 for (a, b), n in links.items()}
    seeds = {"good.org": (1, 0), "good2.org": (1, 0), "bad.com": (0, 1)}

    def walk(edges, start):
        out = {}
        for (a, b), n in edges.items():
            out.setdefault(a, {})[b] = n
        r = dict(start)
        for _ in range(200):
            new = {h: 0.15 * v for h, v in start.items()}
            for a, v in r.items():
                for b, n in out.get(a, {}).items():
                    new[b] = new.get(b, 0) + 0.85 * v * n / sum(out[a].values())
            r = new
        return r

    trust = walk(counts, {h: t / 3 for h, (t, _) in seeds.items() if t})
    distrust = walk({(b, a): n for (a, b), n in counts.items()}, {h: d / 3 for h, (_, d) in seeds.items() if d})
    for r in urlfilter.judge(df, URL_RULES).collect():
        assert r.trust == pytest.approx(trust.get(r.host, 0), abs=1e-5) and r.distrust == pytest.approx(distrust.get(r.host, 0), abs=1e-5)
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust > r.trust else "allow")


def made_texts(n=240, seed=3):
    rnd = random.Random(seed)
    words = {"en": ["the", "house", "with", "thing", "this"], "de": ["das", "haus", "mit", "ding", "über"], "fr": ["la", "maison", "avec", "chose", "été"]}
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        w = [rnd.choice(words[lang]) + rnd.choice(["", "s", "en"]) for _ in range(rnd.randrange(5, 60))]
        good = i % 4 != 0
        rows.append((i, " ".join(w).capitalize() + "." if good else " ".join(x + "$$$" for x in w), lang, int(good)))
    return rows


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_quality(spark):
    rows = made_texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in rows] + [(900, None, ""), (901, "", ""), (902, " \n", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows if i % 3 != 1] + [(5, None), (None, 1), (7777, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(q) for i, _, _, q in rows if i % 3 == 1]
    assert sum(held) / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values())
    flat = quality.fit(docs, labels.where("quality = 1"), "quality")
    assert {r.score for r in quality.score(docs, flat).collect()} == {1.0}
    none = quality.fit(docs, labels.limit(0), "quality")
    assert quality.score(docs.limit(0), none).count() == 0


def test_quality_sums_do_not_grow_with_the_tasks(spark):
    def of(batches):
        yield pd.DataFrame([[np.ones(1).tobytes(), np.array([float(sum(b["id"].sum() for b in batches))]).tobytes()]], columns=["n", "total"])

    n, total = quality._summed(spark.range(0, 1000, 1, 100), "n binary, total binary", of)
    assert n[0] <= 16 and total[0] == 999 * 500


def test_quality_features_are_made_a_block_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    d, waves = len(quality.STATISTICS), 8
    model = quality.Model(np.zeros(d), np.ones(d), rng.standard_normal((d, waves)), rng.uniform(0, 6, waves), rng.standard_normal(1 + d + waves), np.zeros(1), np.zeros(1))
    x = rng.standard_normal((10_001, d))
    want, sizes, made = model.features(x) @ model.weights, [], quality.Model.features
    monkeypatch.setattr(quality.Model, "features", lambda self, x: sizes.append(len(x)) or made(self, x))
    assert np.allclose(model.raw(x), want, rtol=0, atol=1e-12) and max(sizes) <= 2000 and sum(sizes) == len(x)


def test_quality_where_all_labelled_rows_calibrate(spark):
    docs = spark.createDataFrame([(i, f"Some text {i}.") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality", fit_rows=0, calibration_rows=40)
    assert {round(r.score, 6) for r in quality.score(docs, model).collect()} == {0.5}


def test_language(spark):
    rows = made_texts()
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] + [(900, None, "en"), (901, "123 ...", "en"), (902, "", None), (903, "the house", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 5 <> 1 or doc_id >= 900"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [got[i].lang_pred == lang for i, _, lang, _ in rows if i % 5 == 1]
    assert sum(held) / len(held) > 0.95
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902))
    none = langid.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def near_rows():
    rnd, rows = random.Random(8), []
    vocabulary = [f"w{i}" for i in range(400)]
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 30, 80, 300]))]
        for _ in range(rnd.choice([1, 3, 30])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, len(w) // 25])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(w).replace("w1", "W1") if g % 2 else "\t".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two"), (1004, "one"), (1005, " \x0b "), (1006, "É e f"), (1007, "é e f")]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, size, percent).collect()}
    assert got == brute(rows, size, percent)


def test_large_nodes_branch(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 12)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_large_star_is_found(spark, monkeypatch):
    """Variants that only their original links, in nodes 10 times too large: about as deep as a group of 10,000."""
    monkeypatch.setattr(neardup, "NODE", 60)
    monkeypatch.setattr(neardup, "HUBS", 1)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 601):
        w = list(words)
        for at in rnd.sample(range(3, 197, 4), 5):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w)))
    want = brute(rows, 3, 85)
    assert {c for _, c, _ in want.values()} == {0}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.component_id for r in neardup.near_duplicates(df, 3, 85).collect()]
    assert sum(c == 0 for c in got) / len(got) >= 0.99


def test_group_is_not_sent_once_for_each_near_class():
    """Ten classes below the threshold to a group of 200: rows of the order of the group, and every pair in some cell."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, neardup.SIGNATURE, dtype=np.uint8)
    sig = np.tile(base, (210, 1))
    for i in range(10):
        at = rng.permutation(neardup.SIGNATURE)[:28]
        sig[i, at] = base[at] + 1 + i
    k, comp = np.arange(210), np.concatenate([np.arange(10), np.full(200, 10)])
    columns = [pa.array(np.zeros(210, np.int64)), pa.array(k), pa.array(np.full(210, 50)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(comp)]
    found = pa.Table.from_batches(neardup._cells(0.85)(iter([pa.RecordBatch.from_arrays(columns, ["node", "k", "n", "sig", "comp"])])))
    met, cells = set(), {}
    for c, x, m in zip(*(found.column(n).to_pylist() for n in ("cell", "k", "minor")), strict=True):
        cells.setdefault(c, []).append((x, m))
    for rows in cells.values():
        met |= {(a, b) for a, minor in rows if minor for b, _ in rows}
    assert met >= {(a, b) for a in range(10) for b in range(10, 210)}
    assert found.num_rows <= 2 * 210
    assert max(map(len, cells.values())) <= 2 * neardup.SIDE


def test_sets_of_many_cells_go_in_small_batches(monkeypatch):
    monkeypatch.setattr(neardup, "BATCH_BYTES", 10_000)
    text = " ".join(f"w{i}" for i in range(102))
    s = neardup.Shingler(3).set_of(text)
    one, two = neardup._identity(s)
    cells = [{"cell": c, "minor": c % 2 == 0} for c in range(500)]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("cell", pa.int64()), ("minor", pa.bool_())]))]
    rows = [[text, "other"], [7, 8], [one, one], [two, two], [3, 3], [cells, cells]]
    got = list(neardup._spread(3)(iter([pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["x", "k", "f1", "f2", "comp", "cells"])])))
    assert max(b.nbytes for b in got) < 3 * 10_000
    assert pa.Table.from_batches(got).to_pylist() == [{"cell": c, "k": 7, "hashes": s.tobytes(), "comp": 3, "minor": c % 2 == 0} for c in range(500)]


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "A b c d")], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False)], key=str)
    assert neardup.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
