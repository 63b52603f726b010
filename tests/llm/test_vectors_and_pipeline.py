"""Nearest neighbours, embedding duplicates and the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, embdedup


def vectors(spark, seed=1, n=400, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n, 4):
        x[i] = x[(i * 7 + 1) % n] + rng.standard_normal(dim) * rng.choice([0.0, 0.02, 0.15])
    rows = [(i, [float(v) for v in x[i]], int(i % 3)) for i in range(n)]
    rows += [(9000, None, 1), (9001, [0.0] * dim, 1), (9002, [float("nan")] * dim, 1), (9003, [None] + [1.0] * (dim - 1), 1), (9004, rows[5][1], None), (9050, rows[5][1], 2), (9051, [1.0, 2.0], 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def fine(v):
    return v is not None and all(y is not None and np.isfinite(y) for y in v) and any(v)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_nearest(spark):
    rows, df = vectors(spark)
    got = {}
    for r in ann.search(df.withColumn("rank", F.lit(0)), F.col("vec_id") % 50 == 0, 5, block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [r for r in rows if fine(r[1])]
    for q in (r for r in good if r[0] % 50 == 0):
        want = sorted(((-cosine(q[1], r[1]), r[0]) for r in good if r[0] != q[0] and len(r[1]) == len(q[1])))[:5]
        mine = sorted(got[q[0]])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[2] for m in mine] == pytest.approx([-w[0] for w in want])
        assert {m[1] for m in mine if m[2] > -want[-1][0] + 1e-9} == {w[1] for w in want if -w[0] > -want[-1][0] + 1e-9}
    assert set(got) == {r[0] for r in good if r[0] % 50 == 0}


def test_nearest_ties_and_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 3)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_duplicates(spark, block):
    rows, df = vectors(spark, 2)
    got = {r.vec_id: r for r in embdedup.near_duplicates(df.withColumn("kept", F.lit("clash")), 0.98, block=block).collect()}
    good = [r for r in rows if fine(r[1]) and r[2] is not None]
    links = {r[0]: set() for r in rows}
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    comp = {i: i for i in links}
    for _ in range(len(links)):
        new = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
        if new == comp:
            break
        comp = new
    assert sum(map(len, links.values())) > 20
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def test_hot_vector(spark):
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0), F.when(F.col("id") < 400, 3.0).otherwise(-F.col("id").cast("double"))).alias("embedding"), F.lit(1).alias("label"))
    got = embdedup.near_duplicates(df.where("vec_id < 400")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0)} and sum(r.kept for r in got) == 1
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def test_least_collisions():
    assert 30 <= embdedup.least_collisions(48, 2.0) <= 40


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, sf).persist()
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(before).count() == 0
        assert kept.count() >= 0.6 * before.count()
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts))
    ids = {r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, kept, sf).select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in kept.select("doc_id").collect()}
