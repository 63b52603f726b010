"""The pipeline's stages on small documents: against the models' own decisions, brute force and the library; odd tables."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_texts import brute, made_texts, near_rows
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import ann, langid, neardup, packing, quality

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def small(spark, tmp_path):
    """Documents with near copies, odd texts and clashing columns, and labels of them."""
    rows = [(i, t, lang, q) for i, t, lang, q in made_texts()]
    rows += [(1000 + i, t, "en", 1) for i, t in near_rows()]
    rows += [(5000, "1 2 3", None, None), (5001, "x" * 400_000, "en", 1), (5002, rows[3][1], "de", 1), (5002, rows[3][1], "de", 1)]
    docs = spark.createDataFrame([(i, t, lang, "src", -7, 0.5, "dot") for i, t, lang, _ in rows], "doc_id long, text string, lang string, source string, score long, rejected double, `a.b` string")
    spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs, str(tmp_path)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_quality_stage_keeps_what_the_model_accepts(spark, small):
    docs, sf = small
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    kept = STAGES["quality"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    rows = docs.collect()
    score = model.score(np.array([quality.statistics(r.text) for r in rows]))
    assert ids(kept) == sorted(r.doc_id for r, s in zip(rows, score, strict=True) if s >= 0.5)


def test_language_stage_drops_what_is_rejected(spark, small):
    docs, sf = small
    model = langid.fit(docs)
    kept = STAGES["language"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    rows = docs.collect()
    assert ids(kept) == sorted(r.doc_id for r, gone in zip(rows, model.predict([r.text for r in rows])[2], strict=True) if not gone)
    assert not {1000 + 1000, 1000 + 1001, 5000} & set(ids(kept))
    assert ids(STAGES["language"](spark, docs.withColumn("lang", F.lit(None).cast("string")), sf)) == ids(docs)


def test_near_dedup_stage_equals_brute_force(spark, small):
    docs, sf = small
    kept = STAGES["near_dedup"](spark, docs, sf)
    assert kept.columns == docs.columns
    want = brute({r.doc_id: r.text for r in docs.collect()}.items(), 5, 80)
    assert ids(kept) == sorted(i for i, x in want.items() if x[2])


def test_packing_stage_keeps_every_token(spark, small):
    docs, sf = small
    got = STAGES["packing"](spark, docs, sf).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    total, fill = {}, {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    want = {}
    for r in docs.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + 1 + len(lib.encode(r.text or "", add_special_tokens=False).ids)
    assert total == want and max(fill.values()) <= 2048
    assert len(fill) <= packing.lower_bound(np.array([r.length for r in got]), 2048) + 1


def test_stages_of_an_empty_table(spark, small):
    docs, sf = small
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_packing_meets_the_bound_of_all_items(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 2049, 6000).tolist() + rng.integers(1, 60, 9000).tolist()
    items = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], "doc_id long, length long, _group string").repartition(6)
    got = packing.pack(items, 2048)
    assert set(items.columns) < set(got.columns)
    bins = got.select("sequence_id").distinct().count()
    assert bins <= packing.lower_bound(np.array(sizes), 2048) + 4  # as many as groups


@pytest.mark.parametrize("node, hubs, levels", [(24, 8, 40), (24, 1, 0), (60, 8, 2)])
def test_groups_beyond_a_task(spark, monkeypatch, node, hubs, levels):
    """Nodes far above what one task compares: blocks with hubs, branching, and the end after some levels."""
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "HUBS", hubs)
    monkeypatch.setattr(neardup, "LEVELS", levels)
    rnd = random.Random(6)
    rows = near_rows()
    for g in range(3):  # chains: each text a step from the one before
        w = [f"c{g}x{i}" for i in range(150)]
        for k in range(120):
            w[rnd.randrange(150)] = f"n{g}x{k}"
            rows.append((2000 + 200 * g + k, " ".join(w)))
    want = brute(rows, 3, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 3, 85).collect()}
    right = sum(got[i] == want[i][1] for i in want)
    assert right / len(want) >= 0.99 and all(got[i] >= want[i][1] for i in want)


def test_repeated_ids_with_different_texts_and_text_ids(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [("b", "one two three four five six"), ("b", "seven eight nine ten eleven twelve"), ("a", "seven eight nine ten eleven twelve"), ("z", long), ("y", long + " more")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 5, 80).collect())
    assert got == [("a", 2, "a", True), ("b", 2, "a", False), ("b", 2, "b", True), ("y", 199_997, "y", True), ("z", 199_996, "y", False)]


def test_search_of_text_ids(spark):
    df = spark.createDataFrame([("q", [1.0, 0.0]), ("b", [1.0, 0.1]), ("a", [1.0, 0.1]), (None, [1.0, 0.0]), ("long name", [0.0, 1.0])], "vec_id string, embedding array<double>")
    got = ann.search(df, F.col("vec_id") == "q", k=2).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [("q", 1, "a"), ("q", 2, "b")]
