"""A training corpus from documents, in stages: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's result to
the shared folder and reads it again. All but the last return the columns of documents. Models are fitted anew on the
documents that a stage is given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, neardup, packing, quality
from tidemark.llm._common import small, stored


def _unused(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs has no such column."""
    return _unused(docs, f"_{name}") if name.lower() in (x.lower() for x in docs.columns) else name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{x}`") for x in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5 stay; the score of every document is computed from its whole text."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    out = _unused(docs, "score")
    return quality.score(docs, model, out=out).where(quality.accepted(F.col(out))).select(*_columns(docs))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; text without letters and calibrated rejections go. Where no document
    has a language to learn from, none can be rejected, and all stay."""
    model = langid.fit(docs)
    if not model.languages:
        return docs
    names = tuple(_unused(docs, x) for x in ("lang_pred", "lang_score", "rejected"))
    return langid.identify(docs, model, names=names).where(~F.col(names[2])).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: the least id.

    Rows that repeat an id are one document. The ids that go are a small part and broadcast if a count shows it.
    """
    told = stored(neardup.near_duplicates(docs, size=5, percent=80), "groups")
    gone = told.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rest = docs.join(small(gone), "doc_id", "left_anti").select(*_columns(docs))
    ids = told.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1]:
        return rest
    return rest.where(F.col("doc_id").isNull()).unionByName(rest.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and place in it."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    items = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(items, capacity=2048)


STAGES = [("quality", quality_filter), ("language", language_filter), ("near_dedup", near_dedup), ("packing", pack)]

#: Fitted models and tokenizers are beyond SQL. Tests hold the near duplicates and the packing of run()'s rows against
#: brute force and the library, and the two filters against the models' own decisions, text by text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
