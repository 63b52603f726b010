"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, embdedup, langid, neardup, oracles, packing, quality, tokenfile, urlfilter, warc
from tidemark.llm._common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    back = tokenfile.written(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Host and path of a rule, and its verdict.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.records_of(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    lines = warc.header_lines(F.col("headers"))
    return warc.resolve(records).select("record_id", "type", "url", "time", "source_id", "checked", F.sha2("payload", 256).alias("payload_sha256"), F.sha2(lines, 256).alias("headers_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    items = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(items, capacity=2048)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(fold("doc_id") != 1)
    model = quality.fit(docs, labels, "quality")
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(quality.accepted(F.col("score")), 1).otherwise(0).alias("predicted"),
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold("doc_id") != 1))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_token_file": op3_token_file,
    "op5_warc": op5_warc,
    "op7_packing": op7_packing,
    "op6_quality": op6_quality,
    "op9_langid": op9_langid,
    "op8_ann": op8_ann,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op4_near_dedup": op4_near_dedup,
}

#: The others are beyond SQL; tests hold them against libraries, brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": oracles.url_filter(URL_RULES),
    "op4_near_dedup": oracles.NEAR_DEDUP,
    "op5_warc": oracles.WARC,
    "op8_ann": oracles.ANN,
    "op10_embedding_dedup": oracles.EMBEDDING_DEDUP,
}
