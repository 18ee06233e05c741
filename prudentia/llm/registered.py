"""The registered queries of the operators in this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.llm import (bpe, divergence, licences, line_dedup, lm_score, mixing, pii, quality, simhash, sql, token_files, topk,
                           toxicity, variants)
from prudentia.llm.common import let_workers_import


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise_spans(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages without the lines that their host repeats, as digests."""
    pages = _table(spark, sf_dir, "pages")
    text = line_dedup.page_text(F.col("html").cast("string"))
    kept = line_dedup.drop_repeated_lines(pages.select("page_id", line_dedup.host_of(F.col("url")).alias("host"), text.alias("text")),
                                          F.col("host"))
    return kept.select("page_id", "host", F.char_length("text").cast("long").alias("n_chars"), "lines_dropped",
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), path, with_values=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good against all documents."""
    good = _table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null")
    return lm_score.score(_table(spark, sf_dir, "documents"), good)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).drop("class_distance", "common_distance")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and places; the spans as label:first:last."""
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"].cast("string"), s["last"].cast("string")))
    return licences.licences(_table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(spans, ","))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return sql.registered()
