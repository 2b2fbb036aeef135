"""The registered queries of this package; their SQL is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import ann, media, mixing, packing, quality, secrets, simhash, suffixes, toxicity, urlrules
from tideline.llm._shared import durable, table
from tideline.llm.oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]


def token_files() -> dict:
    import public_tokenizers

    return {"vocab": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=400).drop("spans")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
                        "feature", "width", "height")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlrules.judge(pages, urlrules.mine(pages, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.calibrated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"),
                        F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"),
                        F.round("_p", 9).alias("probability"), F.col("_kept").alias("kept"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **token_files())


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under limits on tokens, turns and assistant tokens, all of which bind."""
    items = durable(packing.conversation_items(table(spark, sf_dir, "conversations"), **token_files()), "pack-items")
    return packing.pack_conversations(items).join(items, "item_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_ann, op2_suffixes, op3_media, op4_mixing, op5_toxicity, op6_quality, op7_urls, op8_packing, op9_simhash, op10_secrets, pipeline,
                                   packing_conversations)}
