"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept, is written as Parquet to the
folder in ``spark.checkpoint.dir`` and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import mixing, nearcopies, packing, secrets, toxicity
from tideline.llm._shared import durable, table
from tideline.llm.queries import token_files
from tideline.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go."""
    docs = _columns(docs)
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    return toxicity.drop_toxic(docs, chain)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (five-word shingles, similarity 0.8) stays."""
    return nearcopies.keep_first(_columns(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows the text."""
    out = secrets.redact(_columns(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that tokens approach the target shares of sources, languages and topics."""
    return mixing.sample(_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(_columns(docs), **token_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_each_group),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and fingerprints have no SQL form; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
