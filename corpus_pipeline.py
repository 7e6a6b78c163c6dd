"""The corpus pipeline: rules, exact and near duplicates, source mixing, tokens.

Each stage takes what its predecessor wrote and does its work on all of it; all but the last return
the columns of documents. An empty table stays empty in each; long texts are treated as their
operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meterglass.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from meterglass.session import write_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the policy ``corpus`` keeps, all columns; null and empty texts go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null being empty, the row of the largest doc_id; a null id is the smallest."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest doc_id."""
    return simhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows, a document once for each block that takes it; a null source is a source."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and packed ids of every row, null ids and repeated rows as they come."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("source mixing", mix),
    ("BPE encoding", tokens),
]
#: SQL cannot express the fingerprints' hash or the vocabulary's merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents.

    Each stage's result is written as Parquet into the shared checkpoint folder and read again.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
