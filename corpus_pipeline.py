"""A corpus pipeline of five stages, each over all that the one before has kept.

Language identification drops what is in no known language; of each group of near duplicates one
document stays; secrets are masked; sources are mixed to their weights, documents left out or repeated
accordingly; what remains is encoded. Every stage but the last returns the columns of documents; each
result is written to the shared folder and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitgraph.llm import bpe, language, mixing, neardup, secrets
from remitgraph.llm.queries import VOCABULARY
from remitgraph.plans.staging import stage

WORDS = 5  # words of a shingle of near duplicates
BEYOND = 0.5  # share of a text found in known languages must exceed it


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is found to be in languages that the rows themselves teach; none is known without labels."""
    return language.keep_known(docs, language.fit(docs), BEYOND)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    return neardup.keep_one(docs, words=WORDS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets masked in their texts."""
    return secrets.mask(docs, secrets.fit(secrets.samples(docs)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return mixing.apply_mix(docs, F.array("source"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and tokens of every row."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language id", known_language), ("near-dedup", without_near_duplicates), ("secret scan", without_secrets),
          ("mixing", mixed), ("bpe", encoded)]
# Neither the language model nor the mix can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
