"""Corpus pipeline: from ``documents`` to the token ids of a clean, mixed corpus.

Each stage works on all rows its predecessor kept, and is written to the folder all nodes
share before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftmart.llm import language, mixing, near_dups, pieces, secret_links
from driftmart.llm.common import saved, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown; mixtures of known languages stay."""
    return language.readable(docs, language.fit(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return near_dups.without_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are blotted out; every document stays."""
    return secret_links.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every copy in the mix."""
    return pieces.encode(docs)


STAGES = [
    ("known_language", known_language),
    ("distinct_documents", distinct_documents),
    ("without_secrets", without_secrets),
    ("mixed_sources", mixed_sources),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The first stage's language model and the last one's merges are no SQL.
ORACLE_SQL = None
