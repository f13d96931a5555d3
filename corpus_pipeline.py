"""The corpus pipeline: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from varicomp.llm import packing, pii, queries, similar, suffix_dedup, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain finds toxic."""
    return toxicity.clean_documents(docs, queries.toxicity_chain(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose 5-word shingles are similar to at least 0.8, found by SimHash first and exactly then."""
    return similar.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that an earlier document, or place, has."""
    return suffix_dedup.repeats_removed(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data."""
    return pii.without_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the token sequences: a row for each piece of a document."""
    return packing.pack(packing.tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", clean), ("near_duplicates", near_duplicates), ("suffix_dedup", repeats), ("pii", private), ("packing", packed)]

#: Trained models and byte-level algorithms are outside SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
