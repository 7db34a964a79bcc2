"""From raw documents to tokens: the stages of a corpus, each a DataFrame job.

``run`` writes what a stage returns and reads it again for the next one, so a
lost executor costs at most the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolode.llm import bpe, exact_dedup, mixture, near_dedup, quality
from chronolode.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs of their group."""
    return quality.quality_filter(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id."""
    return exact_dedup.without_duplicates(docs, keep="largest")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return near_dedup.without_near_duplicates(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixture.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, with digests of them and of the decoded text."""
    return bpe.encoded(docs).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("source_mixture", source_mixture),
    ("token_ids", token_ids),
]

#: The last stage's token ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
