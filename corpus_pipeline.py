"""A corpus pipeline: each stage works on all rows that the one before it has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortline.llm import decontamination, language, mixing, near_dedup, secrets
from cohortline.llm._spark import saved, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by a model of those that aren't held out."""
    return language.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near duplicates."""
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words or more are cut out; documents that are mostly such passages go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secrets.without_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: how many words of each document go into the mix."""
    return mixing.mix(docs, quality=table(spark, sf_dir, "labels"))


STAGES = [
    ("language identification", identified),
    ("near deduplication", distinct),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing to target weights", mixed),
]

#: The first, second and fourth stage can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the table documents, each stage computed once into the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else saved(docs)
    return docs
