"""The corpus pipeline: five operators in a row, each over all that the one before kept.

``run`` writes each stage's result as Parquet to the shared folder and reads it
back, so a lost executor costs tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, language, mixture, simhash, training_order
from gridloom.llm.queries import END_TOKEN, SEQUENCE_TOKENIZER
from gridloom.llm.shared import documents, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others get the predicted language where theirs is null."""
    said = language.identify(docs, language.train(docs)).where(~F.col("rejected"))
    return said.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: shingles of five words, a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, simhash.near_copies(docs, similarity=0.8, size=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their word budgets; a document comes once an epoch."""
    return mixture.apply_mixture(docs, mixture.plan_mixture(docs))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, written as fixed-stride shards; their index."""
    return training_order.materialise(docs, public_tokenizers.path(SEQUENCE_TOKENIZER), END_TOKEN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixture", source_mixture),
    ("token_output", token_output),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name)
    return docs
