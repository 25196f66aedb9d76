"""A training-data pipeline: quality rules, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tauscope.llm import mixing, near_dups, packing, personal_data, quality_rules
from tauscope.llm.common import shared_folder, table
from tauscope.llm.queries import rank_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted texts are those that ``labels`` marks. Null and empty texts go."""
    return quality_rules.good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on word shingles: five words, similarity 0.8 or more. Rows without an id stay."""
    return near_dups.distinct_documents(docs, width=5)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return personal_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as rows of documents; what is taken twice is there twice."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, rank_file(), with_ids=True)


#: The stages, in order: every one works on what the one before has kept, written as Parquet and read again.
STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one_of_each_group),
    ("personal data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the learned spans nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; between stages the rows lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
