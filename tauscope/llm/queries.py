"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauscope.llm import (
    byte_cnn, check_sql, code_search, divergence, licences, lm_scoring, mixing, near_dups, packing, personal_data, pieces, quality_rules, sharding,
    vector_codes,
)
from tauscope.llm.common import table


def rank_file() -> str:
    """Place of the rank file of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_file() -> str:
    """Place of the model file of the public 32k piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).withColumn("target", F.round("target", 6))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("text_hash")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), rank_file())


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(table(spark, folder, "documents"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm_scoring.cross_entropy_difference(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.withColumn("ce_diff", F.round("ce_diff", 6) + F.lit(0.0))  # sums are formed in different orders


def op9_code_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), code_search.sign_bits(F.col("embedding")).alias("code"))
    return code_search.top_k(rows, rows.where("id % 50 = 0"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return byte_cnn.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), piece_file())


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mixing, op2_near_duplicates, op3_quality_rules, op4_packing, op5_sharding, op6_licences, op7_personal_data,
        op8_lm_scoring, op9_code_search, op10_quality_classifier, op11_pieces, op12_vector_codes, op13_source_divergence)
}
ORACLES: dict[str, str] = {
    "op1_mixing": check_sql.MIX, "op2_near_duplicates": check_sql.NEAR_DUPLICATES, "op8_lm_scoring": check_sql.language_models(),
    "op9_code_search": check_sql.CODE_SEARCH, "op12_vector_codes": check_sql.vector_codes(), "op13_source_divergence": check_sql.AUDIT,
}
