"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.llm import bpe, jaccard_join, media, packing, pii, quality_rules, sql, subword_quality, substring_dedup, token_alignment, token_counts, token_files, toxicity, vector_codes
from planlens.workspace import Scratch


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    token_files.write(table(spark, sf_dir, "documents"), scratch.path("files"), vocabulary("word_bpe_49k.json"), end_id=2, scratch=scratch)
    return token_files.digest(spark, scratch.path("files"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    media.write(table(spark, sf_dir, "documents"), scratch.path("archives"))
    return media.describe(media.read(spark, scratch.path("archives")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_test = toxicity.held_out(F.col("doc_id"))
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~is_test)
    return scored.select("doc_id", is_test.alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_test = subword_quality.held_out(F.col("doc_id"))
    scored = subword_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~is_test)
    return scored.select("doc_id", is_test.alias("held_out"), "score", "predicted")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_token_files": op3_token_files,
        "op4_media": op4_media,
        "op5_toxicity": op5_toxicity,
        "op6_token_counts": op6_token_counts,
        "op7_quality_rules": op7_quality_rules,
        "op8_bpe": op8_bpe,
        "op9_pii": op9_pii,
        "op10_packing": op10_packing,
        "op11_subword_quality": op11_subword_quality,
        "op12_token_alignment": op12_token_alignment,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    """The others learn, pack, compress or tokenize; tests compare them with brute force."""
    return sql.oracle_sql()
