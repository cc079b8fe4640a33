"""One query per operator, over whole tables, with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, block_max, byte_bpe, lang_id, line_dedup, media, packing, set_sketch, simhash, substring_dedup, token_store, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify_held_out(_table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_token_store(token_store.write_token_store(_table(spark, sf_dir, "documents")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _table(spark, sf_dir, "embeddings")
    return ann.nearest(every, every.where("vec_id % 50 = 0"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digests(_table(spark, sf_dir, "documents"))


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_stored(media.store_texts(_table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_token_store": op3_token_store,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest": op5_nearest,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_progressive_jpeg": op7_progressive_jpeg,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_set_sketch": op11_set_sketch,
    "op12_vector_codes": op12_vector_codes,
    "op13_block_max": op13_block_max,
}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op11_set_sketch": set_sketch.SQL, "op12_vector_codes": vector_codes.SQL, "op13_block_max": block_max.SQL}
