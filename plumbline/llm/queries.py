"""The corpus operators' queries over whole tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, merkle, secrets, sharding, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_convnet_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(documents(spark, sf_dir), "doc_id", "text", "lang")


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir), "doc_id", "text")


def op3_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_table, production_mix

    return mix_table(documents(spark, sf_dir), "doc_id", "text", "lang", "source", production_mix(), WORD_BPE)


def op4_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(documents(spark, sf_dir), "doc_id", "text")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_files

    return token_files(documents(spark, sf_dir), "doc_id", "text", WORD_BPE)


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_layout

    return shard_layout(documents(spark, sf_dir), "doc_id", "text", 16)


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), "doc_id", "text")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(documents(spark, sf_dir), "text", WORD_BPE, ["doc_id"])


def op10_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contained_items

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contained_items(documents(spark, sf_dir), "doc_id", "text", items, "item_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_convnet_language": op1_byte_convnet_language,
        "op2_merkle_fingerprints": op2_merkle_fingerprints,
        "op3_hierarchical_mix": op3_hierarchical_mix,
        "op4_linked_secrets": op4_linked_secrets,
        "op5_token_files": op5_token_files,
        "op6_jump_shards": op6_jump_shards,
        "op7_simhash_groups": op7_simhash_groups,
        "op8_warc_round_trip": op8_warc_round_trip,
        "op9_token_counts": op9_token_counts,
        "op10_benchmark_containment": op10_benchmark_containment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_merkle_fingerprints": merkle.ORACLE,
        "op4_linked_secrets": secrets.ORACLE,
        "op6_jump_shards": sharding.ORACLE,
        "op8_warc_round_trip": warc.ORACLE,
        "op10_benchmark_containment": decontam.ORACLE,
    }
