"""The corpus pipeline: language, near duplicates, benchmark leaks, mix of sources, token files.

Each stage takes what the one before has kept, as a table with the columns of documents; the last
writes token files and returns a row for each document that it reads back from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import settle
from plumbline.llm.decontam import without_contained
from plumbline.llm.langid import accept
from plumbline.llm.mixing import mix_sources, production_mix
from plumbline.llm.similar import keep_one_of_similar
from plumbline.llm.tokenfile import token_files


#: Rows that a stage's Python workers are handed at a time; long texts would otherwise fill them.
BATCH = 1000
#: Vocabulary by which the mix counts and the last stage encodes.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Chunks whose counts, then ids, a worker remembers: fewer than alone, as an executor's JVM has kept what earlier stages took.
COUNTED, REMEMBERED = 100_000, 150_000


def frugal(spark: SparkSession) -> None:
    """From now on the session hands Python workers smaller batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or like no language learned, go.

    Null and empty texts go. Rows are judged one by one: repeated ones go or stay together. All columns
    stay, whatever their names; an empty table stays empty.
    """
    frugal(spark)
    return accept(docs, "doc_id", "text", "lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (a Jaccard index of 0.8 or more of five-word shingles): that with the smallest doc_id.

    Null, empty and wordless texts are copies of each other. A row without an id stays only if its group
    has no id; of repeated rows one stays. All columns stay; an empty table stays empty.
    """
    frugal(spark)
    return keep_one_of_similar(docs, "doc_id", "text", words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and wordless texts contain none.

    Rows are judged one by one. All columns stay; an empty table stays empty, and without items all stay.
    """
    frugal(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_contained(docs, "text", items, "item_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, a row for each epoch.

    Null languages and sources are leaves of their own; leaves without tokens aren't taken. Rows that
    share an id go together. All columns stay; an empty table stays empty.
    """
    frugal(spark)
    taken = mix_sources(docs, "doc_id", "text", "lang", "source", production_mix(), VOCABULARY, COUNTED)
    return taken.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, read back: a row for each row of docs, in ascending order of doc_id, nulls first.

    Null texts are empty, with the end id only; equal ids are ordered by text. Other columns aren't written. An
    empty table gives an empty result.
    """
    frugal(spark)
    return token_files(docs, "doc_id", "text", VOCABULARY, remembered=REMEMBERED)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokenize", tokenize),
]

#: Training a network and merging tokens can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
