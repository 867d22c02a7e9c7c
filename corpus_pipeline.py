"""The corpus pipeline: language, exact and near duplicates, mixture and packing, in that order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from starloom.llm.exact_dedup import drop_exact_duplicates
from starloom.llm.language import keep_identified
from starloom.llm.mixing import mixed_corpus
from starloom.llm.near_dedup import drop_near_duplicates
from starloom.llm.packing import pack_documents


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, null and empty texts among them, or in no learned language, go.

    Whole texts are judged row by row, repeated rows and null ids too; all columns stay, and an empty table stays empty.
    """
    return keep_identified(docs, least=0.25)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; null counts as empty, rows that share the kept id stay together, all columns and long texts stay whole."""
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Null and empty texts stand alone and stay; rows with equal ids are judged by their own texts; a null id goes where its
    group has an id. All columns and whole texts stay, and an empty table stays empty.
    """
    return drop_near_duplicates(docs, length=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mixture takes them, whole and with all columns; null and empty texts have no words to take. A null source is a source."""
    return mixed_corpus(docs, weights=(1, 2, 3), most=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document, copies packed row by row; null texts give the end id alone. No rows give none."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Near duplicates by components and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
