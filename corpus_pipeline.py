"""A training corpus from raw documents: language, exact copies, near copies, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import exact_dedup, langid, mixing, ngram_join, packing
from knotwork.storage import new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is told; the model is learned from docs' own lang.

    Texts that are null, empty or have nothing known go, and those that two languages fit about as well. Repeated rows are
    judged alike; rows without doc_id are judged like others; without any labelled row nothing stays.
    """
    return langid.accepted_only(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each text, byte for byte: that of least doc_id. Rows without doc_id or without text stay."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one text of each class of near copies: that of least doc_id. Rows without doc_id, and texts that are null or
    have no word, stay."""
    return ngram_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as docs has with text, mixed by source to the default weights; a row may come more than once.

    Null and empty texts and rows without doc_id are never chosen; of rows that tie, as many as there are places.
    """
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, tokens, bin): where each piece of each document goes, in true tokens; repeated rows are packed each.

    Null and empty texts and rows without doc_id have no row; a text longer than a sequence is cut.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("sequences", sequences)]

#: The near-copy and packing stages are beyond SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"{name}-")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
