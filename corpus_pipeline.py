"""From raw documents to a training mixture: quality, exact copies, near copies, source mixing, token ids.

Defined results: a NULL text is empty, and empty texts are copies of each other; a NULL source is a source of its own; NULL
ids are rows like others (in a group the smallest id stays, NULL last); of rows that repeat id and text one stays before
mixing, which may repeat it; an empty table gives an empty table with all columns. Further columns are kept whatever their
names, except that ``token_ids`` and ``n_tokens`` hold the last stage's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textlake.llm import bpe, exact, mixing, near, quality
from textlake.llm.common import written
from textlake.llm.queries import rank_file


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_duplicates(docs)


def unalike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's rate asks for."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, its text read back from them, and their number."""
    return bpe.recoded(docs, bpe.load(spark, *rank_file())).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", unalike), ("mixing", mixed), ("bpe", encoded)]

#: A trained classifier and sketches are beyond SQL; tests/llm compares each stage's operator with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
