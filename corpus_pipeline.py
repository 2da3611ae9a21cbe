"""A training corpus from ``documents``: quality rules, line de-duplication, near-duplicates, decontamination, mixing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of ``documents``; the last returns a row per copy the mix takes, with ``copy`` and
the figures it is drawn by. Rows that share doc_id are told apart by their place in the table; of equal rows in a group one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm import decontaminate, linededup, mixing, neardup, quality
from placehull.llm.base import table
from placehull.session import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality and base test are good."""
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated line runs cut from their texts."""
    cut = linededup.drop_repeats(docs).select(*docs.columns)
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.length("text").cast(kind))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes."""
    return mixing.emit(mixing.plan_mix(docs))


STAGES = [
    ("quality", good_documents),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_per_group),
    ("decontamination", clean_of_benchmark),
    ("mix", mixed),
]

#: The latent search and the estimate of the groups' candidates have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
