"""From raw documents to packed batches, stage by stage.

Each stage takes all the documents that the one before it kept, and its decisions
take effect.  Stages are written as Parquet between each other.

Defined cases, for every stage: an empty table gives an empty one; a null text counts as empty (language ID rejects
it, and any text without a letter); texts of any length are worked on whole; repeated rows are documents of their own until the
n-gram join, which keeps one of them; a null doc_id is an id like others, less than any; more columns of any name pass through all stages
but the last unchanged, also where an operator has a result of that name (columns that begin with two underscores are the operators').
Ties: of a group of near copies the least doc_id stays, then the least hash of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, lang_id, line_dedup, ngram_join, packing, quality
from tesserae.llm.queries import piece_model


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't rejected."""
    return lang_id.known_language(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1, names=("__lines", "__dropped"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id."""
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of each document."""
    return packing.pack_documents(docs, piece_model)


STAGES = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("packing", packed),
]

#: Models, MinHash and the tokenizer are beyond SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
