"""Corpus pipeline: reject bad documents, keep one of each near copy, take personal data out, pack.

A stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and returns a DataFrame. All but the last return the columns of documents.
Null and empty texts, null and repeated ids, extra columns and empty tables have
the results that the operators state: ``quality.keep_good``, ``simhash.keep_first``,
``pii.sanitize`` and ``packing.pack``. SQL can't express the stages, so ORACLE_SQL is None and tests hold each of them
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import idfiles, packing, pii, quality, simhash
from lexiloom.llm.common import new_folder, read_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash component."""
    return simhash.keep_first(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised."""
    return pii.sanitize(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or piece of one, in training sequences of tokens."""
    return packing.pack(docs, length=idfiles.n_tokens())


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
