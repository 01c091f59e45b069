"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes whole texts of any length, and tables without rows, which stay so. Columns besides those of documents
may have any names and types; they stay as they are in all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, mixing, pii, queries, simhash
from graphloom.plans.store import clear, settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: those it rejects go. It learns from the labelled documents themselves.

    Null and empty texts, and those without a letter, are rejected. Repeated rows are judged alike, each by itself.
    """
    return langid.accepted(docs, queries.language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, null ids last.

    Ties of one id go to the smallest hash of the text, then of the whole row; of rows alike in every column one stays.
    """
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal data. Texts keep their lengths, so n_chars stays right. Null and empty texts stay as they are."""
    return pii.pseudonymise(docs, pii.secret_of(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to twice. Null sources are one source; null ids stand first among equal sizes; repeated rows have copies each."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document that the mix has, as often as it has it: its id, its number of tokens and digests of ids and text. A null text counts as empty."""
    return queries.encoded(docs)


#: Name and function of each stage: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.
STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("byte_bpe", encoding)]

#: Trained models, fingerprints by XXH64 and keyed permutations can't be written in SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is stored as Parquet in the shared folder and read again.

    A stage's table is deleted when the next one is stored; the last of them, which the result reads, when the caller
    calls plans.store.clear.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        old = path
        docs, path = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if old:
            clear(spark, [old])
    return STAGES[-1][1](spark, docs, sf_dir)
