"""The registered query of each operator: the operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, gif, langid, mixing, pii, quality, sharding, simhash, tokenfile, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = langid.remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs.where(~held), labels.where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


def encoded(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of what they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir), pii.secret_of(spark))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.features(gif.stored(documents(spark, sf_dir)))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.new_folder(spark)
    written = tokenfile.write(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return tokenfile.read(spark, folder, written)


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(langid.remainder(F.col("doc_id"), 4) != 2))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", (langid.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_toxicity": op1_toxicity, "op2_sharding": op2_sharding, "op3_simhash": op3_simhash, "op4_quality": op4_quality, "op5_byte_bpe": op5_byte_bpe, "op6_pii": op6_pii, "op7_gif": op7_gif, "op8_token_file": op8_token_file, "op9_language_id": op9_language_id, "op10_mixing": op10_mixing}
ORACLES = {"op2_sharding": sharding.ORACLE, "op10_mixing": mixing.ORACLE}
