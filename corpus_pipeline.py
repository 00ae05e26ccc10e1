"""Training corpus from ``documents``: quality model, near-duplicates, pseudonyms, source mix, token ids.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of ``docs``; the last returns
token ids. The near-duplicate stage decides by row: of a group of near texts one row stays (that of the smallest id; rows without an id come last), whatever ids
the rows carry or share, and different texts under one id stay both. Mixing repeats and leaves out documents as its targets ask for.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from votelens.llm import bpe, minhash, mixing, pii, quality
from votelens.session import land

ORACLE_SQL = None      # a fitted model and merges are not SQL; tests/llm compares with plain Python


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    p = quality.QualityParams()
    return quality.keep_rows(docs, quality.fit(docs, labels, p), p, quality.fit_toxic(docs, labels, p))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by numbers of their own, in the order of doc_id (nulls last), so that a group's smallest row is that of its smallest id
    rows = land(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("at", F.monotonically_increasing_id()), "pipeline-rows")
    text, id_ = F.col("row.text").alias("text"), F.col("row.doc_id")
    place = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.col("at"))
    first = minhash.groups(rows.select(place.alias("doc_id"), text)).where("kept").select(F.col("doc_id.at").alias("at"))
    return rows.join(first, "at", "left_semi").select("row.*")


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, pii.session_params(spark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenised(docs)


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", near_duplicates), ("pii_pseudonyms", private_values),
          ("mix_sources", source_mix), ("byte_bpe", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
