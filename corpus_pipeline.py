"""From raw documents to packed sequences: the operators of lanepulse.llm in a row."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.llm import minhash_near, mixing, packing, quality, substring_dedup
from lanepulse.staging import session_folder

# The stages' fitting, corpus counts and draws cannot be said in SQL.
ORACLE_SQL = None
ACCEPT = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score the classifier, fitted on the labels given, accepts."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, model, "score_of_stage").where(
        F.col("score_of_stage") >= ACCEPT
    ).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; texts without words all stay."""
    return minhash_near.first_of_groups(docs)


def without_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without paragraphs that near-repeat an earlier one; n_chars follows."""
    return substring_dedup.with_kept_text(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, towards the target weights of their sources."""
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their token ids, and their place in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        F.col("id").alias("doc_id"), F.col("key").alias("row_key"), "start", "length", "ids_crc32",
        "doc_tokens", "ids", "sequence_id", "offset",
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", one_of_each_group),
    ("substring dedup", without_repeated_paragraphs),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{session_folder(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
