"""One query per operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.llm import (
    fingerprints, hard_negatives, license_scan, minhash_near, mixing, packing, periodic_runs, quality, reshard,
    substring_dedup, suffix_dedup, topk, warc,
)
from lanepulse.staging import session_folder, stage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return suffix_dedup.remove_repeats(docs, with_bytes=False).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    where, manifest = warc.write_archives(_table(spark, folder, "pages"))
    rows = warc.read_archives(spark, where, manifest, with_payload=False).where("kind = 'record'")
    return rows.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.fit_quality(docs, _table(spark, folder, "labels"))
    return quality.score_quality(docs, model).select(
        F.col("id").alias("doc_id"), quality.is_held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return substring_dedup.remove_paragraphs(docs).select(
        F.col("id").alias("doc_id"), "n_paragraphs", "n_removed", "removed", "kept_sha256",
        F.col("kept").alias("text"),
    )


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint(_table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "same_start_next",
    )


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    # Whole documents are repeated, shuffled and written; the SQL names the columns shown of them.
    mixed = stage(mixing.mix(_table(spark, folder, "documents")), "mixed-documents")
    return mixed.select("doc_id", "source", "rate", "n_copies", "copy", "shuffle_key")


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return minhash_near.near_groups(docs, size=4).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("group_id").alias("component_id"),
        (F.col("key") == F.col("group_key")).alias("kept"),
    )


def op10_reshard(spark: SparkSession, folder: str) -> DataFrame:
    # The columns are taken from the texts as they stand in the rewritten shards.
    docs = _table(spark, folder, "documents")
    shards = reshard.resharded(docs, f"{session_folder(spark)}/shards-{uuid.uuid4().hex[:12]}")
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), reshard.hashed_shard(text).alias("old_shard"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, folder, "embeddings").withColumn("label", label))


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    scanned = license_scan.scan_licenses(_table(spark, folder, "documents"))
    return license_scan.license_columns(scanned).withColumnRenamed("id", "doc_id")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.with_looped_tails(_table(spark, folder, "documents"))
    return periodic_runs.run_columns(periodic_runs.periodic_runs(docs)).withColumnRenamed("id", "doc_id")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_suffix_dedup, op2_warc, op3_quality, op4_packing, op5_substring_dedup, op6_fingerprints,
            op7_topk, op8_mixing, op9_minhash, op10_reshard, op11_hard_negatives, op12_licenses,
            op13_periodic_runs,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": OP7_SQL, "op8_mixing": mixing.MIX_SQL, "op11_hard_negatives": hard_negatives.MINE_SQL}
