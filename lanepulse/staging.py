"""Cutting lineage through written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for local sessions."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="lanepulse-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lanepulse-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write `df` once and read it back.

    The result has no lineage to recompute after a lost executor, and its size
    on disk is known to the planner. With `by`, a column of text, readers that ask for some of its values
    open the files of these alone.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """stage(), with aggregates over the rows that are taken while they are written, not by a job of their own."""
    seen = Observation()
    staged = stage(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]), label)
    return staged, seen.get


def discard_staged(spark: SparkSession) -> None:
    """Delete this session's staged tables; call when the outputs are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
