"""Stored tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse.params import period_of


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the table, or, of a table in folders, the folders that `df` has rows for."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def fact_order(measurements: DataFrame, folder: str | None = None) -> DataFrame:
    """The fact table as it is best written, one folder per period or value of `folder`.

    Rows are ordered by day and bucket inside each file, so a slice skips the
    row groups it does not need. Periods are first brought together, a long one
    over several tasks, so that no task writes a small file into every folder.
    """
    keys = [folder] if folder else period_of(measurements)
    if keys:
        measurements = measurements.hint("rebalance", *keys)
    return measurements.sortWithinPartitions(*keys, "dow", "bucket", "site_id")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Stored table; with a schema, folder names are read as the type they had."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_slice_csv(export: DataFrame, path: str) -> None:
    """One headed CSV per range of the sort order; file names follow that order."""
    export.orderBy(F.asc_nulls_last("speed")).write.mode("overwrite").option(
        "header", True
    ).option("escape", '"').csv(path)
