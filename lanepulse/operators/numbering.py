"""Dense ids in sort order without pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.staging import stage, stage_observed

# Up to this many rows one ordered task is cheaper than a range exchange.
ROWS_PER_SLICE = 500_000


def with_offsets(groups: DataFrame, order_by: list[str]) -> DataFrame:
    """Groups with `before`, the sum of `n` over the groups that come earlier; a short table, in one task."""
    earlier = Window.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def dense_ids(
    rows: DataFrame,
    order_by: list[str],
    id_column: str,
    *,
    start: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Number rows, which are distinct on `order_by`, from `start` without gaps.

    NULLs sort last. Large inputs are cut into ordered ranges; each range is
    numbered on its own and shifted by the number of rows before it. The range
    of a row is written down before it is used twice, so that re-run tasks
    cannot disagree about it.
    """
    order = [F.asc_nulls_last(c) for c in order_by]
    rows, seen = stage_observed(rows, f"rows-for-{id_column}", n=F.count(F.lit(1)))
    slices = -(-seen["n"] // rows_per_slice)
    if slices <= 1:
        rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
        return stage(rows.select((rank + (start - 1)).alias(id_column), "*"), id_column)

    sliced = stage(
        rows.repartitionByRange(slices, *order).withColumn(
            "slice", F.spark_partition_id()
        ),
        f"slices-for-{id_column}",
    )
    # One row per slice, so the running total is over a short table.
    offsets = with_offsets(sliced.groupBy("slice").agg(F.count("*").alias("n")), ["slice"]).drop("n")
    rank = F.row_number().over(Window.partitionBy("slice").orderBy(*order))
    numbered = (
        sliced.withColumn("rank", rank)
        .join(F.broadcast(offsets), "slice")
        .withColumn(id_column, (F.col("before") + F.col("rank") + (start - 1)).cast("bigint"))
    )
    return stage(numbered.select(id_column, *rows.columns), id_column)
