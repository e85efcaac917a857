"""Joins that hold up when a lookup side grows or a key is crowded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse.staging import stage

# A lookup side is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024

# A key of a cell join with more rows or tiles than this is worked on by several tasks.
ROWS_PER_PART = 20_000
TILES_PER_PART = 2_000


def measured_bytes(df: DataFrame) -> int:
    """In-memory size estimate from the actual rows; meant for staged frames."""
    fixed, variable = 0, []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            variable.append(F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)))
        elif isinstance(field.dataType, T.ArrayType):
            variable.append(F.coalesce(F.size(F.col(field.name)), F.lit(0)) * 24)
        fixed += 16
    width = F.lit(fixed)
    for part in variable:
        width = width + part
    return df.agg(F.sum(width.cast("bigint")).alias("bytes")).first()["bytes"] or 0


def is_small(df: DataFrame) -> bool:
    return measured_bytes(df) <= BROADCAST_BYTES


def small_side(df: DataFrame) -> DataFrame:
    """Hint a broadcast when the measured size allows it.

    Beyond the limit the frame is returned unhinted: the join then shuffles on
    its keys and skewed partitions are split at run time.
    """
    return F.broadcast(df) if is_small(df) else df


def _counts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def crowded_cells(rows: DataFrame, tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with too many rows or tiles for one task, with the parts either side is cut into."""
    n_rows, n_tiles = _counts(rows, list(keys), "n_rows"), _counts(tiles, list(keys), "n_tiles")
    many = (F.col("n_rows") > ROWS_PER_PART) | (F.col("n_tiles") > TILES_PER_PART)
    parts = {
        "row_parts": F.ceil(F.col("n_rows") / F.lit(ROWS_PER_PART)).cast("int"),
        "tile_parts": F.ceil(F.col("n_tiles") / F.lit(TILES_PER_PART)).cast("int"),
    }
    return n_rows.join(n_tiles, list(keys)).where(many).select(
        *keys, *[c.alias(name) for name, c in parts.items()]
    )


def cell_join(rows: DataFrame, tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of the distinct `rows` with `tiles` on cells, any of them crowded on either side.

    Copies are dropped before they meet anything. With small `tiles`, none of whose cells is
    crowded, rows of other cells are dropped too, and the tiles are sent to the rows.
    Otherwise a crowded cell is cut into rectangles: its rows and its tiles are each
    dealt out over parts by their hash, rows are repeated for each part of the tiles and tiles for
    each part of the rows. Each pair meets in one rectangle, of bounded size, so no pair is lost or
    doubled and no task has a whole cell. Input size does not show how many pairs a cell makes, so
    run-time skew handling alone would leave them to one task. Hand in staged `tiles`.
    """
    keys = list(keys)
    if is_small(tiles):
        fullest = _counts(tiles, keys, "n_tiles").agg(F.max("n_tiles")).first()[0] or 0
        cells = F.broadcast(tiles.select(*keys).distinct())
        rows = rows.join(cells, keys, "left_semi").distinct()
        if fullest <= TILES_PER_PART:
            return rows.join(F.broadcast(tiles), keys)
    else:
        rows = rows.distinct()
    crowded = stage(crowded_cells(rows, tiles, keys), "crowded-cells")
    if crowded.isEmpty():
        return rows.join(tiles, keys)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = small_side(crowded)

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        parts = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        mine = F.pmod(F.xxhash64(*side.columns), parts[0]).cast("int")
        placed = side.join(crowded, keys, "left").select(
            *side.columns, mine.alias(own), F.explode(F.sequence(F.lit(0), parts[1] - 1)).alias(other)
        )
        # A count of partitions that is asked for stays: by their bytes rectangles look small.
        return placed.repartition(tasks, *keys, "row_parts", "tile_parts")

    joined = dealt(rows, "row_parts", "tile_parts").join(
        dealt(tiles, "tile_parts", "row_parts"), [*keys, "row_parts", "tile_parts"]
    )
    return joined.drop("row_parts", "tile_parts")
