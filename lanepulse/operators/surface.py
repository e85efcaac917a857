"""Kernel-weighted surface over point sensors, as a table of cells.

Each site scatters into the cells of its own cutoff box, so the work is sites
times box size; no site is ever paired with a cell it cannot reach. Slices with a
period give a surface for each period; `by` tells further surfaces apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.functions.geo import distance, gaussian, x_km, y_km
from lanepulse.params import DEFAULTS, Params, period_of

# Each point makes well over a hundred cell rows.
POINTS_PER_TASK = 20_000

# Axes are a handful of numbers per surface.
BROADCAST_AXES = 100_000

_AXES = ("x0", "dx", "nx", "y0", "dy", "ny")


def _keys(slice_: DataFrame, by: Sequence[str]) -> list[str]:
    return [*(k for k in period_of(slice_) if k not in by), *by]


def surface_points(
    slice_: DataFrame, column: str, by: Sequence[str] = (), p: Params = DEFAULTS
) -> DataFrame:
    """Value sum and count per position; sensors at one spot share their weights."""
    # A text that is no number is no value.
    value = F.col(column).try_cast("double")
    return (
        slice_.where(value.isNotNull())
        .groupBy(*by, x_km(F.col("lon"), p).alias("sx"), y_km(F.col("lat"), p).alias("sy"))
        .agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))
    )


def surface_axes(points: DataFrame, by: Sequence[str] = (), p: Params = DEFAULTS) -> DataFrame:
    """Origin, spacing and length of both grid axes, padded by the cutoff.

    The spacing is the difference of the first two cell centres, so that centres
    agree to the last bit with a numeric range over the same ends.
    """
    cut, step = F.lit(p.surface_cutoff_km), F.lit(p.surface_step_km)

    def axis(low: Column, high: Column, name: str) -> list[Column]:
        first = low - cut
        length = F.ceil((high + cut + step - first) / step)
        return [
            first.alias(f"{name}0"),
            ((first + step) - first).alias(f"d{name}"),
            length.alias(f"n{name}"),
        ]

    ends = points.groupBy(*by).agg(
        F.min("sx").alias("x_low"),
        F.max("sx").alias("x_high"),
        F.min("sy").alias("y_low"),
        F.max("sy").alias("y_high"),
    )
    return ends.where(F.col("x_low").isNotNull()).select(
        *by,
        *axis(F.col("x_low"), F.col("x_high"), "x"),
        *axis(F.col("y_low"), F.col("y_high"), "y"),
    )


def balanced_slots(sizes: DataFrame, by: Sequence[str], tasks: int) -> DataFrame:
    """`sizes` with a `slot` each, so that slots have about equal sums of `n`.

    Dealt forth and back from the largest to the smallest. Slots are numbers whose
    hashes fall on different tasks, so that a repartition by them, and a grouping that
    contains them, need no other shuffle. `sizes` is a row per surface and short.
    """
    spark, reach = sizes.sparkSession, 16 * tasks
    while True:
        number = F.col("id").cast("int")
        salts = spark.range(reach).groupBy(F.pmod(F.hash(number), F.lit(tasks)).alias("task")).agg(
            F.min(number).alias("slot")
        )
        salts = {r["task"]: r["slot"] for r in salts.collect()}
        if len(salts) == tasks:
            break
        reach *= 2
    turn = (F.row_number().over(Window.orderBy(F.desc("n"), *by)) - 1) % (2 * tasks)
    task = F.when(turn < tasks, turn).otherwise(2 * tasks - 1 - turn)
    numbered = F.element_at(F.array(*[F.lit(salts[t]) for t in range(tasks)]), task + 1)
    return sizes.withColumn("slot", numbered)


def _with_axes(points: DataFrame, axes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points with the axes of their grid.

    Points of one surface are brought into one task where all surfaces are small
    enough, and tasks get about equally many points: cells are then summed where they are
    made, and only points are shuffled. Larger surfaces stay spread, and their cells are
    combined by a shuffle.
    """
    if not by:
        row = axes.select(F.struct(*_AXES)).scalar()
        return points.withColumn("axes", row).select("*", "axes.*").drop("axes")
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    largest, n_surfaces = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    small = (largest or 0) <= POINTS_PER_TASK
    if n_surfaces > BROADCAST_AXES:
        tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return (points.repartition(tasks, *by) if small else points).join(axes, list(by))
    if small:
        tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slots = balanced_slots(sizes, by, tasks).drop("n")
        points = points.join(F.broadcast(slots), list(by)).repartition(tasks, "slot")
    return points.join(F.broadcast(axes), list(by))


def _reach(at: str, origin: str, spacing: str, length: str, p: Params) -> Column:
    """Indices within the cutoff of a position, one cell wider than needed each way."""
    offset, cut = F.col(at) - F.col(origin), F.lit(p.surface_cutoff_km)
    low = F.floor((offset - cut) / F.col(spacing)) - 1
    high = F.ceil((offset + cut) / F.col(spacing)) + 1
    return F.sequence(
        F.greatest(low, F.lit(0)).cast("bigint"),
        F.least(high, F.col(length) - 1).cast("bigint"),
    )


def surface_cells(
    slice_: DataFrame, column: str, *, by: Sequence[str] = (), p: Params = DEFAULTS
) -> DataFrame:
    """Supported cells as (i, j, value, support); i runs east, j runs north."""
    by = _keys(slice_, by)
    points = surface_points(slice_, column, by, p)
    placed = _with_axes(points, surface_axes(points, by, p), by)
    cells = placed.withColumn("i", F.explode(_reach("sx", "x0", "dx", "nx", p))).withColumn(
        "j", F.explode(_reach("sy", "y0", "dy", "ny", p))
    )
    apart = distance(
        F.col("x0") + F.col("i") * F.col("dx"),
        F.col("y0") + F.col("j") * F.col("dy"),
        F.col("sx"),
        F.col("sy"),
    )
    weight = gaussian(F.col("d"), p.surface_bandwidth_km)
    sums = (
        cells.withColumn("d", apart)
        .where(F.col("d") <= p.surface_cutoff_km)
        .groupBy(*[c for c in ("slot",) if c in placed.columns], *by, "i", "j")
        .agg(
            F.sum(weight * F.col("v")).alias("weighted"),
            F.sum(weight * F.col("n")).alias("support"),
        )
    )
    return sums.where(F.col("support") > 0).select(
        *by, "i", "j", (F.col("weighted") / F.col("support")).alias("value"), "support"
    )


def surface_grid(
    slice_: DataFrame, column: str, *, by: Sequence[str] = (), p: Params = DEFAULTS
) -> DataFrame:
    """Every cell of the grid; unsupported ones have no value and support 0."""
    by = _keys(slice_, by)
    axes = surface_axes(surface_points(slice_, column, by, p), by, p)
    columns = axes.select(*by, "ny", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"))
    # One axis first, then spread: no task lays out the whole grid.
    grid = columns.repartition(*by, "i").select(
        *by, "i", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j")
    )
    cells = surface_cells(slice_, column, by=by, p=p)
    return grid.join(cells, [*by, "i", "j"], "left").withColumn(
        "support", F.coalesce("support", F.lit(0.0))
    )


def surface_bounds(
    slice_: DataFrame, column: str, *, by: Sequence[str] = (), p: Params = DEFAULTS
) -> DataFrame:
    """Outer edges of the grid in degrees, and its shape."""
    by = _keys(slice_, by)
    axes = surface_axes(surface_points(slice_, column, by, p), by, p)
    half = p.surface_step_km / 2

    def edge(origin: str, spacing: str, index: Column, shift: float, scale: float) -> Column:
        return (F.col(origin) + index * F.col(spacing) + shift) / F.lit(scale)

    first = F.lit(0)
    return axes.select(
        *by,
        edge("x0", "dx", first, -half, p.km_per_deg_lon).alias("west"),
        edge("y0", "dy", first, -half, p.km_per_deg_lat).alias("south"),
        edge("x0", "dx", F.col("nx") - 1, half, p.km_per_deg_lon).alias("east"),
        edge("y0", "dy", F.col("ny") - 1, half, p.km_per_deg_lat).alias("north"),
        "nx",
        "ny",
    )


def supported_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*_keys(cells, by)).agg(F.count(F.lit(1)).alias("n_supported"))
