"""Local flat projection and distances, in kilometres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanepulse.params import DEFAULTS, Params


def x_km(lon: Column, p: Params = DEFAULTS) -> Column:
    return lon * F.lit(p.km_per_deg_lon)


def y_km(lat: Column, p: Params = DEFAULTS) -> Column:
    return lat * F.lit(p.km_per_deg_lat)


def grid_cell(km: Column, width_km: float) -> Column:
    return F.floor(km / F.lit(width_km)).cast("bigint")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def clamp(value: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(
        value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low))
    )


def segment_distance(
    px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column
) -> Column:
    """Distance from a point to the segment a-b; a zero-length segment is a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    square = F.when(square > 0, square).otherwise(F.lit(1e-12))
    rx, ry = px - ax, py - ay
    along = clamp((rx * dx + ry * dy) / square, 0.0, 1.0)
    return F.hypot(rx - along * dx, ry - along * dy)


def gaussian(dist: Column, bandwidth_km: float) -> Column:
    scaled = dist / F.lit(bandwidth_km)
    return F.exp(-(scaled * scaled))


def neighbour_cells(cx: str, cy: str) -> Column:
    """The 3 x 3 block of cells around (cx, cy), as an array to explode."""
    return F.array(
        *[
            F.struct((F.col(cx) + dx).alias("cx"), (F.col(cy) + dy).alias("cy"))
            for dx in (-1, 0, 1)
            for dy in (-1, 0, 1)
        ]
    )
