"""A value along each corridor from the sites that stand on it."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.functions.geo import (
    distance,
    gaussian,
    grid_cell,
    neighbour_cells,
    x_km,
    y_km,
)
from lanepulse.joins import cell_join, small_side
from lanepulse.operators.matching import CELL_MARGIN
from lanepulse.params import DEFAULTS, Params
from lanepulse.staging import stage

# Names of the reach models.
BLEND = "blend"
NEAREST = "nearest"
STUB = "stub"
REACH_MODELS = (BLEND, NEAREST, STUB)

# A distance below 100 km to 20 places, and after them a site number of 15 digits, fit one decimal.
PLACES = 20
SITE_DIGITS = 15

CELL = ["corridor_id", "cx", "cy"]
MIDPOINT = ["corridor_id", "mid_lon", "mid_lat"]


def _one_per_site(sites: DataFrame, reading: Column, by: list[str]) -> DataFrame:
    """The columns a field needs; a second row of a site stops the job."""
    row = F.struct("corridor_id", "lon", "lat", reading.alias("reading"))
    merged = sites.groupBy(*by, "site_id").agg(
        F.any_value(row).alias("row"), F.count(F.lit(1)).alias("n")
    )
    twice = F.raise_error(F.lit("a site has several readings: name what tells them apart in `by`"))
    one = F.when(F.col("n") == 1, F.col("row")).otherwise(twice.cast(merged.schema["row"].dataType))
    return merged.withColumn("row", one).select(*by, "site_id", "row.*")


def _spots(sites: DataFrame, by: list[str], width: float, p: Params) -> DataFrame:
    """Readings per corridor and position, in each cell from which they are asked for."""
    reading = F.col("reading")
    return (
        sites.where(reading.isNotNull() & F.col("corridor_id").isNotNull())
        .groupBy(
            *by,
            "corridor_id",
            x_km(F.col("lon"), p).alias("sx"),
            y_km(F.col("lat"), p).alias("sy"),
        )
        .agg(
            F.sum(reading).alias("v"),
            F.count(F.lit(1)).alias("n"),
            # In site order, for sites at one spot.
            F.min("site_id").alias("first_id"),
        )
        .withColumns(
            {"gx": grid_cell(F.col("sx"), width), "gy": grid_cell(F.col("sy"), width)}
        )
        .withColumn("c", F.explode(neighbour_cells("gx", "gy")))
        .select(*by, "corridor_id", "c.cx", "c.cy", "sx", "sy", "v", "n", "first_id")
    )


def _by_distance(d: Column, site: Column) -> Column:
    """One decimal that orders by distance and then by site, so that a plain minimum finds both."""
    behind = F.lit(Decimal(1).scaleb(-SITE_DIGITS)), F.lit(Decimal(1).scaleb(-PLACES))
    fraction = (site.cast(f"decimal({SITE_DIGITS},0)") * behind[0]).cast(f"decimal({SITE_DIGITS + 1},{SITE_DIGITS})")
    scale = PLACES + SITE_DIGITS
    key = d.cast(f"decimal({PLACES + 2},{PLACES})").cast(f"decimal({scale + 2},{scale})") + (
        fraction * behind[1]
    ).cast(f"decimal({scale + 2},{scale})")
    fits = (site >= 0) & (site < 10**SITE_DIGITS) & (d < 100)
    odd = F.raise_error(F.lit(f"site numbers must have {SITE_DIGITS} digits at most, and reaches 99 km"))
    return F.when(fits, key).otherwise(odd.cast(f"decimal({scale + 3},{scale})"))


def _distance_and_site(key: Column) -> tuple[Column, Column]:
    """What _by_distance() put together."""
    text = F.to_char(key, F.lit("00." + "0" * (PLACES + SITE_DIGITS)))
    d = F.substring(text, F.lit(1), F.length(text) - SITE_DIGITS).cast("double")
    return d, F.right(text, F.lit(SITE_DIGITS)).cast("bigint")


def street_field(
    chunks: DataFrame,
    sites: DataFrame,
    column: str,
    *,
    mode: str = BLEND,
    by: Sequence[str] = (),
    p: Params = DEFAULTS,
) -> DataFrame:
    """All chunks with `value` (NULL if nothing reaches them) and `support`.

    `sites` carry a `corridor_id`. Blend averages the corridor's sites by
    distance; nearest gives a chunk to its closest site; stub does so only close
    to the site. Midpoints and spots meet on corridor and cell, so a long
    corridor is not paired with all of its sites, and what stands or lies at one
    point is worked out once.

    `by` names columns of `sites` that tell slices apart, such as a period. Each
    slice is then a field of its own over all chunks, so the result is chunks times slices.
    """
    if mode not in REACH_MODELS:
        raise ValueError(f"{mode!r} names no way to reach a chunk; there are {REACH_MODELS}")
    reach = p.street_stub_km if mode == STUB else p.street_cutoff_km
    width = reach * CELL_MARGIN
    by = list(by)
    readings = stage(_one_per_site(sites, F.col(column).try_cast("double"), by), "readings")
    spots = stage(_spots(readings, by, width, p), "spots")
    cell, midpoint = [*by, *CELL], [*by, *MIDPOINT]
    asked = chunks
    if by:
        # Midpoints only of corridors with sites, the result for all chunks.
        asked = chunks.join(small_side(spots.select(*by, "corridor_id").distinct()), "corridor_id")
        listed = sites.select(F.struct(*by).alias("s")).distinct().agg(F.collect_list("s")).scalar()
        chunks = chunks.withColumn("s", F.explode(listed)).select("*", "s.*").drop("s")

    placed = (
        asked.select(*midpoint)
        .withColumns({"mx": x_km(F.col("mid_lon"), p), "my": y_km(F.col("mid_lat"), p)})
        .withColumns({"cx": grid_cell(F.col("mx"), width), "cy": grid_cell(F.col("my"), width)})
    )
    apart = distance(F.col("mx"), F.col("my"), F.col("sx"), F.col("sy"))

    def reached(midpoints: DataFrame) -> DataFrame:
        pairs = cell_join(midpoints, spots, cell).withColumn("d", apart)
        return pairs.where(F.col("d") <= reach)

    if mode == BLEND:
        weight = gaussian(F.col("d"), p.street_bandwidth_km)
        support = F.sum(weight * F.col("n"))
        value = F.sum(weight * F.col("v")) / support
        found = reached(placed).groupBy(*midpoint).agg(
            support.alias("support"), value.alias("value")
        )
    else:
        nearest = F.min(_by_distance(F.col("d"), F.col("first_id"))).alias("nearest")
        gap, site = _distance_and_site(F.col("nearest"))
        found = (
            reached(placed)
            .groupBy(*midpoint)
            .agg(nearest)
            .select(*midpoint, gap.alias("gap"), site.alias("site_id"))
            .join(small_side(readings.select(*by, "site_id", F.col("reading").alias("value"))), [*by, "site_id"])
            .withColumn("support", gaussian(F.col("gap"), p.street_bandwidth_km))
        )
    supported = F.col("support") > 0
    return chunks.join(found, midpoint, "left").select(
        *chunks.columns,
        F.when(supported, F.col("value")).alias("value"),
        F.coalesce("support", F.lit(0.0)).alias("support"),
    )
