"""The stored fact table and the site dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.functions.clock import day_of_week
from lanepulse.joins import small_side
from lanepulse.operators.lanes import live_lanes, n_valid
from lanepulse.params import DEFAULTS, LANE_KEY, SITE_KEY, Params, period_of


def measurements(cells: DataFrame, health: DataFrame) -> DataFrame:
    """Cells of live lanes.

    Cells are already one row per lane, date and bucket, so this is a lookup and
    not a second aggregation; no lane can hold more rows than its days allow.
    """
    keys = period_of(cells)
    alive = small_side(live_lanes(health).select(*keys, *LANE_KEY))
    return (
        cells.where(n_valid() > 0)
        .join(alive, [*keys, *LANE_KEY], "left_semi")
        .select(
            *keys,
            *LANE_KEY,
            "date",
            "bucket",
            day_of_week(F.col("date")).alias("dow"),
            "speed_sum",
            "n_moving",
            "n_zero",
        )
    )


def rhythm_sums(p: Params = DEFAULTS) -> dict[str, Column]:
    """Sums and counts of moving readings on weekdays by day and by night; they add up over any rows."""

    def inside(hours: tuple[int, int], counter: str) -> Column:
        low, high = p.bucket_range(hours)
        within = (F.col("bucket") >= low) & (F.col("bucket") < high) & F.col("dow").between(1, 5)
        return F.sum(F.when(within, F.col(counter)))

    return {
        f"{name}_{counter}": inside(hours, counter)
        for name, hours in (("day", p.stalled_day_hours), ("night", p.stalled_night_hours))
        for counter in ("speed_sum", "n_moving")
    }


def day_night(facts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Weekday mean speed by day and by night per site."""
    sums = rhythm_sums(p)
    per_site = facts.where(F.col("dow").between(1, 5)).groupBy(*period_of(facts), "site_id").agg(
        *[column.alias(name) for name, column in sums.items()]
    )
    return day_night_means(per_site, list(sums))


def day_night_means(per_site: DataFrame, sums: list[str]) -> DataFrame:
    """Means from the columns that rhythm_sums() made."""
    others = [c for c in per_site.columns if c not in sums]
    return per_site.select(
        *others,
        *[
            F.try_divide(f"{name}_speed_sum", f"{name}_n_moving").alias(f"{name}_speed")
            for name in ("day", "night")
        ],
    )


def free_flow(histogram: DataFrame, health: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Exact high percentile of the moving readings of live lanes, per site.

    Works on counts per speed value, so a site with any number of readings is
    one short list.
    """
    keys = period_of(histogram)
    alive = small_side(live_lanes(health).select(*keys, *LANE_KEY))
    counts = (
        histogram.join(alive, [*keys, *LANE_KEY], "left_semi")
        .groupBy(*keys, "site_id", "speed")
        .agg(F.sum("n").alias("n"))
    )
    return counts.groupBy(*keys, "site_id").agg(
        F.percentile("speed", F.lit(p.free_flow_percentile), F.col("n")).alias(
            "free_flow_speed"
        )
    )


def _live_profile(health: DataFrame) -> DataFrame:
    return (
        live_lanes(health)
        .groupBy(*period_of(health), "site_id")
        .agg(
            F.count_distinct("detector_id").alias("n_detectors"),
            F.count_distinct("lane").alias("n_lanes"),
            F.sum("n_valid").alias("n_readings"),
            F.sum("n_zero").alias("n_zero"),
            F.try_divide(F.sum("speed_sum"), F.sum("n_moving")).alias("mean_speed"),
        )
    )


def detectors(
    sites: DataFrame,
    lanes: DataFrame,
    health: DataFrame,
    histogram: DataFrame,
    rhythm: DataFrame,
    claims: DataFrame,
    p: Params = DEFAULTS,
) -> DataFrame:
    """One row per site that reported anything valid, with its lifetime figures.

    Each figure is aggregated to one row per site first, so every join here is
    between site-sized tables. A site whose lanes are all dead stays, with no mean.
    `rhythm` are the means of day_night(), `claims` the streets per position, in each period
    where there are several.
    """
    keys = [*period_of(lanes), "site_id"]
    per_site = lanes.groupBy(*keys).agg(F.sum("n_missing").alias("n_missing"))
    dead = health.groupBy(*keys).agg(F.count_if("is_dead").alias("n_dead_lanes"))
    zero = ("n_detectors", "n_lanes", "n_readings", "n_zero")
    return (
        # `dead` has a row for exactly the sites with a valid reading.
        per_site.join(dead, keys)
        .join(sites.select("site_id", *SITE_KEY), "site_id")
        .join(claims, [*period_of(lanes), "lat", "lon"])
        .join(_live_profile(health), keys, "left")
        .join(free_flow(histogram, health, p), keys, "left")
        .join(rhythm, keys, "left")
        .fillna(0, list(zero))
        .select(
            *keys,
            *SITE_KEY,
            *zero,
            "mean_speed",
            "free_flow_speed",
            "n_missing",
            "streets_at_coord",
            "day_speed",
            "night_speed",
            "n_dead_lanes",
        )
    )
