"""Health of single lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.operators.cleaning import COUNTERS
from lanepulse.params import DEFAULTS, LANE_KEY, Params, period_of


def n_valid() -> Column:
    return F.col("n_rows") - F.col("n_missing") - F.col("n_implausible")


def lane_totals(cells: DataFrame) -> DataFrame:
    """Lifetime counters per lane; readings with an empty street column drop out."""
    placed = cells.where(F.col("site_id").isNotNull())
    return placed.groupBy(*period_of(cells), *LANE_KEY).agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.sum("speed_sum").alias("speed_sum")
    )


def lane_health(lanes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Lanes with a valid reading; dead if never moving or never above a crawl."""
    mean = F.try_divide(F.col("speed_sum"), F.col("n_moving"))
    return lanes.where(n_valid() > 0).select(
        *period_of(lanes),
        *LANE_KEY,
        "n_moving",
        mean.alias("mean_speed"),
        ((F.col("n_moving") == 0) | (mean < p.flatline_speed)).alias("is_dead"),
        n_valid().alias("n_valid"),
        "n_zero",
        "speed_sum",
    )


def live_lanes(health: DataFrame) -> DataFrame:
    """Lanes whose readings count. A lane without an id joins nothing."""
    named = F.col("detector_id").isNotNull() & F.col("lane").isNotNull()
    return health.where(~F.col("is_dead") & named)


def dead_lane_report(health: DataFrame) -> DataFrame:
    """Dead and total lanes, and the readings dropped with the dead ones."""
    named = F.col("detector_id").isNotNull() & F.col("lane").isNotNull()

    def dropped(counter: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("is_dead") & named, F.col(counter))), F.lit(0))

    return health.groupBy(*period_of(health)).agg(
        F.count_if("is_dead").alias("n_dead_lanes"),
        F.count(F.lit(1)).alias("n_lanes"),
        dropped("n_zero").alias("dead_zero_readings"),
        dropped("n_moving").alias("dead_moving_readings"),
    )
