"""Cleaning, classification and the first roll-up of raw readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.functions.clock import time_bucket
from lanepulse.operators.sites import aggregate_per_site
from lanepulse.params import DEFAULTS, LANE_KEY, UNDATED, Params, period_of

COUNTERS = ["n_rows", "n_missing", "n_implausible", "n_negative", "n_zero", "n_moving"]


def clean_readings(raw: DataFrame) -> DataFrame:
    """Trimmed street columns; rows without a position are dropped."""
    streets = {c: F.trim(c) for c in ("street", "from_street", "to_street")}
    located = raw.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return located.withColumns(streets).withColumn("speed", F.col("speed").cast("double"))


def reading_class(speed: Column, p: Params = DEFAULTS) -> Column:
    return (
        F.when(speed.isNull(), "missing")
        .when(speed > p.max_plausible_speed, "implausible")
        .when(speed > 0, "moving")
        .when(speed == 0, "zero")
        .otherwise("negative")
    )


def plausible(speed: Column, p: Params = DEFAULTS) -> Column:
    """Present and not above the limit; zeros and negatives stay in."""
    return speed.isNotNull() & (speed <= p.max_plausible_speed)


def is_moving(speed: Column, p: Params = DEFAULTS) -> Column:
    return (speed > 0) & (speed <= p.max_plausible_speed)


def _counters(p: Params) -> list[Column]:
    speed = F.col("speed")
    moving = is_moving(speed, p)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(speed.isNull()).alias("n_missing"),
        F.count_if(speed > p.max_plausible_speed).alias("n_implausible"),
        F.count_if(speed < 0).alias("n_negative"),
        F.count_if(speed == 0).alias("n_zero"),
        F.count_if(moving).alias("n_moving"),
        F.sum(F.when(moving, speed)).alias("speed_sum"),
    ]


def with_period(readings: DataFrame, period: Column) -> DataFrame:
    """Judge whole-period rules per `period` instead of over the whole input."""
    return readings.withColumn("period", period)


def named_period(period: Column) -> Column:
    """The period as text; readings without one are a period of their own."""
    return F.coalesce(period.cast("string"), F.lit(UNDATED))


def bucket_cells(
    readings: DataFrame, sites: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Sums and counts per lane, date and time bucket.

    The only wide shuffle over raw rows: partial sums are combined before it, so
    a hot sensor costs one row per cell and map task. Everything but the
    percentile follows from these cells. Readings without a site have no number.
    """
    keyed = readings.withColumn("bucket", time_bucket(F.col("time"), p))

    def per_cell(frame: DataFrame, site: list[str]) -> DataFrame:
        keys = [*period_of(frame), *site, *LANE_KEY[1:], "date", "bucket"]
        return frame.groupBy(*keys).agg(*_counters(p))

    return aggregate_per_site(keyed, sites, per_cell)


def speed_histogram(
    readings: DataFrame, sites: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Number of moving readings per lane and speed value."""

    def per_speed(frame: DataFrame, site: list[str]) -> DataFrame:
        keys = [*period_of(frame), *site, *LANE_KEY[1:], "speed"]
        return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    return aggregate_per_site(readings.where(is_moving(F.col("speed"), p)), sites, per_speed)


def load_report(cells: DataFrame) -> DataFrame:
    """Readings per class with their shares, in one row (per period, if there are several)."""
    totals = cells.groupBy(*period_of(cells)).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS],
        # Readings whose street columns are incomplete never reach a site.
        F.coalesce(
            F.sum(F.when(F.col("site_id").isNull(), F.col("n_rows"))), F.lit(0)
        ).alias("n_unjoinable"),
    )
    shares = {
        f"share_{c[2:]}": F.try_divide(F.col(c), F.col("n_rows")) for c in COUNTERS[1:]
    }
    return totals.withColumns(shares)


def class_counts(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return readings.groupBy(reading_class(F.col("speed"), p).alias("reading_class")).agg(
        F.count(F.lit(1)).alias("n")
    )
