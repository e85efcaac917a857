"""Time-of-day and weekday expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanepulse.params import DEFAULTS, Params


def minute_of_day(time: Column) -> Column:
    """Minutes since midnight of an 'HH:MM[:SS]' string.

    NULL stays NULL. Any other text stops the job: as NULL it would pass as a
    reading of no time of day.
    """
    proper = time.rlike(r"^\s*([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?\s*$")
    hours = F.trim(F.split_part(time, F.lit(":"), F.lit(1))).try_cast("int")
    minutes = F.trim(F.split_part(time, F.lit(":"), F.lit(2))).try_cast("int")
    odd = F.raise_error(F.concat(F.lit("not a time of day: "), time)).cast("int")
    return F.when(time.isNull() | proper, hours * 60 + minutes).otherwise(odd)


def time_bucket(time: Column, p: Params = DEFAULTS) -> Column:
    return F.floor(minute_of_day(time) / F.lit(p.bucket_minutes)).cast("int")


def day_of_week(date: Column) -> Column:
    """Weekday with Sunday = 0."""
    return (F.dayofweek(date) - 1).cast("int")


def bucket_label(bucket: Column, p: Params = DEFAULTS) -> Column:
    minutes = bucket * p.bucket_minutes
    return F.format_string(
        "%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    )


def bucket_hour(bucket: Column, p: Params = DEFAULTS) -> Column:
    return bucket * F.lit(float(p.bucket_minutes)) / F.lit(60.0)
