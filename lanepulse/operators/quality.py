"""Quality flags of sites and the counters shown with them."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.params import DEFAULTS, Params, period_of


def flag_sites(detectors: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Site dimension as the views use it: lifetime counters renamed, flags added."""

    def sure(condition):
        return F.coalesce(condition, F.lit(False))

    day, night = F.col("day_speed"), F.col("night_speed")
    flagged = detectors.withColumnsRenamed(
        {
            "n_zero": "n_zero_total",
            "n_readings": "n_readings_total",
            "n_missing": "n_missing_total",
        }
    ).withColumns(
        {
            "is_live": sure(F.col("mean_speed") >= p.flatline_speed),
            "has_reference": sure(F.col("free_flow_speed") >= p.min_reference_speed),
            "is_stalled": sure(
                (day < p.stalled_day_speed) & (night > day * p.stalled_night_ratio)
            ),
            "has_location": F.col("streets_at_coord") <= p.max_streets_per_point,
        }
    )
    return flagged.withColumn("is_usable", F.col("is_live") & ~F.col("is_stalled"))


def quality_counters(sites: DataFrame) -> DataFrame:
    """How many sites each rule leaves out, in one row (per period, if there are several)."""
    usable = F.col("is_usable")
    return sites.groupBy(*period_of(sites)).agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.count_if(~F.col("is_live")).alias("n_flatlined"),
        F.count_if(usable & ~F.col("has_reference")).alias("n_without_reference"),
        F.count_if(usable & ~F.col("has_location")).alias("n_without_location"),
        F.count_if("is_stalled").alias("n_stalled"),
        F.coalesce(F.sum("n_dead_lanes"), F.lit(0)).alias("n_dead_lanes"),
        F.count_if(usable & (F.col("n_dead_lanes") > 0)).alias("n_sites_with_dead_lanes"),
    )


def key_check(frame: DataFrame, key: list[str]) -> DataFrame:
    """Rows, keys and repeated keys; a one-to-one join needs zero repeats."""
    return (
        frame.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count(F.lit(1)).alias("n_keys"),
            F.count_if(F.col("n") > 1).alias("n_repeated"),
        )
    )


# Frames known to have one row per key. A frame made from one of them is not among them.
_CHECKED: WeakKeyDictionary[DataFrame, list[str]] = WeakKeyDictionary()


def checked_once(frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`frame`, after a look that it has one row per key, which is not repeated for each of its uses.

    By default the key is that of a site. Hand in a stored table: what is read later has to be what was
    looked at.
    """
    keys = [*period_of(frame), "site_id"] if keys is None else keys
    if not repeated_keys(frame, keys).isEmpty():
        raise ValueError(f"several rows for one value of {', '.join(keys)}")
    _CHECKED[frame] = keys
    return frame


def is_checked(frame: DataFrame, keys: list[str]) -> bool:
    """Whether checked_once() returned this very frame, for these keys."""
    return _CHECKED.get(frame) == keys


def one_per_key(frame: DataFrame, keys: list[str]) -> DataFrame:
    """`frame` as it is, keys first; a repeated key stops the job that reads it."""
    rest = [c for c in frame.columns if c not in keys]
    merged = frame.groupBy(*keys).agg(
        F.any_value(F.struct(*rest)).alias("row"), F.count(F.lit(1)).alias("n")
    )
    twice = F.raise_error(F.lit(f"several rows for one value of {', '.join(keys)}"))
    one = F.when(F.col("n") == 1, F.col("row")).otherwise(twice.cast(merged.schema["row"].dataType))
    return merged.select(*keys, one.alias("row")).select(*keys, "row.*")


def repeated_keys(frame: DataFrame, key: list[str]) -> DataFrame:
    return frame.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def usable(sites: DataFrame) -> DataFrame:
    return sites.where("is_usable")


def mappable(sites: DataFrame) -> DataFrame:
    return sites.where("is_usable AND has_location")
