"""Means for any set of weekdays and time buckets.

Facts are always summed to one row per site (and bucket) before a site is
looked up, so the lookup never sees more rows than sites times buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.functions.clock import bucket_hour, bucket_label
from lanepulse.functions.geo import clamp
from lanepulse.operators.quality import is_checked, one_per_key
from lanepulse.params import DAY_SCOPES, DEFAULTS, Params, period_of


def pick(
    facts: DataFrame, dows: Sequence[int] | None = None, buckets: Sequence[int] | None = None
) -> DataFrame:
    """Facts of the given weekdays and buckets; None keeps all of them."""
    if dows is not None:
        facts = facts.where(F.col("dow").isin(*dows))
    if buckets is not None:
        facts = facts.where(F.col("bucket").isin(*buckets))
    return facts


def by_scope(facts: DataFrame) -> DataFrame:
    """Site sums per bucket under each day scope they belong to, as column `scope`.

    Days are summed per weekday first, so the repetition is over few rows.
    """
    scopes = F.array(
        *[F.when(F.col("dow").isin(*days), F.lit(name)) for name, days in DAY_SCOPES.items()]
    )
    per_weekday = _site_sums(facts, ["dow", "bucket"])
    return per_weekday.withColumn("scope", F.explode(F.array_compact(scopes)))


def _site_sums(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    return facts.groupBy(*period_of(facts), "site_id", *by).agg(
        F.sum("speed_sum").alias("speed_sum"),
        F.sum("n_moving").alias("n_moving"),
        F.sum("n_zero").alias("n_zero"),
    )


def _samples(include_zeros: bool) -> Column:
    moving = F.col("n_moving")
    return moving + F.col("n_zero") if include_zeros else moving


def _sums(frame: DataFrame, keys: list[str], include_zeros: bool) -> DataFrame:
    """Sums per key with the mean that follows from them."""
    return frame.groupBy(*keys).agg(
        F.coalesce(F.sum("speed_sum"), F.lit(0.0)).alias("speed_sum"),
        F.sum(_samples(include_zeros)).alias("samples"),
        F.sum("n_zero").alias("n_zero"),
        F.sum("n_moving").alias("n_moving"),
    )


def _mean() -> Column:
    return F.try_divide(F.col("speed_sum"), F.col("samples"))


def site_slice(
    facts: DataFrame,
    sites: DataFrame,
    *,
    dows: Sequence[int] | None = None,
    buckets: Sequence[int] | None = None,
    include_zeros: bool = False,
    min_samples: int | None = None,
    only_usable: bool = True,
    located_only: bool = True,
    by: Sequence[str] = (),
    p: Params = DEFAULTS,
) -> DataFrame:
    """One row per site for a slice, with its congestion and deviation.

    `by` names further fact columns to keep apart, for instance `bucket` for
    every half hour of the day in one job. Facts and sites are both per period or
    both over the whole input; a site with two rows stops the job. Sites that went through
    `quality.checked_once` are not looked at again.
    """
    if period_of(facts) != period_of(sites):
        raise ValueError("facts and sites must both have a period, or neither")
    floor = p.min_samples if min_samples is None else min_samples
    keys = [*period_of(facts), "site_id"]
    sums = (
        _sums(pick(facts, dows, buckets), [*by, *keys], include_zeros)
        .where(F.col("samples") >= floor)
        .withColumn("speed", _mean())
    )
    known = is_checked(sites, keys)
    if only_usable:
        sites = sites.where("is_usable")
    if located_only:
        sites = sites.where("has_location")
    if not known:
        sites = one_per_key(sites, keys)
    lost = 1 - F.try_divide(F.col("speed"), F.col("free_flow_speed"))
    return sums.join(sites, keys).withColumns(
        {
            # No figure, rather than zero, where the reference is too small.
            "congestion": F.when(F.col("has_reference"), clamp(lost, 0.0, 1.0)),
            "vs_typical": F.col("speed") - F.col("mean_speed"),
            "tramo": F.concat(
                "street", F.lit(": "), "from_street", F.lit(" → "), "to_street"
            ),
        }
    )


def _profile(frame: DataFrame, keys: list[str], include_zeros: bool, p: Params) -> DataFrame:
    bucket = F.col("bucket")
    return (
        _sums(frame, keys, include_zeros)
        .select(*keys, "speed_sum", "samples", _mean().alias("speed"))
        .withColumns({"time": bucket_label(bucket, p), "hour": bucket_hour(bucket, p)})
    )


def city_profile(
    facts: DataFrame,
    sites: DataFrame,
    *,
    dows: Sequence[int] | None = None,
    include_zeros: bool = False,
    p: Params = DEFAULTS,
) -> DataFrame:
    """City-wide mean per bucket over usable sites, located or not."""
    keys = period_of(facts)
    kept = _site_sums(pick(facts, dows), ["bucket"]).join(
        sites.where("is_usable").select(*keys, "site_id"), [*keys, "site_id"], "left_semi"
    )
    return _profile(kept, [*keys, "bucket"], include_zeros, p)


def street_profile(
    facts: DataFrame,
    sites: DataFrame,
    *,
    streets: Sequence[str],
    dows: Sequence[int] | None = None,
    include_zeros: bool = False,
    p: Params = DEFAULTS,
) -> DataFrame:
    """Mean per bucket for each of the named streets."""
    keys = period_of(facts)
    named = sites.where(F.col("is_usable") & F.col("street").isin(*streets))
    kept = _site_sums(pick(facts, dows), ["bucket"]).join(
        named.select(*keys, "site_id", "street"), [*keys, "site_id"]
    )
    return _profile(kept, [*keys, "street", "bucket"], include_zeros, p)


def street_pivot(profile: DataFrame, streets: Sequence[str]) -> DataFrame:
    """Times down (per period, if there are several), streets across, speeds to one decimal (ties to even)."""
    rounded = F.rint(F.col("speed") * 10) / 10
    return profile.groupBy(*period_of(profile), "time").pivot("street", list(streets)).agg(F.first(rounded))


def with_metric(slice_: DataFrame, column: str) -> DataFrame:
    """Rows on which the metric exists; only congestion can be undefined."""
    return slice_.where(F.col(column).isNotNull())


def metric_gaps(slice_: DataFrame, column: str) -> DataFrame:
    return slice_.groupBy(*period_of(slice_)).agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.count_if(F.col(column).isNull()).alias("n_without_metric"),
    )


def metric_domain(slice_: DataFrame, column: str) -> DataFrame:
    return slice_.groupBy(*period_of(slice_)).agg(
        F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")
    )


def headline(
    slice_: DataFrame, profile: DataFrame, sites: DataFrame, *, all_day: bool = False
) -> DataFrame:
    """City mean of the slice, its distance from the all-day mean, slowest site, zero share.

    One row, or one per period of `sites`, from the rows of that period alone.
    """
    keys = period_of(sites)
    if not keys == period_of(slice_) == period_of(profile):
        raise ValueError("slice, profile and sites must all have a period, or none")
    whole_day = profile.groupBy(*keys).agg(
        F.try_divide(F.sum("speed_sum"), F.sum("samples")).alias("all_day_mean")
    )
    total = sites.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"))
    # Both figures from the same row, which has a speed; equal speeds go by site.
    slowest = F.min_by(
        F.struct("speed", "street"),
        F.when(F.col("speed").isNotNull(), F.struct("speed", "site_id")),
    )
    one = slice_.groupBy(*keys).agg(
        F.try_divide(F.sum("speed_sum"), F.sum("samples")).alias("mean_speed"),
        F.count(F.lit(1)).alias("n_reporting"),
        slowest["speed"].alias("slowest_speed"),
        slowest["street"].alias("slowest_street"),
        F.sum("n_zero").alias("zeros"),
        F.sum(F.col("n_zero") + F.col("n_moving")).alias("readings"),
    )
    if keys:
        # One row per period on each side.
        joined = total.join(one, keys, "left").join(whole_day, keys, "left")
    else:
        joined = one.withColumn("all_day_mean", whole_day.scalar()).withColumn("n_sites", total.scalar())
    none = F.lit(0)
    zero_share = F.coalesce("zeros", none) / F.greatest(F.coalesce("readings", none), F.lit(1))
    delta = F.lit(None).cast("double") if all_day else F.col("mean_speed") - F.col("all_day_mean")
    return joined.select(
        *keys,
        "mean_speed",
        F.coalesce("n_reporting", none).alias("n_reporting"),
        "slowest_speed",
        "slowest_street",
        zero_share.alias("zero_share"),
        "all_day_mean",
        "n_sites",
        delta.alias("delta"),
    )


def profile_extremes(profile: DataFrame) -> DataFrame:
    """Lowest and highest mean with their times; the earliest bucket wins a tie."""
    known = profile.where(F.col("speed").isNotNull())
    return known.groupBy(*period_of(profile)).agg(
        F.min("speed").alias("low_speed"),
        F.min_by("time", F.struct("speed", "bucket")).alias("low_time"),
        F.max("speed").alias("high_speed"),
        F.max_by("time", F.struct(F.col("speed"), -F.col("bucket"))).alias("high_time"),
    )


def slowest(slice_: DataFrame, n: int = 12) -> DataFrame:
    """The n slowest stretches (of each period, if there are several); equal speeds in site order."""
    keys, order = period_of(slice_), [F.asc_nulls_last("speed"), F.asc("site_id")]
    if keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        first = slice_.withColumn("rank", rank).where(F.col("rank") <= n)
    else:
        first = slice_.orderBy(*order).limit(n)
    return first.select(
        *keys, "tramo", "speed", (F.col("congestion") * 100).alias("congestion_pct"), "samples"
    )


def slice_export(slice_: DataFrame) -> DataFrame:
    return slice_.select(
        *period_of(slice_),
        "street",
        "from_street",
        "to_street",
        "lat",
        "lon",
        "speed",
        "congestion",
        "vs_typical",
        "samples",
        "n_lanes",
    ).orderBy(F.asc_nulls_last("speed"))


def dates(facts: DataFrame) -> DataFrame:
    return facts.select("date").distinct().orderBy("date")


def street_names(sites: DataFrame) -> DataFrame:
    return sites.select("street").distinct().orderBy("street")
