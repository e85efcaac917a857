"""Measuring points and the streets that claim each position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.joins import is_small, small_side
from lanepulse.operators.numbering import dense_ids
from lanepulse.params import DEFAULTS, SITE_KEY, Params, period_of


def number_sites(frame: DataFrame) -> DataFrame:
    """Distinct measuring points of the readings, numbered 1.. in key order.

    `site_key` is a stable id for inputs that grow: numbers shift when a new
    point appears, the hash does not.
    """
    return _numbered(frame.select(*SITE_KEY).distinct(), start=1)


def _numbered(distinct: DataFrame, start: int) -> DataFrame:
    numbered = dense_ids(distinct, SITE_KEY, "site_id", start=start)
    return numbered.withColumn("site_key", F.xxhash64(*SITE_KEY))


def extend_sites(known: DataFrame, frame: DataFrame) -> DataFrame:
    """`known` sites with their numbers, and after them in key order those only the readings have.

    What a number means never changes, so sums of earlier loads stay joinable. A
    NULL in a key is a value like any other.
    """
    same = F.lit(True)
    for name in SITE_KEY:
        same = same & F.col(f"new.{name}").eqNullSafe(F.col(f"old.{name}"))
    old = small_side(known.select(*SITE_KEY)).alias("old")
    fresh = frame.select(*SITE_KEY).distinct().alias("new").join(old, same, "left_anti")
    last = known.agg(F.max("site_id")).first()[0] or 0
    return known.unionByName(_numbered(fresh, start=last + 1))


def aggregate_per_site(
    frame: DataFrame,
    sites: DataFrame,
    aggregate: Callable[[DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """`aggregate(frame, site columns)` of rows that carry a site's key, by `site_id`.

    With a broadcastable site table the number is looked up first, so that only
    numbers are shuffled. Otherwise rows are aggregated under the full key and
    the shorter result is joined.
    """
    lookup = sites.select("site_id", *SITE_KEY)
    if is_small(lookup):
        numbered = frame.join(F.broadcast(lookup), SITE_KEY, "left").drop(*SITE_KEY)
        return aggregate(numbered, ["site_id"])
    # An incomplete key matches no site; such rows share one cell on this side too.
    complete = F.lit(True)
    for name in SITE_KEY:
        complete = complete & F.col(name).isNotNull()
    frame = frame.withColumn("complete", complete)
    frame = frame.withColumns(
        {name: F.when(F.col("complete"), F.col(name)) for name in SITE_KEY}
    ).drop("complete")
    return aggregate(frame, SITE_KEY).join(lookup, SITE_KEY, "left").drop(*SITE_KEY)


def streets_per_point(frame: DataFrame) -> DataFrame:
    """Streets that claim each position, of sites or of readings (then per period)."""
    return frame.groupBy(*period_of(frame), "lat", "lon").agg(
        F.count_distinct("street").alias("streets_at_coord")
    )


def placeholder_sites(detectors: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Number of sites at positions that too many streets claim, per period if there are several."""
    return detectors.groupBy(*period_of(detectors)).agg(
        F.count_if(F.col("streets_at_coord") > p.max_streets_per_point).alias(
            "n_placeholder"
        )
    )
