"""Sums of each period, kept so that figures of any set of periods come without readings.

Every figure of the site table follows from sums and counts that add up over periods: class
counters and day and night sums per lane, readings per lane and speed value, and the streets
that claim a position. A lane that is dead over the year may have lived in one month, so sums are kept for
all lanes and dead ones are judged when figures are asked for.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.functions.clock import day_of_week
from lanepulse.operators import rollup
from lanepulse.operators.cleaning import COUNTERS, bucket_cells, named_period
from lanepulse.operators.lanes import live_lanes
from lanepulse.operators.sites import extend_sites, number_sites
from lanepulse.joins import small_side
from lanepulse.params import DEFAULTS, LANE_KEY, PERIOD, SITE_KEY, Params, period_of
from lanepulse.plans.ingest import Ingest
from lanepulse.sources.versions import Versions
from lanepulse.staging import stage

# A week's cells are too few bytes to be split by their size, and too much work for one task.
PARTS = 32


class Stored(Ingest):
    """A load put together from the sums of periods; by period, or over all of them as one."""

    def __init__(self, tables: dict[str, DataFrame], by_period: bool, p: Params = DEFAULTS):
        self.tables = {
            name: df if by_period or PERIOD not in df.columns else df.drop(PERIOD)
            for name, df in tables.items()
        }
        self.p = p

    @cached_property
    def sites(self) -> DataFrame:
        return self.tables["sites"]

    @cached_property
    def cells(self) -> DataFrame:
        cells = self.tables["cells"]
        if period_of(cells):
            return cells
        # A period need not be made of whole days, so a cell may have sums in several.
        return cells.groupBy(*LANE_KEY, "date", "bucket").agg(*_added(COUNTERS + ["speed_sum"]))

    @cached_property
    def histogram(self) -> DataFrame:
        return self.tables["speeds"]

    @cached_property
    def lanes(self) -> DataFrame:
        lanes = self.tables["lanes"]
        if period_of(lanes):
            return lanes
        return stage(lanes.groupBy(*LANE_KEY).agg(*_added([c for c in lanes.columns if c not in LANE_KEY])), "lanes")

    def detectors(self, facts: DataFrame | None = None) -> DataFrame:
        """One row per site, from lane sums and speed counts; cells are not read."""
        keys = period_of(self.lanes)
        names = list(rollup.rhythm_sums(self.p))
        alive = small_side(live_lanes(self.health).select(*keys, *LANE_KEY))
        per_site = self.lanes.join(alive, [*keys, *LANE_KEY], "left_semi").groupBy(*keys, "site_id").agg(*_added(names))
        claims = self.tables["claims"].groupBy(*keys, "lat", "lon").agg(
            F.count_distinct("street").alias("streets_at_coord")
        )
        return rollup.detectors(
            self.sites, self.lanes, self.health, self.histogram,
            rollup.day_night_means(per_site, names), claims, self.p,
        )


def _added(columns: list[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


class PeriodStore:
    """Stored sums under one root: `cells`, `lanes`, `speeds`, `claims` by period, and `sites`.

    All five are published together. Use the same `p` for all loads of a store.
    """

    def __init__(self, spark: SparkSession, root: str, p: Params = DEFAULTS):
        self.versions = Versions(spark, root)
        self.p = p

    def load(self, raw: DataFrame, period: Column) -> int:
        """Add the readings of some periods, in place of what these held; returns the version.

        Periods are text; readings without one form the period "undated".
        Sites keep their numbers, new ones are numbered after them. A load that stops before its
        end changes nothing. Hand in a columnar source.
        """
        draft = self.versions.begin()
        known = self.versions.read("sites", version=draft.base) if draft.base else None
        load = Ingest(raw, named_period(period), self.p, known)
        # A short table, with all that the sites and the claims need of the readings.
        points = stage(load.readings.select(PERIOD, *SITE_KEY).distinct(), "points")
        load.sites = number_sites(points) if known is None else stage(extend_sites(known, points), "sites")
        draft.write("sites", load.sites)
        # Written once: nothing reads the cells before they are in their periods.
        cells = draft.write("cells", _by_period(bucket_cells(load.readings, load.sites, self.p)), PERIOD)
        with_day = cells.withColumn("dow", day_of_week(F.col("date")))
        lanes = with_day.where(F.col("site_id").isNotNull()).groupBy(PERIOD, *LANE_KEY).agg(
            *_added(COUNTERS + ["speed_sum"]),
            *[column.alias(name) for name, column in rollup.rhythm_sums(self.p).items()],
        )
        draft.write("lanes", _by_period(lanes), PERIOD)
        draft.write("speeds", _by_period(load.histogram.where("site_id is not null")), PERIOD)
        draft.write("claims", _by_period(points.select(PERIOD, "lat", "lon", "street").distinct()), PERIOD)
        # Every located reading has its cell, so these are all periods of the load.
        return draft.publish(list(draft.written["cells"]["parts"]))

    def periods(self, version: int | None = None) -> list[str]:
        return self.versions.parts("cells", version)

    def view(
        self, periods: list[str] | None = None, *, by_period: bool = False, version: int | None = None
    ) -> Stored:
        """The stored load of all periods, or of those named."""
        version = self.versions.latest() if version is None else version
        tables = {
            name: self.versions.read(name, periods, version) for name in ("cells", "lanes", "speeds", "claims")
        }
        return Stored({**tables, "sites": self.versions.read("sites", version=version)}, by_period, self.p)


def _by_period(df: DataFrame) -> DataFrame:
    """A period over up to PARTS tasks, a longer one over more; short ones in few files each."""
    rest = [c for c in df.columns if c != PERIOD]
    dealt = df.withColumn("part", F.pmod(F.xxhash64(*rest), F.lit(PARTS)))
    return dealt.hint("rebalance", PERIOD, "part").drop("part")
