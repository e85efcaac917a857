"""Raw readings to the stored fact table and site dimension."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from lanepulse.operators import lanes as lane_ops
from lanepulse.operators import rollup
from lanepulse.operators.cleaning import (
    bucket_cells,
    clean_readings,
    load_report,
    named_period,
    speed_histogram,
    with_period,
)
from lanepulse.operators.lanes import dead_lane_report
from lanepulse.operators.sites import extend_sites, number_sites, placeholder_sites, streets_per_point
from lanepulse.joins import small_side
from lanepulse.params import DEFAULTS, FOLDER, PERIOD, Params, period_of
from lanepulse.sources.readings import read_readings
from lanepulse.sources.tables import fact_order
from lanepulse.sources.versions import Versions
from lanepulse.staging import stage


class Ingest:
    """Stages of one load, each made once and only when asked for.

    Raw rows are scanned for the sites, for the cells and for the speed
    histogram; each scan reads its own columns and shrinks before it shuffles.
    All later stages read the results. Hand in a columnar source: text is better
    written as Parquet first.
    """

    def __init__(
        self, raw: DataFrame, period: Column | None = None, p: Params = DEFAULTS,
        known_sites: DataFrame | None = None,
    ):
        self.readings = clean_readings(raw)
        if period is not None:
            self.readings = with_period(self.readings, period)
        self.p = p
        self.known_sites = known_sites

    @cached_property
    def cells(self) -> DataFrame:
        return stage(bucket_cells(self.readings, self.sites, self.p), "cells")

    @cached_property
    def histogram(self) -> DataFrame:
        return speed_histogram(self.readings, self.sites, self.p)

    @cached_property
    def sites(self) -> DataFrame:
        """All sites; those of earlier loads, where given, keep their numbers."""
        if self.known_sites is None:
            return number_sites(self.readings)
        return stage(extend_sites(self.known_sites, self.readings), "sites")

    @cached_property
    def lanes(self) -> DataFrame:
        return stage(lane_ops.lane_totals(self.cells), "lanes")

    @cached_property
    def health(self) -> DataFrame:
        return lane_ops.lane_health(self.lanes, self.p)

    @cached_property
    def measurements(self) -> DataFrame:
        return rollup.measurements(self.cells, self.health)

    def detectors(self, facts: DataFrame | None = None) -> DataFrame:
        facts = self.measurements if facts is None else facts
        # A name that a street had in another period does not count against it.
        named = self.readings if period_of(self.readings) else self.sites
        return rollup.detectors(
            self.sites, self.lanes, self.health, self.histogram,
            rollup.day_night(facts, self.p), streets_per_point(named), self.p,
        )

    def with_site_key(self, frame: DataFrame) -> DataFrame:
        """`frame` with the id of its sites that stays the same over all loads."""
        return frame.join(small_side(self.sites.select("site_id", "site_key")), "site_id")


def build_tables(
    spark: SparkSession,
    csv_paths: str | Sequence[str],
    out: str,
    *,
    period: Column | None = None,
    folders: Column | None = None,
    p: Params = DEFAULTS,
    **csv_options: str,
) -> dict[str, DataFrame]:
    """Load CSVs, write `measurements` and `detectors` under `out`, return the reports.

    Both tables are published together (`sources.versions`): a job that stops leaves the
    tables of the load before, and readers of those are not disturbed. `period` (for instance
    the month of `date`) makes dead lanes and site figures per period. A load then
    replaces the periods that it has rows for and keeps the others, and sites keep
    their numbers over all loads. Periods are text; readings without one form the period "undated".
    `folders` (again for instance the month), for a load without a period, only lays the fact table out:
    it has a column `folder` then and a part for each of its values, and rules stay those of the whole input.
    The tables are returned whole, with the periods of earlier loads; load and lane
    reports are about this load.
    """
    # Text is parsed once; the scans of the load read the typed copy.
    raw = stage(read_readings(spark, csv_paths, **csv_options), "readings")
    versions = Versions(spark, out)
    draft = versions.begin()
    known, by = None, None
    if period is not None:
        by, period = PERIOD, named_period(period)
        if "sites" in versions.record(draft.base):
            known = versions.read("sites", version=draft.base)
    load = Ingest(raw, period, p, known)
    measured = load.measurements
    if by:
        draft.write("sites", load.sites)
        measured = load.with_site_key(measured)
    if folders is not None:
        if by:
            raise ValueError("a load by period is laid out by period")
        measured = measured.withColumn(FOLDER, named_period(folders))
    laid = by if folders is None else FOLDER
    facts = draft.write("measurements", fact_order(measured, laid), laid)
    sites = load.detectors(facts)
    if by:
        sites = load.with_site_key(sites)
    draft.write("detectors", sites.hint("rebalance", PERIOD) if by else sites, by)
    if by:
        replaced = [r[0] for r in load.lanes.select(PERIOD).distinct().collect()]
    else:
        # The whole input takes the place of all that was there.
        replaced = list(versions.record(draft.base).get("measurements", {}).get("parts", {}))
    version = draft.publish(replaced)
    detectors = versions.read("detectors", version=version)
    return {
        "measurements": versions.read("measurements", version=version),
        "detectors": detectors,
        "load_report": load_report(load.cells),
        "dead_lane_report": dead_lane_report(load.health),
        "placeholder_sites": placeholder_sites(detectors, p),
    }
