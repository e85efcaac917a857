"""Named queries over the sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse.functions.scales import (
    METRICS,
    STREET_OPACITY,
    SURFACE_OPACITY,
    metric_position,
    support_opacity,
)
from lanepulse.operators import cleaning, field, lanes, matching, quality, roads, rollup
from lanepulse.operators import slices, surface
from lanepulse.operators.sites import placeholder_sites, streets_per_point
from lanepulse.params import DAY_SCOPES
from lanepulse.plans.ingest import Ingest, build_tables
from lanepulse.plans.network import build_network, claimed_network
from lanepulse.plans.stored import PeriodStore
from lanepulse.sources.readings import read_readings, write_readings_csv
from lanepulse.sources.roads import read_ways
from lanepulse.sources.sample_feed import read_sample_feed, ways_from_sites
from lanepulse.sources.tables import write_slice_csv
from lanepulse.sources.versions import Versions
from lanepulse.staging import session_folder, stage

Query = Callable[[SparkSession, str], DataFrame]

WEEKDAY, WEEKEND = DAY_SCOPES["weekday"], DAY_SCOPES["weekend"]
EVENING = [35]  # the 17:30 bucket
STREETS = ["Street 1", "Street 2", "Street 4"]
# First day and day after the last one of the readings that arrive together.
LOADS = [
    ("2024-01-08", "2024-01-22"), ("2024-01-22", "2024-01-29"), ("1900-01-01", "2024-01-08"),
    ("2024-01-29", "2999-01-01"), ("2024-01-15", "2024-01-22"),
]


def _week() -> Column:
    """Monday of a date's week, as text."""
    return F.date_format(F.date_trunc("week", F.col("date")), "yyyy-MM-dd")


_QUERIES: dict[str, Query] = {}
_STORES: dict[tuple[str, str], Store] = {}


class Store:
    """Tables of one load, written once per session as a deployment would keep them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.load = Ingest(read_sample_feed(spark, folder))

    @cached_property
    def facts(self) -> DataFrame:
        return stage(self.load.measurements, "measurements")

    @cached_property
    def sites(self) -> DataFrame:
        return quality.checked_once(quality.flag_sites(stage(self.load.detectors(self.facts), "detectors")))

    @cached_property
    def ways(self) -> DataFrame:
        return stage(ways_from_sites(self.load.sites), "ways")

    @cached_property
    def corridors(self) -> DataFrame:
        return stage(roads.way_corridors(self.ways), "corridors")

    @cached_property
    def chunks(self) -> DataFrame:
        return stage(roads.road_chunks(self.ways, self.corridors), "chunks")

    @cached_property
    def assigned(self) -> DataFrame:
        """For the views: every located site."""
        located = self.sites.where("has_location")
        return stage(matching.assign_corridors(located, self.chunks), "assigned")

    @cached_property
    def assigned_mappable(self) -> DataFrame:
        """For the network: usable and located sites."""
        mappable = quality.mappable(self.sites)
        return stage(matching.assign_corridors(mappable, self.chunks), "assigned-mappable")

    @cached_property
    def weekday_slice(self) -> DataFrame:
        """Whole weekdays; several consumers read it, so it is written down."""
        return stage(slices.site_slice(self.facts, self.sites, dows=WEEKDAY), "slice")

    @cached_property
    def weeks(self) -> PeriodStore:
        """Sums per week after five loads, the last one of a week that was there before."""
        kept = PeriodStore(self.spark, f"{session_folder(self.spark)}/weeks-{uuid.uuid4().hex[:12]}")
        # Loads begin on Mondays, so each is made of whole weeks and opens the files of these alone.
        readings = stage(self.load.readings.withColumn("week", _week()), "readings", by="week")
        for first, end in LOADS:
            inside = (F.col("week") >= first) & (F.col("week") < end)
            kept.load(readings.where(inside), F.col("week"))
        return kept

    @cached_property
    def week_facts(self) -> DataFrame:
        return stage(self._week_load.measurements, "week-measurements")

    @cached_property
    def week_sites(self) -> DataFrame:
        return quality.checked_once(
            quality.flag_sites(stage(self._week_load.detectors(self.week_facts), "week-detectors")))

    @cached_property
    def _week_load(self) -> Ingest:
        return Ingest(self.load.readings, _week())

    @cached_property
    def week_slices(self) -> DataFrame:
        """Weekdays of each week as a period of its own."""
        return stage(slices.site_slice(self.week_facts, self.week_sites, dows=WEEKDAY), "week-slices")

    def week_profiles(self) -> DataFrame:
        return slices.city_profile(self.week_facts, self.week_sites, dows=WEEKDAY)

    def profile(self) -> DataFrame:
        return slices.city_profile(self.facts, self.sites, dows=WEEKDAY)

    def on_corridors(self) -> DataFrame:
        return matching.with_corridor(self.weekday_slice, self.assigned)


def store(spark: SparkSession, folder: str) -> Store:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        _STORES[key] = Store(spark, folder)
    return _STORES[key]


def _six_decimals(df: DataFrame) -> DataFrame:
    """Means and sums of doubles differ in their last bits from run to run."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), 6).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(build: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _six_decimals(build(store(spark, folder)))

    _QUERIES[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- readings, sites and lanes ---


@query
def reading_classes(s: Store) -> DataFrame:
    return cleaning.class_counts(s.load.readings)


@query
def load_report(s: Store) -> DataFrame:
    return cleaning.load_report(s.load.cells)


@query
def csv_load_report(s: Store) -> DataFrame:
    """The feed written as headed CSV, read back through the CSV source."""
    path = f"{session_folder(s.spark)}/readings-csv"
    spelling = {"detector_id": "id_detector", "speed": "velocidad_promedio"}
    write_readings_csv(s.load.readings, path, spelling)
    load = Ingest(stage(read_readings(s.spark, path), "readings"))
    return cleaning.load_report(load.cells)


def _built(s: Store, table: str) -> DataFrame:
    """A table of the whole load job, from CSV files to what was published."""
    folder = f"{session_folder(s.spark)}/built-{table}"
    write_readings_csv(s.load.readings, f"{folder}/csv")
    build_tables(s.spark, f"{folder}/csv", f"{folder}/out")
    return Versions(s.spark, f"{folder}/out").read(table)


@query
def measurements_from_csv(s: Store) -> DataFrame:
    return _built(s, "measurements")


@query
def detectors_from_csv(s: Store) -> DataFrame:
    return _built(s, "detectors")


@query
def csv_mixed_headers(s: Store) -> DataFrame:
    """Half of the feed under other column names in the same folder, read by one path."""
    folder = f"{session_folder(s.spark)}/mixed-csv"
    odd = F.col("detector_id") % 2 == 1
    write_readings_csv(s.load.readings.where(odd), f"{folder}/a")
    other = s.load.readings.where(~odd)
    spelling = {"detector_id": "id_detector", "speed": "velocidad_promedio"}
    write_readings_csv(other.select(*reversed(other.columns)), f"{folder}/b", spelling)
    return Ingest(stage(read_readings(s.spark, f"{folder}/*"), "readings")).measurements


@query
def sites(s: Store) -> DataFrame:
    return s.load.sites.drop("site_key")


@query
def coord_streets(s: Store) -> DataFrame:
    return streets_per_point(s.load.sites)


@query
def lane_health(s: Store) -> DataFrame:
    return s.load.health.select(
        "site_id", "detector_id", "lane", "n_moving", "mean_speed", "is_dead"
    )


@query
def dead_lane_report(s: Store) -> DataFrame:
    return lanes.dead_lane_report(s.load.health)


@query
def measurements(s: Store) -> DataFrame:
    return s.load.measurements


@query
def measurements_by_month(s: Store) -> DataFrame:
    by_month = Ingest(s.load.readings, F.date_format("date", "yyyy-MM"))
    return by_month.measurements


@query
def day_night(s: Store) -> DataFrame:
    return rollup.day_night(s.load.measurements)


@query
def free_flow(s: Store) -> DataFrame:
    return rollup.free_flow(s.load.histogram, s.load.health)


@query
def detectors(s: Store) -> DataFrame:
    return s.load.detectors()


@query
def detectors_by_week(s: Store) -> DataFrame:
    return s._week_load.detectors()


@query
def quality_counters_by_week(s: Store) -> DataFrame:
    return quality.quality_counters(s.week_sites)


@query
def slice_by_week(s: Store) -> DataFrame:
    return s.week_slices


@query
def slice_headline_by_week(s: Store) -> DataFrame:
    """Evening of each week against that week's days."""
    evening = slices.site_slice(s.week_facts, s.week_sites, dows=WEEKDAY, buckets=EVENING, min_samples=1)
    return slices.headline(slices.with_metric(evening, "congestion"), s.week_profiles(), s.week_sites)


@query
def street_pivot_by_week(s: Store) -> DataFrame:
    profile = slices.street_profile(s.week_facts, s.week_sites, streets=STREETS, dows=WEEKDAY)
    return slices.street_pivot(profile, STREETS)


@query
def profile_extremes_by_week(s: Store) -> DataFrame:
    return slices.profile_extremes(s.week_profiles())


@query
def slowest_3_by_week(s: Store) -> DataFrame:
    return slices.slowest(s.week_slices, 3)


@query
def surface_by_week(s: Store) -> DataFrame:
    """Supported cells, values and support of each week's surface."""
    cells = surface.surface_cells(s.week_slices, "speed")
    return cells.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_supported"),
        F.sum("value").alias("value_sum"),
        F.sum("support").alias("support_sum"),
    )


@query
def field_nearest_by_week(s: Store) -> DataFrame:
    """All chunks in each week, with the value of the nearest site of that week."""
    placed = matching.with_corridor(s.week_slices, s.assigned)
    fielded = field.street_field(s.chunks, placed, "speed", mode=field.NEAREST, by=["period"])
    return fielded.select("period", "corridor_id", *roads.CHUNK_KEY, "value", "support")


@query
def sites_over_loads(s: Store) -> DataFrame:
    """Sites numbered by the load that brought them, then by key."""
    return s.weeks.view().sites.drop("site_key")


@query
def detectors_from_weeks(s: Store) -> DataFrame:
    """Figures over all weeks from their stored sums."""
    return s.weeks.view().detectors()


@query
def detectors_from_two_weeks(s: Store) -> DataFrame:
    return s.weeks.view(["2024-01-08", "2024-01-22"]).detectors()


@query
def detectors_per_stored_week(s: Store) -> DataFrame:
    return s.weeks.view(by_period=True).detectors()


@query
def measurements_from_weeks(s: Store) -> DataFrame:
    """The fact table of all weeks, with dead lanes judged over all of them."""
    return s.weeks.view().measurements


@query
def load_report_per_stored_week(s: Store) -> DataFrame:
    return cleaning.load_report(s.weeks.view(by_period=True).cells)


@query
def site_flags(s: Store) -> DataFrame:
    return s.sites.select(
        "site_id", "is_live", "has_reference", "is_stalled", "is_usable", "has_location"
    )


@query
def quality_counters(s: Store) -> DataFrame:
    return quality.quality_counters(s.sites)


@query
def placeholder_count(s: Store) -> DataFrame:
    return placeholder_sites(s.sites)


@query
def site_key_check(s: Store) -> DataFrame:
    return quality.key_check(s.sites, ["site_id"])


# --- slices and profiles ---


@query
def slice_weekday_1730(s: Store) -> DataFrame:
    return slices.site_slice(s.facts, s.sites, dows=WEEKDAY, buckets=EVENING, min_samples=1)


@query
def slice_weekend(s: Store) -> DataFrame:
    return slices.site_slice(s.facts, s.sites, dows=WEEKEND)


@query
def slice_all_day_zeros(s: Store) -> DataFrame:
    return slices.site_slice(
        s.facts,
        s.sites,
        include_zeros=True,
        min_samples=20,
        only_usable=False,
        located_only=False,
    )


@query
def slice_every_bucket(s: Store) -> DataFrame:
    """Every scope and half hour of the day in one job."""
    scoped = slices.by_scope(s.facts)
    return slices.site_slice(scoped, s.sites, by=["scope", "bucket"]).select(
        "scope", "bucket", "site_id", "samples", "speed", "congestion"
    )


@query
def congestion_view(s: Store) -> DataFrame:
    return slices.with_metric(s.weekday_slice, "congestion").select("site_id", "congestion")


@query
def metric_gaps(s: Store) -> DataFrame:
    return slices.metric_gaps(s.weekday_slice, "congestion")


@query
def metric_domain(s: Store) -> DataFrame:
    return slices.metric_domain(s.weekday_slice, "samples")


@query
def metric_positions(s: Store) -> DataFrame:
    domain = slices.metric_domain(s.weekday_slice, "samples")
    low, high = domain.select("low").scalar(), domain.select("high").scalar()
    return s.weekday_slice.select(
        "site_id",
        *[
            metric_position(m, F.col(m.column).cast("double"), low, high).alias(f"{name}_at")
            for name, m in METRICS.items()
        ],
    )


@query
def city_profile(s: Store) -> DataFrame:
    return s.profile()


@query
def city_profile_zeros(s: Store) -> DataFrame:
    return slices.city_profile(s.facts, s.sites, include_zeros=True)


@query
def street_profile(s: Store) -> DataFrame:
    return slices.street_profile(s.facts, s.sites, streets=STREETS, dows=WEEKDAY)


@query
def street_pivot(s: Store) -> DataFrame:
    profile = slices.street_profile(s.facts, s.sites, streets=STREETS, dows=WEEKDAY)
    return slices.street_pivot(profile, STREETS)


@query
def slice_headline(s: Store) -> DataFrame:
    view = slices.with_metric(
        slices.site_slice(s.facts, s.sites, dows=WEEKDAY, buckets=EVENING, min_samples=1),
        "congestion",
    )
    return slices.headline(view, s.profile(), s.sites)


@query
def profile_extremes(s: Store) -> DataFrame:
    return slices.profile_extremes(s.profile())


@query
def slowest_1(s: Store) -> DataFrame:
    return slices.slowest(s.weekday_slice, 1)


@query
def slowest_12(s: Store) -> DataFrame:
    return slices.slowest(s.weekday_slice, 12)


@query
def slice_export(s: Store) -> DataFrame:
    return slices.slice_export(s.weekday_slice)


@query
def slice_export_file(s: Store) -> DataFrame:
    """The exported file, read back."""
    path = f"{session_folder(s.spark)}/slice-csv"
    export = slices.slice_export(s.weekday_slice)
    write_slice_csv(export, path)
    return s.spark.read.schema(export.schema).option("header", True).option("escape", '"').csv(path)


@query
def dates(s: Store) -> DataFrame:
    return slices.dates(s.facts)


@query
def street_names(s: Store) -> DataFrame:
    return slices.street_names(s.sites)


# --- surface ---


@query
def surface_cells(s: Store) -> DataFrame:
    return surface.surface_cells(s.weekday_slice, "congestion")


@query
def surface_grid(s: Store) -> DataFrame:
    return surface.surface_grid(s.weekday_slice, "congestion")


@query
def surface_bounds(s: Store) -> DataFrame:
    return surface.surface_bounds(s.weekday_slice, "congestion")


@query
def surface_supported(s: Store) -> DataFrame:
    return surface.supported_cells(surface.surface_cells(s.weekday_slice, "speed"))


@query
def surface_every_bucket(s: Store) -> DataFrame:
    """Supported cells, mean value and support of the surface of each scope and half hour."""
    by = ["scope", "bucket"]
    sliced = slices.site_slice(slices.by_scope(s.facts), s.sites, by=by, min_samples=1)
    # Read for the grid ends and for the cells.
    sliced = stage(sliced.select(*by, "lat", "lon", "speed"), "slices")
    cells = surface.surface_cells(sliced, "speed", by=by)
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_supported"),
        F.sum("value").alias("value_sum"),
        F.sum("support").alias("support_sum"),
    )


@query
def surface_opacity(s: Store) -> DataFrame:
    grid = surface.surface_grid(s.weekday_slice, "congestion")
    supported = F.col("value").isNotNull()
    return grid.select(
        "i",
        "j",
        metric_position(METRICS["congestion"], F.col("value")).alias("position"),
        support_opacity(F.col("support"), SURFACE_OPACITY, supported=supported).alias("alpha"),
        support_opacity(
            F.col("support"), SURFACE_OPACITY, supported=supported, boost=1.15
        ).alias("alpha_alone"),
    )


# --- roads ---


def _write_documents(ways: DataFrame, path: str) -> str:
    """Ways as response documents of at most 200 elements; a folder for each, as a multi-line file holds one."""
    point = F.transform("coords", lambda c: F.struct(c["lat"], c["lon"]))
    element = F.struct(
        point.alias("geometry"), F.struct(F.col("name")).alias("tags"), "way_id"
    )
    documents = (
        ways.select(
            F.format_string("%08d", F.floor(F.col("way_id") / 200)).alias("document"),
            element.alias("element"),
        )
        .groupBy("document")
        .agg(
            F.to_json(
                F.struct(
                    F.transform(
                        F.array_sort(
                            F.collect_list("element"),
                            lambda a, b: (a["way_id"] - b["way_id"]).cast("int"),
                        ),
                        lambda e: e.dropFields("way_id"),
                    ).alias("elements")
                )
            ).alias("value")
        )
    )
    documents.write.mode("overwrite").partitionBy("document").text(path)
    return path


@query
def ways_from_json(s: Store) -> DataFrame:
    """Ways written as response documents, read back."""
    ways = read_ways(s.spark, _write_documents(s.ways, f"{session_folder(s.spark)}/road-documents"))
    return ways.select(
        "way_id",
        "name",
        F.size("coords").alias("n_points"),
        F.col("coords")[0]["lon"].alias("lon0"),
        F.col("coords")[0]["lat"].alias("lat0"),
    )


@query
def network_from_json(s: Store) -> DataFrame:
    """The whole network job over documents under two paths, as its stored table."""
    folder = f"{session_folder(s.spark)}/network"
    paths = [
        _write_documents(s.ways.where(half), f"{folder}/{name}")
        for name, half in (("major", "way_id < 100"), ("minor", "way_id >= 100"))
    ]
    detectors = s.load.detectors(s.facts)
    return build_network(s.spark, paths, detectors, f"{folder}/out")["streets"]


@query
def corridors(s: Store) -> DataFrame:
    return roads.way_corridors(s.ways)


@query
def road_chunks(s: Store) -> DataFrame:
    return roads.road_chunks(s.ways, s.corridors)


@query
def near_roads(s: Store) -> DataFrame:
    located = s.sites.where("has_location")
    return matching.near_corridors(located, s.chunks)


@query
def name_scores(s: Store) -> DataFrame:
    near = matching.near_corridors(s.sites, s.chunks)
    return matching.name_scores(s.sites.join(near, ["lat", "lon"]))


@query
def site_corridor(s: Store) -> DataFrame:
    return matching.assign_corridors(s.sites.where("has_location"), s.chunks)


@query
def unmatched_names(s: Store) -> DataFrame:
    return matching.unmatched_names(quality.mappable(s.sites), s.assigned_mappable)


@query
def unmatched_in_slice(s: Store) -> DataFrame:
    return matching.unmatched_in_slice(s.weekday_slice, s.assigned)


@query
def matching_summary(s: Store) -> DataFrame:
    return matching.matching_summary(s.ways, s.chunks, s.assigned_mappable)


@query
def claimed_chunks(s: Store) -> DataFrame:
    return claimed_network(s.chunks, s.assigned_mappable)


def _field(s: Store, mode: str) -> DataFrame:
    fielded = field.street_field(s.chunks, s.on_corridors(), "speed", mode=mode)
    return fielded.select("corridor_id", *roads.CHUNK_KEY, "value", "support")


@query
def field_blend(s: Store) -> DataFrame:
    return _field(s, field.BLEND)


@query
def field_nearest(s: Store) -> DataFrame:
    return _field(s, field.NEAREST)


@query
def field_stub(s: Store) -> DataFrame:
    return _field(s, field.STUB)


@query
def field_opacity(s: Store) -> DataFrame:
    painted = _field(s, field.BLEND).where(F.col("value").isNotNull())
    return painted.select(
        *roads.CHUNK_KEY,
        metric_position(METRICS["speed"], F.col("value")).alias("position"),
        support_opacity(F.col("support"), STREET_OPACITY).alias("alpha"),
    )
