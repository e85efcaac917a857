"""Slices, profiles, rankings and reports on a small fact table."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from lanepulse import staging
from lanepulse.operators import matching, slices
from lanepulse.params import DAY_SCOPES

FACTS = """site_id long, detector_id long, lane int, date date, bucket int, dow int,
speed_sum double, n_moving long, n_zero long"""
SITES = """site_id long, lat double, lon double, street string, from_street string,
to_street string, n_lanes long, mean_speed double, free_flow_speed double,
has_reference boolean, is_usable boolean, has_location boolean, n_dead_lanes long"""
DAY = date(2026, 8, 3)


def fact(site, bucket, total, moving, zero=0, dow=1, det=1):
    return (site, det, 1, DAY, bucket, dow, total, moving, zero)


def site(i, *, street="A", origin="B", ff=50.0, ref=True, usable=True, located=True, mean=20.0):
    return (i, -34.9, -56.1, street, origin, "C", 2, mean, ff, ref, usable, located, 0)


def frames(spark, facts, sites):
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(sites, SITES)


def one(spark, facts, *, sites=None, **options):
    rows = slices.site_slice(*frames(spark, facts, sites or [site(1)]), **options).collect()
    assert len(rows) == 1
    return rows[0]


def test_zeros_only_grow_the_denominator(spark):
    facts = [fact(1, 16, 90.0, 3, 6), fact(1, 16, None, 0, 1)]
    assert one(spark, facts).speed == 30.0
    with_zeros = one(spark, facts, include_zeros=True)
    assert (with_zeros.speed, with_zeros.samples, with_zeros.n_zero) == (9.0, 10, 7)


def test_all_zero_site_has_speed_zero(spark):
    row = one(spark, [fact(1, 16, None, 0, 5)], include_zeros=True)
    assert (row.speed_sum, row.speed, row.congestion) == (0.0, 0.0, 1.0)


def test_no_samples_is_no_speed_and_no_error(spark):
    row = one(spark, [fact(1, 16, None, 0, 5)], min_samples=0)
    assert row.speed is None and row.congestion is None


def test_minimum_samples(spark):
    facts, sites = frames(spark, [fact(1, 16, 60.0, 2), fact(2, 16, 90.0, 3)], [site(1), site(2)])
    assert [r.site_id for r in slices.site_slice(facts, sites).collect()] == [2]
    assert slices.site_slice(facts, sites, min_samples=1).count() == 2


@pytest.mark.parametrize(
    "total, ff, ref, expected",
    [
        (75.0, 50.0, True, 0.5),
        (180.0, 50.0, True, 0.0),  # faster than free flow
        (75.0, 9.0, False, None),  # no figure rather than zero
        (75.0, None, False, None),
    ],
)
def test_congestion(spark, total, ff, ref, expected):
    row = one(spark, [fact(1, 16, total, 3)], sites=[site(1, ff=ff, ref=ref)])
    assert row.congestion == expected


def test_deviation_and_label(spark):
    row = one(spark, [fact(1, 16, 75.0, 3)])
    assert (row.vs_typical, row.tramo) == (5.0, "A: B → C")
    assert one(spark, [fact(1, 16, 75.0, 3)], sites=[site(1, origin=None)]).tramo is None


def test_views_differ_in_the_sites_they_keep(spark):
    sites = [site(1), site(2, located=False), site(3, usable=False)]
    facts = [fact(i, 16, 30.0 * i * 3, 3) for i in (1, 2, 3)]
    f, s = frames(spark, facts, sites)

    def kept(**options):
        return {r.site_id for r in slices.site_slice(f, s, **options).collect()}

    assert kept() == {1}
    assert kept(located_only=False) == {1, 2}
    assert kept(only_usable=False, located_only=False) == {1, 2, 3}
    assert slices.city_profile(f, s).first().speed == 45.0  # sites 1 and 2


@pytest.mark.parametrize("scope, expected", [("weekday", {1, 5}), ("weekend", {0, 6}), ("all", {0, 1, 5, 6})])
def test_day_scopes(spark, scope, expected):
    facts = [fact(1, 16, 30.0, 3, dow=d) for d in (0, 1, 5, 6)]
    f, _ = frames(spark, facts, [site(1)])
    assert {r.dow for r in slices.pick(f, DAY_SCOPES[scope]).collect()} == expected


def random_city(spark):
    rng = random.Random(7)
    facts = []
    for _ in range(600):
        moving = rng.randrange(0, 5)
        total = float(sum(rng.randrange(1, 60) for _ in range(moving))) if moving else None
        facts.append(fact(rng.randrange(1, 8), rng.randrange(48), total, moving,
                          rng.randrange(3), rng.randrange(7), rng.randrange(1, 4)))
    sites = [site(i, street=f"S{i % 3}", usable=i != 4, ff=10.0 * i) for i in range(1, 8)]
    return facts, sites


def test_any_split_of_a_slice_adds_up(spark):
    facts, sites = random_city(spark)
    f, s = frames(spark, facts, sites)
    whole = {r.site_id: r for r in slices.site_slice(f, s, min_samples=0).collect()}
    halves = defaultdict(lambda: [0.0, 0])
    for part in (range(0, 20), range(20, 48)):
        for dows in ((0, 1, 2), (3, 4, 5, 6)):
            got = slices.site_slice(f, s, dows=dows, buckets=list(part), min_samples=0)
            for r in got.collect():
                halves[r.site_id][0] += r.speed_sum
                halves[r.site_id][1] += r.samples
    assert {i: (r.speed_sum, r.samples) for i, r in whole.items()} == {
        i: tuple(v) for i, v in halves.items()
    }


def test_every_slice_at_once_equals_single_slices(spark):
    facts, sites = random_city(spark)
    f, s = frames(spark, facts, sites)
    every = slices.site_slice(slices.by_scope(f), s, by=["scope", "bucket"], min_samples=1)
    rows = defaultdict(set)
    for r in every.collect():
        rows[r.scope, r.bucket].add((r.site_id, r.speed_sum, r.samples, r.congestion))
    for scope, bucket in (("weekday", 16), ("weekend", 30), ("all", 47)):
        single = slices.site_slice(f, s, dows=DAY_SCOPES[scope], buckets=[bucket], min_samples=1)
        expected = {(r.site_id, r.speed_sum, r.samples, r.congestion) for r in single.collect()}
        assert rows[scope, bucket] == expected


def test_profiles_and_their_labels(spark):
    facts, sites = random_city(spark)
    f, s = frames(spark, facts, sites)
    sums = defaultdict(lambda: [0.0, 0])
    for i, _, _, _, bucket, dow, total, moving, _ in facts:
        if i != 4 and 1 <= dow <= 5:
            for key in (bucket, (f"S{i % 3}", bucket)):
                sums[key][0] += total or 0.0
                sums[key][1] += moving
    city = slices.city_profile(f, s, dows=DAY_SCOPES["weekday"]).collect()
    assert {r.bucket: [r.speed_sum, r.samples] for r in city} == {
        k: v for k, v in sums.items() if isinstance(k, int)
    }
    street = slices.street_profile(f, s, streets=["S0", "S2"], dows=DAY_SCOPES["weekday"])
    assert {(r.street, r.bucket): [r.speed_sum, r.samples] for r in street.collect()} == {
        k: v for k, v in sums.items() if isinstance(k, tuple) and k[0] != "S1"
    }
    label = {r.bucket: (r.time, r.hour) for r in city}
    assert label[35] == ("17:30", 17.5) and label[2] == ("01:00", 1.0)


def test_extremes_take_the_earliest_on_a_tie(spark):
    f, s = frames(
        spark, [fact(1, b, v, 1) for b, v in ((40, 9.0), (3, 9.0), (20, 50.0), (10, 50.0))], [site(1)]
    )
    row = slices.profile_extremes(slices.city_profile(f, s)).first()
    assert (row.low_speed, row.low_time, row.high_speed, row.high_time) == (9.0, "01:30", 50.0, "05:00")


def test_pivot_rounds_half_to_even(spark):
    rows = [("08:00", "A", 20.25), ("08:00", "B", 20.35), ("08:30", "A", 20.75)]
    profile = spark.createDataFrame(rows, "time string, street string, speed double")
    got = {r.time: (r.A, r.B) for r in slices.street_pivot(profile, ["A", "B"]).collect()}
    assert got == {"08:00": (20.2, 20.4), "08:30": (20.8, None)}


def test_ranking_ties_go_by_site(spark):
    facts = [fact(i, 16, v, 3) for i, v in ((5, 30.0), (2, 30.0), (9, 15.0), (1, 90.0))]
    f, s = frames(spark, facts, [site(i, street=f"S{i}") for i in (1, 2, 5, 9)])
    top = slices.slowest(slices.site_slice(f, s), 3).collect()
    assert [r.tramo[:2] for r in top] == ["S9", "S2", "S5"]
    assert top[0].congestion_pct == pytest.approx(90.0)
    export = slices.slice_export(slices.site_slice(f, s)).collect()
    assert [r.speed for r in export] == [5.0, 10.0, 10.0, 30.0] and len(export[0]) == 10


def test_headline(spark):
    facts = [fact(1, 35, 60.0, 3, 1), fact(2, 35, 30.0, 3, 3), fact(1, 4, 150.0, 3)]
    f, s = frames(spark, facts, [site(1, street="X"), site(2, street="Y"), site(3)])
    view = slices.site_slice(f, s, buckets=[35])
    row = slices.headline(view, slices.city_profile(f, s), s).first()
    assert row.mean_speed == 15.0 and row.n_reporting == 2 and row.n_sites == 3
    assert row.all_day_mean == pytest.approx(240 / 9) and row.delta == pytest.approx(15 - 240 / 9)
    assert (row.slowest_speed, row.slowest_street, row.zero_share) == (10.0, "Y", 0.4)
    assert slices.headline(view, slices.city_profile(f, s), s, all_day=True).first().delta is None


def test_headline_of_nothing(spark):
    f, s = frames(spark, [fact(1, 35, 60.0, 3)], [site(1)])
    row = slices.headline(slices.site_slice(f, s, buckets=[2]), slices.city_profile(f, s), s).first()
    assert row.n_reporting == 0 and row.zero_share == 0.0 and row.mean_speed is None


def test_missing_metric_is_counted_and_left_out(spark):
    facts = [fact(1, 16, 60.0, 3), fact(2, 16, 60.0, 3)]
    f, s = frames(spark, facts, [site(1), site(2, ref=False)])
    view = slices.site_slice(f, s)
    assert slices.metric_gaps(view, "congestion").first().n_without_metric == 1
    assert [r.site_id for r in slices.with_metric(view, "congestion").collect()] == [1]
    domain = slices.metric_domain(view, "samples").first()
    assert (domain.low, domain.high) == (3.0, 3.0)
    assigned = spark.createDataFrame([(1, 5), (2, None)], "site_id long, corridor_id long")
    assert matching.unmatched_in_slice(view, assigned).first().n_unmatched == 1


def test_lists(spark):
    f, s = frames(spark, [fact(1, 1, 3.0, 1), fact(1, 2, 3.0, 1)], [site(1, street="b"), site(2)])
    assert [r.date for r in slices.dates(f).collect()] == [DAY]
    assert [r.street for r in slices.street_names(s).collect()] == ["A", "b"]


def test_slice_filters_reach_the_scan(spark):
    facts, sites = random_city(spark)
    f, s = frames(spark, facts, sites)
    stored = staging.stage(f, "facts")
    plan = slices.site_slice(stored, s, dows=(1, 2), buckets=[16])._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "In(dow, [1,2])" in scan and "EqualTo(bucket,16)" in scan
    assert "detector_id" not in scan and "date" not in scan.split("Location")[0]


def test_staged_tables_live_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    df = staging.stage(spark.range(3).withColumn("x", F.lit("a")), "three")
    assert all(folder in path for path in df.inputFiles())
    assert df.count() == 3
