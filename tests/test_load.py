"""Reading, cleaning, dead lanes, roll-up and quality rules on hand-made readings."""

from __future__ import annotations

from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from lanepulse import joins
from lanepulse.operators import cleaning, lanes, quality
from lanepulse.plans.ingest import Ingest, build_tables
from lanepulse.sources.readings import files_by_header, pick_alias, read_readings, write_readings_csv
from lanepulse.sources.sample_feed import read_sample_feed
from lanepulse.sources.tables import write_slice_csv

COLUMNS = """detector_id long, lane int, date date, time string, street string,
from_street string, to_street string, lat double, lon double, speed double"""
MONDAY, SUNDAY = date(2026, 8, 3), date(2026, 8, 9)


def reading(speed, *, det=1, lane=1, day=MONDAY, time="08:05:00", street="Calle A", lat=-34.9,
            lon=-56.1, origin="B", goal="C"):
    return (det, lane, day, time, street, origin, goal, lat, lon, speed)


def ingest(spark, rows, period=None):
    return Ingest(spark.createDataFrame(rows, COLUMNS), period)


# --- CSV ---


def write_text(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_accepts_both_spellings_and_unions_files(spark, tmp_path):
    tail = "id_carril,fecha,hora,dsc_avenida,dsc_int_anterior,dsc_int_siguiente,latitud,longitud"
    one = write_text(
        tmp_path / "a.csv",
        f"cod_detector,{tail},velocidad\n"
        "7,1,2026-08-03,07:05:00, Bv España ,X,Y,-34.9,-56.1,42\n"
        "7,1,2026-08-03,07:10:00,Bv España,X,Y,-34.9,-56.1,\n",
    )
    # Columns in another order under the other names.
    two = write_text(
        tmp_path / "b.csv",
        "velocidad_promedio,id_detector," + tail + "\n"
        "0,8,2,2026-08-04,23:55,Bv España,X,Y,,-56.1\n",
    )
    raw = read_readings(spark, [one, two])
    got = {(r.detector_id, r.lane, r.date, r.time, r.lat, r.speed) for r in raw.collect()}
    assert got == {
        (7, 1, date(2026, 8, 3), "07:05:00", -34.9, 42.0),
        (7, 1, date(2026, 8, 3), "07:10:00", -34.9, None),
        (8, 2, date(2026, 8, 4), "23:55", None, 0.0),
    }
    clean = cleaning.clean_readings(raw)
    assert {r.street for r in clean.collect()} == {"Bv España"}
    assert clean.count() == 2  # the row without a latitude is gone


def test_csv_corners_read_as_another_engine_reads_them(spark, tmp_path):
    path = write_text(
        tmp_path / "odd.csv",
        "cod_detector,id_carril,fecha,hora,dsc_avenida,dsc_int_anterior,dsc_int_siguiente,"
        "latitud,longitud,velocidad\n"
        '1,1,2026-08-03,07:05:00,"Av ""Uno"", norte",  B ,C,-34.9,-56.1,42\n'
        '2,1,2026-08-03,07:05:00,"","B\\",C,-34.9,-56.1,""\n'
        "3,1,2026-08-03,07:05:00,,,,-34.9,-56.1,\n",
    )
    names = "detector_id, street, from_street, to_street, lat, speed"
    clean = cleaning.clean_readings(read_readings(spark, path))
    got = [tuple(r) for r in clean.select(*names.split(", ")).orderBy("detector_id").collect()]
    expected = duckdb.sql(
        "SELECT cod_detector, trim(dsc_avenida), trim(dsc_int_anterior), trim(dsc_int_siguiente), "
        f"latitud, velocidad FROM read_csv_auto('{path}', header=true) ORDER BY 1"
    ).fetchall()
    assert got == expected


def test_missing_column_names_what_was_found():
    with pytest.raises(ValueError, match="no speed column.*cod_detector, other"):
        pick_alias(["other", "cod_detector"], "speed")
    assert pick_alias(["velocidad_promedio", "velocidad"], "speed") == "velocidad"


def test_csv_with_a_broken_value_stops(spark, tmp_path):
    path = write_text(
        tmp_path / "bad.csv",
        "cod_detector,id_carril,fecha,hora,dsc_avenida,dsc_int_anterior,dsc_int_siguiente,"
        "latitud,longitud,velocidad\n7,1,2026-08-03,07:05:00,A,B,C,-34.9,-56.1,fast\n",
    )
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        read_readings(spark, path).collect()


TAIL = "id_carril,fecha,hora,dsc_avenida,dsc_int_anterior,dsc_int_siguiente,latitud,longitud"


def test_files_of_one_folder_may_have_other_headers(spark, tmp_path):
    import gzip

    write_text(tmp_path / "1.csv", f"cod_detector,{TAIL},velocidad\n1,1,2026-08-03,07:05:00,A,B,C,-34.9,-56.1,42\n")
    write_text(tmp_path / "2.csv", f"\ufeffvelocidad_promedio,{TAIL},id_detector\n43,1,2026-08-03,07:05:00,A,B,C,-34.9,-56.1,2\n")
    write_text(tmp_path / "3.csv", f"cod_detector,{TAIL},velocidad\n3,1,2026-08-03,07:05:00,A,B,C,-34.9,-56.1,44\n")
    write_text(tmp_path / "none.csv", "")
    with gzip.open(tmp_path / "4 b.csv.gz", "wt") as out:
        out.write(f"id_detector,{TAIL},velocidad,more\n4,1,2026-08-03,07:05:00,A,B,C,-34.9,-56.1,,x\n")
    assert sorted(len(f) for f in files_by_header(spark, str(tmp_path)).values()) == [1, 1, 2]
    for path in (str(tmp_path), f"{tmp_path}/*", [f"{tmp_path}/[12].csv", f"{tmp_path}/3.csv", f"{tmp_path}/4*"]):
        got = {(r.detector_id, r.speed) for r in read_readings(spark, path).collect()}
        assert got == {(1, 42.0), (2, 43.0), (3, 44.0), (4, None)}
    with pytest.raises(ValueError, match="no file with a header"):
        read_readings(spark, f"{tmp_path}/none.csv")


def test_a_blank_street_is_a_street(spark, tmp_path):
    path = write_text(
        tmp_path / "blank.csv",
        f"cod_detector,{TAIL},velocidad\n1,1, 2026-08-03,07:05:00, ,B,C, -34.9 ,-56.1, 42 \n"
        "2,1,2026-08-03,07:05:00,,B,C,-34.9,-56.1,  \n3,1,2026-08-03,07:05:00, A ,B,C,-34.9,-56.1,0\n",
    )
    clean = cleaning.clean_readings(read_readings(spark, path))
    assert {(r.detector_id, r.street, r.speed) for r in clean.collect()} == {
        (1, "", 42.0), (2, None, None), (3, "A", 0.0)
    }
    load = Ingest(read_readings(spark, path))
    assert {r.street for r in load.detectors().collect()} == {"", "A"}
    assert cleaning.load_report(load.cells).first().n_unjoinable == 1


@pytest.mark.parametrize("line", [
    "x,1,2026-08-03,07:05:00,A,B,C,-34.9,-56.1,1", "1,1,03/08/2026,07:05:00,A,B,C,-34.9,-56.1,1",
    "1,1,2026-08-03,07:05:00,A,B,C,west,-56.1,1", "1,1,2026-08-03,07:05:00,A,B,C,-34.9",
])
def test_values_that_cannot_be_read_stop_the_job(spark, tmp_path, line):
    path = write_text(tmp_path / "bad.csv", f"cod_detector,{TAIL},velocidad\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_readings(spark, path).collect()


def test_build_tables_from_csv_equals_the_direct_load(spark, tmp_path):
    feed = read_sample_feed(spark, "/root/testdata/sf0.001")
    write_readings_csv(feed, str(tmp_path / "csv"), {"speed": "velocidad_promedio"})
    built = build_tables(spark, str(tmp_path / "csv"), str(tmp_path / "out"))
    direct = Ingest(feed)
    facts = direct.measurements
    assert built["measurements"].exceptAll(facts).count() == 0
    assert built["measurements"].count() == facts.count()
    assert built["detectors"].count() == direct.detectors().count()
    assert built["load_report"].first().n_rows == direct.readings.count()


def test_build_tables_per_period_keeps_the_period_as_text(spark, tmp_path):
    feed = read_sample_feed(spark, "/root/testdata/sf0.01")
    feed = feed.withColumn("date", F.when(F.col("detector_id") % 3 == 0, F.date_add("date", 31))
                           .otherwise(F.col("date")))
    write_readings_csv(feed, str(tmp_path / "csv"))
    month = F.date_format("date", "yyyy-MM")
    built = build_tables(spark, str(tmp_path / "csv"), str(tmp_path / "out"), period=month)
    periods = {r.period for r in built["measurements"].select("period").distinct().collect()}
    assert periods == {"2024-01", "2024-02", "2024-03"}
    direct = Ingest(feed, month).measurements
    columns = direct.columns
    assert built["measurements"].select(columns).exceptAll(direct).count() == 0
    assert {r.period for r in built["detectors"].select("period").collect()} == periods


# --- classes, buckets, weekdays ---


def test_classes_cover_every_reading_once(spark):
    speeds = [None, -1.0, 0.0, 0.5, 120.0, 120.5, 300.0]
    load = ingest(spark, [reading(s, det=i) for i, s in enumerate(speeds)])
    counts = {r.reading_class: r.n for r in cleaning.class_counts(load.readings).collect()}
    assert counts == {"missing": 1, "negative": 1, "zero": 1, "moving": 2, "implausible": 2}
    report = cleaning.load_report(load.cells).first()
    assert report.n_rows == 7 and report.n_implausible == 2
    shares = [report[c] for c in report.asDict() if c.startswith("share_")]
    assert sum(shares) == pytest.approx(1.0)


def test_report_of_nothing_has_no_shares(spark):
    report = cleaning.load_report(ingest(spark, []).cells).first()
    assert report.n_rows == 0 and report.share_zero is None


def test_bucket_and_weekday(spark):
    load = ingest(spark, [
        reading(30.0, time="00:00:00"), reading(30.0, time="17:59"),
        reading(30.0, time="23:55:00", day=SUNDAY),
    ])
    got = {(r.bucket, r.dow) for r in load.measurements.collect()}
    assert got == {(0, 1), (35, 1), (47, 0)}


def test_rows_without_a_full_site_key_join_nothing(spark):
    load = ingest(spark, [reading(30.0), reading(40.0, origin=None), reading(50.0, origin=None)])
    assert load.sites.count() == 2
    assert load.measurements.count() == 1
    assert load.detectors().count() == 1
    assert cleaning.load_report(load.cells).first().n_unjoinable == 2


def test_sites_are_numbered_in_key_order_with_missing_last(spark):
    load = ingest(spark, [
        reading(1.0, lat=-34.9, street="b"), reading(1.0, lat=-34.9, street="a"),
        reading(1.0, lat=-35.0, street="z"), reading(1.0, lat=-34.9, street=None),
    ])
    got = {r.site_id: (r.lat, r.street) for r in load.sites.collect()}
    assert got == {1: (-35.0, "z"), 2: (-34.9, "a"), 3: (-34.9, "b"), 4: (-34.9, None)}


# --- lanes ---


def test_dead_lanes(spark):
    load = ingest(spark, [
        *[reading(0.0, lane=1) for _ in range(4)],           # never moving
        *[reading(2.0, lane=2) for _ in range(4)],           # only crawling
        reading(2.0, lane=3), reading(4.0, lane=3),          # mean exactly at the limit
        reading(None, lane=4), reading(500.0, lane=4),       # nothing valid: not a lane
        reading(-5.0, lane=5), reading(30.0, lane=5),
    ])
    dead = {r.lane: r.is_dead for r in load.health.collect()}
    assert dead == {1: True, 2: True, 3: False, 5: False}
    report = lanes.dead_lane_report(load.health).first()
    assert (report.n_dead_lanes, report.n_lanes) == (2, 4)
    assert (report.dead_zero_readings, report.dead_moving_readings) == (4, 4)
    site = load.detectors().first()
    assert (site.n_lanes, site.n_dead_lanes, site.n_missing) == (2, 2, 1)
    assert site.n_readings == 4  # the negative reading is valid, but not moving
    assert site.mean_speed == pytest.approx(12.0)


def test_lane_numbers_are_counted_not_lanes(spark):
    load = ingest(spark, [reading(30.0, det=1), reading(30.0, det=2), reading(30.0, det=2, lane=2)])
    site = load.detectors().first()
    assert (site.n_detectors, site.n_lanes) == (2, 2)


def test_site_with_only_dead_lanes_stays_without_a_mean(spark):
    load = ingest(spark, [reading(0.0), reading(30.0, street="Other")])
    sites = {r.street: r for r in quality.flag_sites(load.detectors()).collect()}
    gone = sites["Calle A"]
    assert gone.mean_speed is None and not gone.is_live and not gone.is_usable
    assert gone.n_lanes == 0 and gone.n_dead_lanes == 1
    assert sites["Other"].is_usable


def test_dead_lane_is_judged_inside_its_period(spark):
    later = date(2026, 9, 1)
    rows = [reading(0.0), reading(0.0), reading(40.0, day=later)]
    assert ingest(spark, rows).measurements.count() == 2
    split = ingest(spark, rows, F.date_format("date", "yyyy-MM")).measurements
    assert [r.period for r in split.collect()] == ["2026-09"]


# --- site figures ---


def test_free_flow_interpolates_between_readings(spark):
    load = ingest(spark, [reading(float(s)) for s in (10, 20, 30, 40)] + [reading(0.0)])
    assert load.detectors().first().free_flow_speed == pytest.approx(35.5)


def test_day_and_night_use_weekdays_only(spark):
    rows = [
        reading(10.0, time="07:00:00"), reading(20.0, time="21:59:00"),
        reading(50.0, time="02:00:00"), reading(60.0, time="05:59:00"),
        reading(99.0, time="06:00:00"), reading(99.0, time="22:00:00"),
        reading(1.0, time="12:00:00", day=SUNDAY), reading(0.0, time="12:00:00"),
    ]
    site = ingest(spark, rows).detectors().first()
    assert (site.day_speed, site.night_speed) == (15.0, 55.0)


def test_all_zero_group_has_no_sum(spark):
    load = ingest(spark, [reading(0.0), reading(30.0, time="12:00:00")])
    got = {r.bucket: (r.speed_sum, r.n_moving, r.n_zero) for r in load.measurements.collect()}
    assert got == {16: (None, 0, 1), 24: (30.0, 1, 0)}


FLAGS = """site_id long, n_zero long, n_readings long, n_missing long, mean_speed double,
free_flow_speed double, day_speed double, night_speed double, streets_at_coord long,
n_dead_lanes long"""


def flags(spark, **changes):
    row = dict(site_id=1, n_zero=0, n_readings=9, n_missing=0, mean_speed=20.0,
               free_flow_speed=50.0, day_speed=20.0, night_speed=40.0, streets_at_coord=1,
               n_dead_lanes=0) | changes
    return quality.flag_sites(spark.createDataFrame([tuple(row.values())], FLAGS))


@pytest.mark.parametrize(
    "changes, flag, expected",
    [
        ({"mean_speed": 3.0}, "is_live", True),
        ({"mean_speed": 2.99}, "is_live", False),
        ({"mean_speed": None}, "is_live", False),
        ({"free_flow_speed": 10.0}, "has_reference", True),
        ({"free_flow_speed": None}, "has_reference", False),
        ({"day_speed": 1.5, "night_speed": 30.0}, "is_stalled", True),
        ({"day_speed": 1.5, "night_speed": 4.5}, "is_stalled", False),
        ({"day_speed": None, "night_speed": 30.0}, "is_stalled", False),
        ({"day_speed": 1.5, "night_speed": 30.0}, "is_usable", False),
        ({"streets_at_coord": 2}, "has_location", True),
        ({"streets_at_coord": 3}, "has_location", False),
    ],
)
def test_quality_flags(spark, changes, flag, expected):
    assert flags(spark, **changes).first()[flag] is expected


def test_excluded_sites_and_the_rest_add_up(spark):
    sites = quality.flag_sites(Ingest(read_sample_feed(spark, "/root/testdata/sf0.01")).detectors())
    c = quality.quality_counters(sites).first()
    mapped = quality.mappable(sites).count()
    # Flat sites are never stalled, and only usable ones are counted as unlocated.
    assert c.n_sites - c.n_flatlined - c.n_stalled - c.n_without_location == mapped
    assert mapped == quality.usable(sites).where("has_location").count()


def test_key_check_reports_repeats(spark):
    frame = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert quality.key_check(frame, ["k"]).first().asDict() == {
        "n_rows": 3, "n_keys": 2, "n_repeated": 1
    }
    assert [r.k for r in quality.repeated_keys(frame, ["k"]).collect()] == [1]


# --- the other way, without a broadcast ---


def test_site_table_too_large_to_broadcast_gives_the_same_tables(spark, monkeypatch):
    feed = read_sample_feed(spark, "/root/testdata/sf0.01")
    small = Ingest(feed)
    facts, sites = small.measurements, small.detectors()
    facts_rows, sites_rows = facts.collect(), sites.collect()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    large = Ingest(feed)
    assert sorted(facts_rows, key=repr) == sorted(large.measurements.collect(), key=repr)
    assert sorted(r.site_id for r in sites_rows) == sorted(
        r.site_id for r in large.detectors().collect()
    )
    by_id = {r.site_id: r.free_flow_speed for r in sites_rows}
    assert by_id == {r.site_id: r.free_flow_speed for r in large.detectors().collect()}


def test_slice_export_file(spark, tmp_path):
    export = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("c", None)], "street string, speed double")
    write_slice_csv(export, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["street", "speed"] and back.count() == 3


def test_times_that_are_none_stop_the_job(spark):
    from lanepulse.functions.clock import time_bucket

    good = spark.createDataFrame([("07:05",), ("23:59:59",), (" 0:00 ",), (None,)], "time string")
    assert [r[0] for r in good.select(time_bucket(F.col("time"))).collect()] == [14, 47, 0, None]
    for text in ("7.05", "07:10 PM", "25:99:00"):
        with pytest.raises(Exception, match="not a time of day"):
            spark.createDataFrame([(text,)], "time string").select(time_bucket(F.col("time"))).collect()


def test_cells_are_the_same_on_both_sides_of_the_size_check(spark, monkeypatch):
    from lanepulse.operators import cleaning, sites

    rows = [(1, 1, "2024-01-01", "07:00", s, "b", "c", -34.9, -56.2, 10.0) for s in ("a", "a", None, None)]
    rows += [(1, 1, "2024-01-01", "07:10", None, None, "c", -34.9, -56.1, 20.0)]
    frame = spark.createDataFrame(
        rows, "detector_id long, lane int, date string, time string, street string, from_street string, "
        "to_street string, lat double, lon double, speed double"
    )
    numbered = sites.number_sites(frame.where("street is not null"))
    want = sorted(map(tuple, cleaning.bucket_cells(frame, numbered).collect()), key=repr)
    monkeypatch.setattr(sites, "is_small", lambda _: False)
    order = cleaning.bucket_cells(frame, numbered)
    monkeypatch.undo()
    columns = cleaning.bucket_cells(frame, numbered).columns
    assert sorted(map(tuple, order.select(*columns).collect()), key=repr) == want


def test_months_loaded_one_by_one_equal_one_load(spark, tmp_path):
    september = date(2026, 9, 1)
    august = [reading(30.0), reading(20.0, street="M")]
    # A new site that comes first in the order of keys.
    later = [reading(50.0, day=september), reading(40.0, day=september, lat=-35.0, street="A new one")]
    month = F.date_format("date", "yyyy-MM")

    def load(rows, name, out):
        write_readings_csv(spark.createDataFrame(rows, COLUMNS), str(tmp_path / name))
        return build_tables(spark, str(tmp_path / name), str(tmp_path / out), period=month)

    def rows(built, table):
        frame = built[table].drop("site_id")
        return sorted(map(repr, frame.select(*sorted(frame.columns)).collect()))

    whole = load(august + later, "both", "whole")
    load(august, "one", "apart")
    apart = load(later, "two", "apart")
    tables = ("measurements", "detectors")
    want = [rows(whole, table) for table in tables]
    assert [rows(apart, table) for table in tables] == want
    # A month loaded again takes the place of its own files alone.
    again = load(later, "three", "apart")
    assert [rows(again, table) for table in tables] == want
    pairs = again["measurements"].join(again["detectors"], ["period", "site_id"])
    assert pairs.count() == 4 and pairs.where(
        again["measurements"]["site_key"] != again["detectors"]["site_key"]).count() == 0


def test_placeholders_and_reports_are_per_period(spark):
    september = date(2026, 9, 1)
    rows = [reading(30.0, street=s) for s in ("a", "b")] + [reading(30.0, street=s, day=september) for s in ("c", "d")]
    assert {r.streets_at_coord for r in ingest(spark, rows).detectors().collect()} == {4}
    split = ingest(spark, rows, F.date_format("date", "yyyy-MM"))
    sites = quality.flag_sites(split.detectors())
    assert {r.streets_at_coord for r in sites.collect()} == {2}
    assert {(r.period, r.n_sites) for r in quality.quality_counters(sites).collect()} == {("2026-08", 2), ("2026-09", 2)}
    assert {(r.period, r.n_rows) for r in cleaning.load_report(split.cells).collect()} == {("2026-08", 2), ("2026-09", 2)}


def test_a_repeated_key_stops_the_job(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert quality.one_per_key(frame.where("v > 'a'"), ["k"]).count() == 2
    with pytest.raises(Exception, match="several rows for one value of k"):
        quality.one_per_key(frame, ["k"]).collect()
