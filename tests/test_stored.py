"""Loads one after another: tables published together, site numbers that stay, sums of periods."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from test_load import COLUMNS, MONDAY, reading

from lanepulse.operators import cleaning
from lanepulse.operators.sites import extend_sites, number_sites
from lanepulse.params import UNDATED
from lanepulse.plans import ingest
from lanepulse.plans.ingest import Ingest, build_tables
from lanepulse.plans.stored import PeriodStore
from lanepulse.sources.readings import write_readings_csv
from lanepulse.sources.versions import Draft, Versions

SEPTEMBER, OCTOBER = date(2026, 9, 1), date(2026, 10, 1)


def month():
    return F.date_format("date", "yyyy-MM")


def rows(df, *without):
    return sorted(map(repr, df.select(*sorted(set(df.columns) - set(without))).collect()))


def frame(spark, readings):
    return spark.createDataFrame(readings, COLUMNS)


def parts(spark, *values):
    return spark.createDataFrame([(v, n) for v, n in values], "period string, n long")


def numbers(df):
    return {tuple(r) for r in df.select("period", "n").collect()}


# --- versions ---


def test_parts_are_replaced_and_kept(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.latest() == 0 and v.record() == {}
    with pytest.raises(ValueError, match="no table facts"):
        v.read("facts")
    draft = v.begin()
    written = draft.write("facts", parts(spark, ("a/b:c", 1), ("p", 2), ("q", 3)), "period")
    assert numbers(written) == {("a/b:c", 1), ("p", 2), ("q", 3)}
    assert draft.publish() == 1 and v.parts("facts") == ["a/b:c", "p", "q"]
    draft = v.begin()
    draft.write("facts", parts(spark, ("p", 20)), "period")
    # A part that the load looked at and has no rows for goes as well.
    assert draft.publish(["p", "q"]) == 2
    assert numbers(v.read("facts")) == {("a/b:c", 1), ("p", 20)}
    assert numbers(v.read("facts", ["p", "none"])) == {("p", 20)}
    assert numbers(v.read("facts", [])) == set()
    assert numbers(v.read("facts", version=1)) == {("a/b:c", 1), ("p", 2), ("q", 3)}
    whole = v.begin()
    whole.write("facts", parts(spark, ("z", 9)))
    whole.publish()
    assert numbers(v.read("facts")) == {("z", 9)}


def test_a_second_load_of_the_same_version_stops(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    one, two = v.begin(), v.begin()
    one.write("facts", parts(spark, ("a", 1)), "period")
    two.write("facts", parts(spark, ("b", 2)), "period")
    one.publish()
    with pytest.raises(RuntimeError, match="published by another load"):
        two.publish()
    assert numbers(v.read("facts")) == {("a", 1)}


def test_unused_folders_go_and_used_ones_stay(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    for n in (1, 2, 3):
        draft = v.begin()
        draft.write("facts", parts(spark, ("a", n), *([("b", 0)] if n == 1 else [])), "period")
        draft.publish()
    v.begin().write("facts", parts(spark, ("c", 7)), "period")  # never published
    assert v.discard_unused(keep=1) == []  # all too young
    gone = v.discard_unused(keep=1, older_than_s=-60)
    # The first load still holds part b.
    assert len([g for g in gone if g.startswith("facts/")]) == 2
    assert numbers(v.read("facts")) == {("a", 3), ("b", 0)} and v.latest() == 3


# --- site numbers ---


def test_sites_keep_their_numbers(spark):
    first = number_sites(frame(spark, [reading(1.0, street="M"), reading(1.0, street="B"), reading(1.0, street=None)]))
    later = frame(spark, [
        reading(1.0, street="A"), reading(2.0, street="M"), reading(1.0, street=None), reading(1.0, street="Z"),
    ])
    both = extend_sites(first, later)
    got = {r.street: r.site_id for r in both.collect()}
    assert both.count() == 5 and got == {"B": 1, "M": 2, None: 3, "A": 4, "Z": 5}
    assert rows(extend_sites(both, later.limit(0))) == rows(both)


# --- sums of periods ---

AUGUST = [
    reading(30.0), reading(0.0, lane=2), reading(0.0, lane=2), reading(20.0, street="M"), reading(None, lane=3),
    reading(50.0, time="02:10:00"), reading(500.0), reading(12.0, street=None),
]
LATER = [
    # Lane 2 was dead in August and is not over both months.
    reading(40.0, day=SEPTEMBER, lane=2), reading(40.0, day=SEPTEMBER, lat=-35.0, street="A new one"),
    reading(7.0, day=SEPTEMBER, street="Third"), reading(2.0, day=SEPTEMBER, street="Dead"),
]
UNKNOWN = [reading(33.0, day=None), reading(44.0, day=OCTOBER)]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    store = PeriodStore(spark, str(tmp_path_factory.mktemp("store")))
    for part in (LATER, AUGUST, UNKNOWN):
        store.load(frame(spark, part), month())
    return store


def test_figures_of_all_months_equal_one_load(spark, kept):
    assert kept.periods() == ["2026-08", "2026-09", "2026-10", UNDATED]
    whole = Ingest(frame(spark, AUGUST + LATER + UNKNOWN))
    view = kept.view()
    key = ["lat", "lon", "street", "from_street", "to_street"]
    assert rows(view.detectors(), "site_id") == rows(whole.detectors(), "site_id")
    for name in ("measurements", "cells"):
        ours = getattr(view, name).join(view.sites.select("site_id", "site_key"), "site_id", "left")
        theirs = getattr(whole, name).join(whole.sites.select("site_id", "site_key"), "site_id", "left")
        assert rows(ours, "site_id") == rows(theirs, "site_id")
    assert rows(cleaning.load_report(view.cells)) == rows(cleaning.load_report(whole.cells))
    assert view.sites.select(*key).distinct().count() == view.sites.count()


def test_figures_of_some_months_equal_a_load_of_those(spark, kept):
    for months, part in (["2026-08"], AUGUST), (["2026-08", "2026-09"], AUGUST + LATER), (["2026-07"], []):
        whole = Ingest(frame(spark, part))
        assert rows(kept.view(months).detectors(), "site_id") == rows(whole.detectors(), "site_id")


def test_figures_by_month_equal_a_load_by_month(spark, kept):
    whole = Ingest(frame(spark, AUGUST + LATER), month())
    view = kept.view(["2026-08", "2026-09"], by_period=True)
    assert rows(view.detectors(), "site_id") == rows(whole.detectors(), "site_id")
    assert rows(view.measurements, "site_id") == rows(whole.measurements, "site_id")


def test_detectors_from_sums_read_no_cells(kept):
    files = kept.view().detectors().inputFiles()
    assert files and not any("/cells/" in f for f in files)


def test_a_month_loaded_again_takes_its_own_place(spark, tmp_path):
    store = PeriodStore(spark, str(tmp_path))
    store.load(frame(spark, AUGUST), month())
    store.load(frame(spark, LATER), month())
    before = rows(store.view(["2026-09"]).detectors())
    numbered = {r.site_key: r.site_id for r in store.view().sites.collect()}
    store.load(frame(spark, [reading(11.0), reading(None, street="M", day=MONDAY)]), month())
    assert rows(store.view(["2026-09"]).detectors()) == before
    assert store.view(["2026-08"]).detectors().select("mean_speed").collect()[0][0] == 11.0
    now = {r.site_key: r.site_id for r in store.view().sites.collect()}
    assert numbered.items() <= now.items()


def test_a_stopped_load_leaves_the_earlier_tables(spark, tmp_path, monkeypatch):
    store = PeriodStore(spark, str(tmp_path))
    store.load(frame(spark, AUGUST), month())
    before = rows(store.view().detectors()), rows(store.view().measurements), rows(store.view().sites)
    write, done = Draft.write, []

    def stops(self, table, df, by=None):
        if len(done) == 3:
            raise RuntimeError("executor lost")
        done.append(table)
        return write(self, table, df, by)

    monkeypatch.setattr(Draft, "write", stops)
    with pytest.raises(RuntimeError, match="executor lost"):
        store.load(frame(spark, LATER), month())
    monkeypatch.undo()
    assert (rows(store.view().detectors()), rows(store.view().measurements), rows(store.view().sites)) == before
    store.load(frame(spark, LATER), month())
    assert rows(store.view().detectors(), "site_id") == rows(
        Ingest(frame(spark, AUGUST + LATER)).detectors(), "site_id")


# --- both tables of a load ---


def test_a_load_stopped_between_its_tables_leaves_the_earlier_pair(spark, tmp_path, monkeypatch):
    def csv(part, name):
        write_readings_csv(frame(spark, part), str(tmp_path / name))
        return str(tmp_path / name)

    out = str(tmp_path / "out")
    built = build_tables(spark, csv(AUGUST, "a"), out, period=month())
    want = {t: rows(built[t]) for t in ("measurements", "detectors")}

    def stops(self, facts=None):
        raise RuntimeError("stopped")

    monkeypatch.setattr(ingest.Ingest, "detectors", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        build_tables(spark, csv(LATER + AUGUST[:1], "b"), out, period=month())
    monkeypatch.undo()
    versions = Versions(spark, out)
    assert {t: rows(versions.read(t)) for t in want} == want
    later = build_tables(spark, csv(LATER + UNKNOWN, "c"), out, period=month())
    assert versions.parts("detectors") == ["2026-08", "2026-09", "2026-10", UNDATED]
    # Numbers of sites hold over the loads, in both tables.
    pairs = later["measurements"].join(later["detectors"], ["period", "site_id"])
    assert pairs.count() == later["measurements"].count()
    assert later["detectors"].select("site_id", "site_key").distinct().count() == \
        later["detectors"].select("site_id").distinct().count()


def test_folders_lay_facts_out_and_change_no_rule(spark, tmp_path):
    write_readings_csv(frame(spark, AUGUST + LATER), str(tmp_path / "csv"))
    plain = build_tables(spark, str(tmp_path / "csv"), str(tmp_path / "plain"))
    laid = build_tables(spark, str(tmp_path / "csv"), str(tmp_path / "laid"), folders=month())
    versions = Versions(spark, str(tmp_path / "laid"))
    assert versions.parts("measurements") == ["2026-08", "2026-09"] and versions.parts("detectors") == [""]
    assert rows(laid["measurements"], "folder") == rows(plain["measurements"])
    assert rows(laid["detectors"]) == rows(plain["detectors"])
    # Lane 2 is alive over both months; a slice of one folder reads that alone.
    files = laid["measurements"].where("folder = '2026-08'").inputFiles()
    assert files and all("folder=2026-08" in f for f in versions.read("measurements", ["2026-08"]).inputFiles())
    write_readings_csv(frame(spark, LATER), str(tmp_path / "less"))
    less = build_tables(spark, str(tmp_path / "less"), str(tmp_path / "laid"), folders=month())
    assert versions.parts("measurements") == ["2026-09"] and less["detectors"].count() == 4
    with pytest.raises(ValueError, match="laid out by period"):
        build_tables(spark, str(tmp_path / "csv"), str(tmp_path / "no"), period=month(), folders=month())


def test_load_writes_cells_once_and_deals_periods_over_tasks(spark, tmp_path, monkeypatch):
    from lanepulse.plans import ingest, stored

    staged = []
    for module in (ingest, stored):
        keep = module.stage
        monkeypatch.setattr(module, "stage", lambda df, label, keep=keep: (staged.append(label), keep(df, label))[1])
    rows = [(n, 1, f"2026-01-{1 + n % 20:02d}", "08:00", "A", "B", "C", -34.9, -56.1, 30.0) for n in range(4000)]
    names = "detector_id long, lane int, date string, time string, street string, from_street string, to_street string, lat double, lon double, speed double"
    raw = spark.createDataFrame(rows, names).withColumn("date", F.col("date").cast("date"))
    kept = stored.PeriodStore(spark, str(tmp_path))
    kept.load(raw, F.lit("2026-01"))
    assert "cells" not in staged
    assert kept.view().cells.count() == 4000
    plan = stored._by_period(raw.withColumn("period", F.lit("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "part#" in plan
