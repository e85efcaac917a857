"""Several periods at once are as many results, each as if it were alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanepulse.operators import field, slices, surface
from lanepulse.operators.field import _by_distance, _distance_and_site

SLICE = """period string, site_id long, lon double, lat double, speed double, speed_sum double, samples long,
n_zero long, n_moving long, street string, tramo string, congestion double"""


def sliced(spark):
    rows = []
    for k, period in enumerate(("a", "b", "c")):
        for i in range(4 + 9 * k):
            speed = None if i == 3 else float(10 + i + 5 * k)
            rows.append((period, i, -56.1 + 0.004 * (i % 5), -34.9 + 0.003 * (i % 7), speed, 20.0 + i, 2 + k, i, 2,
                         f"s{i}", f"t{i}", 0.5))
    return spark.createDataFrame(rows, SLICE)


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_surfaces_of_periods_are_one_each(spark):
    many = sliced(spark)
    cells, grid = surface.surface_cells(many, "speed"), surface.surface_grid(many, "speed")
    bounds, counts = surface.surface_bounds(many, "speed"), surface.supported_cells(cells)
    figures = "i", "j", F.round("value", 9), F.round("support", 9)
    for period in ("a", "b", "c"):
        alone, of = many.where(f"period = '{period}'").drop("period"), f"period = '{period}'"
        assert rows(cells.where(of), *figures) == rows(surface.surface_cells(alone, "speed"), *figures)
        assert grid.where(of).count() == surface.surface_grid(alone, "speed").count()
        columns = surface.surface_bounds(alone, "speed").columns
        assert rows(bounds.where(of), *columns) == rows(surface.surface_bounds(alone, "speed"), *columns)
        assert counts.where(of).first().n_supported == cells.where(of).count()


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_slots_carry_equal_loads_and_fall_on_different_tasks(spark, tasks):
    sizes = spark.createDataFrame([(i, (i * 37) % 400 + 1) for i in range(144)], "frame int, n int")
    slots = surface.balanced_slots(sizes, ["frame"], tasks)
    loads = [r["load"] for r in slots.groupBy("slot").agg(F.sum("n").alias("load")).collect()]
    assert len(loads) == tasks and max(loads) < 1.1 * min(loads)
    at = slots.repartition(tasks, "slot").groupBy(F.spark_partition_id().alias("task")).agg(
        F.count_distinct("slot").alias("n"))
    assert {r["n"] for r in at.collect()} == {1}


def test_surfaces_are_summed_where_their_points_are(spark):
    cells = surface.surface_cells(sliced(spark), "speed")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    # Points per position, and points to the task of their surface; no third shuffle over cells.
    assert plan.split("BroadcastExchange")[0].count("Exchange hashpartitioning(slot") == 1
    assert "hashpartitioning(slot" in plan and "i#" not in plan.split("hashpartitioning(slot")[1].split(")")[0]


def test_headline_of_periods_is_one_each(spark):
    many = sliced(spark)
    profile = many.select("period", "speed_sum", "samples")
    sites = many.select("period", "site_id").union(spark.createDataFrame([("quiet", 1)], "period string, site_id long"))
    got = {r["period"]: r for r in slices.headline(many, profile, sites).collect()}
    for period in ("a", "b", "c"):
        of = f"period = '{period}'"
        alone = slices.headline(
            many.where(of).drop("period"), profile.where(of).drop("period"), sites.where(of).drop("period")
        ).first()
        assert {c: got[period][c] for c in alone.asDict()} == alone.asDict()
    quiet = got["quiet"]
    assert (quiet["n_reporting"], quiet["n_sites"], quiet["zero_share"], quiet["mean_speed"]) == (0, 1, 0.0, None)
    with pytest.raises(ValueError, match="must all have a period"):
        slices.headline(many, profile.drop("period"), sites)


def test_lists_of_periods_are_one_each(spark):
    many = sliced(spark)
    first = slices.slowest(many, 2)
    assert {(r["period"], r["tramo"]) for r in first.collect()} == {(p, t) for p in "abc" for t in ("t0", "t1")}
    gaps = {r["period"]: (r["n_sites"], r["n_without_metric"]) for r in slices.metric_gaps(many, "speed").collect()}
    assert gaps == {"a": (4, 1), "b": (13, 1), "c": (22, 1)}
    low = {r["period"]: r["low"] for r in slices.metric_domain(many, "speed").collect()}
    assert low == {"a": 10.0, "b": 15.0, "c": 20.0}


def test_a_key_orders_by_distance_and_then_site(spark):
    pairs = [(0.12345678901234568, 5), (0.12345678901234567, 9), (0.12345678901234569, 1), (0.0, 999_999_999_999_999),
             (0.0, 0), (99.9, 3), (0.25, 12), (0.25, 11)]
    frame = spark.createDataFrame(pairs, "d double, site long").withColumn("key", _by_distance(F.col("d"), F.col("site")))
    d, site = _distance_and_site(F.col("key"))
    got = [tuple(r) for r in frame.orderBy("key").select(d, site).collect()]
    assert got == sorted(pairs)
    with pytest.raises(Exception, match="15 digits at most"):
        spark.createDataFrame([(0.5, 10**15)], "d double, s long").select(_by_distance(F.col("d"), F.col("s"))).collect()


def test_a_field_of_slices_holds_all_chunks(spark):
    chunks = spark.createDataFrame(
        [(c, "n", "k", c, 0, i, -56.1 + 0.001 * i, -34.9, -56.1 + 0.001 * (i + 1), -34.9, -56.0995 + 0.001 * i, -34.9)
         for c in (1, 2) for i in range(3)],
        "corridor_id long, name string, key string, way_id long, segment int, piece long, lon0 double, lat0 double, "
        "lon1 double, lat1 double, mid_lon double, mid_lat double")
    sites = spark.createDataFrame(
        [("a", 1, 1, -56.1, -34.9, 30.0), ("b", 1, 1, -56.1, -34.9, 10.0), ("c", 7, None, -56.1, -34.9, 5.0)],
        "period string, site_id long, corridor_id long, lon double, lat double, speed double")
    for mode in field.REACH_MODELS:
        got = field.street_field(chunks, sites, "speed", mode=mode, by=["period"])
        assert got.count() == 18 and got.columns[-2:] == ["value", "support"]
        values = {(r["period"], r["corridor_id"], round(r["value"], 9)) for r in got.where("value is not null").collect()}
        assert values == {("a", 1, 30.0), ("b", 1, 10.0)}
        assert got.where("value is null and support = 0").count() >= 12
