"""Joins of cells crowded on either side, and keys looked at once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_load import flags

from lanepulse import joins
from lanepulse.joins import cell_join
from lanepulse.operators import quality, slices

N = 900


def sides(spark, n=N):
    """One cell crowded on both sides, one on each side alone, and quiet ones."""
    cell = F.when(F.col("id") < n, 1).when(F.col("id") < n + 300, 2).otherwise(F.col("id"))
    rows = spark.range(n + 400).select(cell.alias("c"), F.col("id").alias("r"))
    cell = F.when(F.col("id") < n, 1).when(F.col("id") < n + 300, 3).otherwise(F.col("id") - 20)
    tiles = spark.range(n + 400).select(cell.alias("c"), (F.col("id") * 7).alias("t"))
    # Copies of rows are dropped; copies of tiles are tiles.
    return rows.union(rows.where("r % 10 = 0")), tiles


@pytest.mark.parametrize("broadcast", [True, False])
def test_cells_crowded_on_both_sides_equal_the_plain_join(spark, monkeypatch, broadcast):
    monkeypatch.setattr(joins, "ROWS_PER_PART", 100)
    monkeypatch.setattr(joins, "TILES_PER_PART", 60)
    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    rows, tiles = sides(spark)
    got = cell_join(rows, tiles, ["c"])
    assert got.columns == ["c", "r", "t"]
    want = rows.distinct().join(tiles, "c")
    sums = [F.count("*"), F.sum(F.xxhash64("c", "r", "t").cast("decimal(38,0)"))]
    assert got.agg(*sums).first() == want.agg(*sums).first()
    assert got.distinct().count() == got.count()
    # The pairs of the crowded cell are spread: 9 x 15 rectangles over 8 tasks.
    tasks = got.where("c = 1").groupBy(F.spark_partition_id()).count().collect()
    pairs = sorted(r["count"] for r in tasks)
    assert sum(pairs) == N * N and len(pairs) == 8 and pairs[-1] < 2 * pairs[len(pairs) // 2]


def test_quiet_cells_are_joined_without_a_deal(spark, monkeypatch):
    rows, tiles = sides(spark)
    got = cell_join(rows, tiles, ["c"])
    assert "row_parts" not in got._jdf.queryExecution().toString()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    again = cell_join(rows, tiles, ["c"])
    assert "row_parts" not in again._jdf.queryExecution().toString()
    assert again.count() == got.count() == rows.distinct().join(tiles, "c").count()


def test_crowded_cells_name_their_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_PART", 100)
    monkeypatch.setattr(joins, "TILES_PER_PART", 60)
    rows, tiles = sides(spark)
    tiles = tiles.union(spark.createDataFrame([(2, 1)], "c long, t long"))
    rows = rows.distinct().union(spark.createDataFrame([(3, 1)], "c long, r long"))
    got = {r["c"]: (r["row_parts"], r["tile_parts"]) for r in joins.crowded_cells(rows, tiles, ["c"]).collect()}
    assert got == {1: (9, 15), 2: (3, 1), 3: (1, 5)}


FACTS = "site_id long, dow int, bucket int, speed_sum double, n_moving long, n_zero long"


def test_a_key_looked_at_once_costs_slices_no_shuffle(spark):
    streets = {c: F.lit(c) for c in ("street", "from_street", "to_street")}
    sites = flags(spark).withColumns(streets)
    facts = spark.createDataFrame([(1, 1, 35, 40.0, 2, 0), (1, 2, 35, 20.0, 1, 0)], FACTS)
    loose = slices.site_slice(facts, sites)
    checked = slices.site_slice(facts, quality.checked_once(sites))
    assert checked.collect() == loose.collect() and checked.count() == 1
    # One grouping, of the facts; sites are grouped only to be looked at.
    groupings = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert (groupings(checked), groupings(loose)) == (1, 2)
    # A frame made from it is looked at again.
    assert not quality.is_checked(sites.union(sites), ["site_id"])
    with pytest.raises(Exception, match="several rows for one value of site_id"):
        slices.site_slice(facts, sites.union(sites)).collect()
    with pytest.raises(ValueError, match="several rows for one value of site_id"):
        quality.checked_once(sites.union(sites))
