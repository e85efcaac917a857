"""Road polylines to short chunks, grouped into connected corridors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.functions.geo import distance, grid_cell, x_km, y_km
from lanepulse.functions.names import name_key
from lanepulse.operators.numbering import dense_ids
from lanepulse.params import DEFAULTS, Params
from lanepulse.staging import stage, stage_observed

CHUNK_KEY = ["way_id", "segment", "piece"]
# Links that one task of a round writes, about.
LINKS_PER_FILE = 100_000


def keyed_ways(ways: DataFrame) -> DataFrame:
    """Drawable ways with the normalised name they are grouped by."""
    return ways.where(F.size("coords") >= 2).withColumn("key", name_key(F.col("name")))


def split_ways(
    ways: DataFrame, keep: Sequence[str] = (), p: Params = DEFAULTS
) -> DataFrame:
    """Each polyline as equal pieces of at most the chunk length, per segment.

    `keep` names further columns of the way to repeat on its pieces.
    """
    points = F.size("coords") - 1
    ends = F.arrays_zip(
        F.slice("coords", 1, points).alias("a"), F.slice("coords", 2, points).alias("b")
    )
    segments = ways.select("way_id", *keep, F.posexplode(ends).alias("at", "ends")).select(
        "way_id",
        *keep,
        (F.col("at") + 1).alias("segment"),
        F.col("ends.a").alias("a"),
        F.col("ends.b").alias("b"),
    )
    length = distance(
        x_km(F.col("b.lon"), p), y_km(F.col("b.lat"), p),
        x_km(F.col("a.lon"), p), y_km(F.col("a.lat"), p),
    )
    steps = F.greatest(F.ceil(length / F.lit(p.chunk_m / 1000.0)), F.lit(1))
    pieces = segments.withColumn("steps", steps).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("steps") - 1))
    )

    def along(axis: str, share):
        start, end = F.col(f"a.{axis}"), F.col(f"b.{axis}")
        return start + (end - start) * share

    first, last = F.col("piece") / F.col("steps"), (F.col("piece") + 1) / F.col("steps")
    return pieces.select(
        *keep,
        *CHUNK_KEY,
        along("lon", first).alias("lon0"),
        along("lat", first).alias("lat0"),
        along("lon", last).alias("lon1"),
        along("lat", last).alias("lat1"),
    )


def way_links(ways: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Edges (hi, lo) that connect same-named ways through shared or adjoining cells.

    Every occupied cell is stood for by its lowest way. A way links to the
    stand-ins of its cells, and stand-ins of adjoining cells link to each other:
    the same connections as pairing all occupants, at a size linear in the vertices.
    """
    vertex = F.col("vertex")
    occupied = (
        ways.select("way_id", "key", F.explode("coords").alias("vertex"))
        .select(
            "way_id",
            "key",
            grid_cell(x_km(vertex["lon"], p), p.adjacency_cell_km).alias("cx"),
            grid_cell(y_km(vertex["lat"], p), p.adjacency_cell_km).alias("cy"),
        )
        .distinct()
    )
    cell = ["key", "cx", "cy"]
    keepers = occupied.groupBy(*cell).agg(F.min("way_id").alias("keeper"))
    inside = occupied.join(keepers, cell).select("way_id", F.col("keeper").alias("other"))

    # Half of the eight neighbours is enough, as links have no direction.
    ahead = F.array(
        *[
            F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"))
            for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1))
        ]
    )
    shifted = keepers.select(
        F.col("keeper").alias("way_id"), "key", F.explode(ahead).alias("c")
    ).select("way_id", "key", "c.cx", "c.cy")
    across = shifted.join(keepers, cell).select("way_id", F.col("keeper").alias("other"))
    return (
        inside.union(across)
        .where(F.col("way_id") != F.col("other"))
        .select(
            F.greatest("way_id", "other").alias("hi"), F.least("way_id", "other").alias("lo")
        )
        .distinct()
    )


def _contract(links: DataFrame) -> DataFrame:
    """One round of star contraction: hook to the lowest neighbour, twice.

    Only minima per node and joins against one-row-per-node tables are used, so
    a node with very many neighbours is never gathered in one place.
    """
    lowest = links.groupBy("hi").agg(F.min("lo").alias("m"))
    jumped = (
        links.join(lowest.withColumnRenamed("hi", "lo"), "lo", "left")
        .select("hi", F.coalesce("m", "lo").alias("lo"))
        .distinct()
    )
    lowest = jumped.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = jumped.join(lowest, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    hooks = lowest.select("hi", F.col("m").alias("lo"))
    return moved.where(F.col("hi") != F.col("lo")).union(hooks).distinct()


def _written(links: DataFrame) -> tuple[DataFrame, dict]:
    """Links as written, with what tells one set of links from another, taken in the write."""
    return stage_observed(
        links, "links", n=F.count(F.lit(1)), h=F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), s=F.sum("lo")
    )


def component_labels(links: DataFrame) -> DataFrame:
    """Lowest reachable node per linked node, as (node, label); the lowest itself has no row.

    Each round is one job: it is written down and compared with the one before by figures taken
    in the write. The number of rounds grows with the logarithm of the longest chain. A round is
    written by as many tasks as its links need, so few links are not a file for each shuffle partition.
    """
    links, seen = _written(links)
    while True:
        links, now = _written(_contract(links).coalesce(max(1, -(-seen["n"] // LINKS_PER_FILE))))
        if now == seen:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        seen = now


def way_corridors(ways: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Corridor number, display name and key of every drawable way.

    Corridors are numbered from 0 by key and then by their lowest way; the most
    frequent spelling among their ways is their name, the smallest one on a tie.
    """
    keyed = stage(keyed_ways(ways), "keyed-ways")
    labels = component_labels(way_links(keyed, p))
    labelled = keyed.join(
        labels.withColumnRenamed("node", "way_id"), "way_id", "left"
    ).select("way_id", "name", "key", F.coalesce("label", "way_id").alias("label"))
    labelled = stage(labelled, "labelled-ways")

    spellings = labelled.groupBy("key", "label", "name").agg(F.count("*").alias("n"))
    corridors = spellings.groupBy("key", "label").agg(
        F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name")
    )
    numbered = dense_ids(corridors, ["key", "label"], "corridor_id", start=0)
    return labelled.select("way_id", "label").join(
        numbered.select(
            "label", "corridor_id", "name", F.array_join("key", " ").alias("key")
        ),
        "label",
    ).select("way_id", "corridor_id", "name", "key")


def road_chunks(
    ways: DataFrame, corridors: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """One row per drawable chunk with its corridor and midpoint."""
    # Ways are joined before they are cut: they are fewer than their pieces.
    drawable = ways.where(F.size("coords") >= 2).select("way_id", "coords")
    labelled = drawable.join(corridors, "way_id")
    return split_ways(labelled, ["corridor_id", "name", "key"], p).select(
        "corridor_id",
        "name",
        "key",
        *CHUNK_KEY,
        "lon0",
        "lat0",
        "lon1",
        "lat1",
        ((F.col("lon0") + F.col("lon1")) / 2).alias("mid_lon"),
        ((F.col("lat0") + F.col("lat1")) / 2).alias("mid_lat"),
    )


def build_chunks(ways: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return road_chunks(ways, way_corridors(ways, p), p)
