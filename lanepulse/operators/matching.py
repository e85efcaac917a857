"""Which corridor a site stands on: near roads first, then the name decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.functions.geo import grid_cell, neighbour_cells, segment_distance, x_km, y_km
from lanepulse.functions.names import may_be_similar, name_key, token_similarity
from lanepulse.joins import cell_join, small_side
from lanepulse.params import DEFAULTS, Params
from lanepulse.staging import stage

# Cells are a hair wider than the radius, so that rounding cannot put a point at
# exactly the radius two cells away.
CELL_MARGIN = 1.0 + 1e-9


def near_corridors(sites: DataFrame, chunks: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Nearest approach of every corridor within the snap radius, per position.

    Both sides meet in cells as wide as the radius: a chunk lies in the cells its
    box touches, a position asks the 3 x 3 block around it. Sites that share a
    position are looked up once, and so are chunks with the same ends.
    """
    snap = p.snap_m / 1000.0
    width = snap * CELL_MARGIN

    def cells_between(a: str, b: str):
        return F.sequence(
            grid_cell(F.least(a, b), width), grid_cell(F.greatest(a, b), width)
        )

    spread = (
        chunks.select(
            "corridor_id",
            "name",
            x_km(F.col("lon0"), p).alias("ax"),
            y_km(F.col("lat0"), p).alias("ay"),
            x_km(F.col("lon1"), p).alias("bx"),
            y_km(F.col("lat1"), p).alias("by"),
        )
        .withColumn("cx", F.explode(cells_between("ax", "bx")))
        .withColumn("cy", F.explode(cells_between("ay", "by")))
    )
    asking = stage(
        sites.select("lat", "lon")
        .distinct()
        .withColumns({"px": x_km(F.col("lon"), p), "py": y_km(F.col("lat"), p)})
        .withColumns(
            {"sx": grid_cell(F.col("px"), width), "sy": grid_cell(F.col("py"), width)}
        )
        .withColumn("c", F.explode(neighbour_cells("sx", "sy")))
        .select("lat", "lon", "px", "py", "c.cx", "c.cy"),
        "positions",
    )
    ends = [F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")]
    return (
        cell_join(spread, asking, ["cx", "cy"])
        .withColumn("distance", segment_distance(*ends))
        .where(F.col("distance") <= snap)
        .groupBy("lat", "lon", "corridor_id", "name")
        .agg(F.min("distance").alias("distance"))
    )


def name_scores(pairs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Score of each distinct (street, name) pair, 0 to 1.

    A token of the sensor's street counts 1.0 if the road has it, 0.7 as an
    initial and 0.9 as a near miss of a long token; the score is their mean.
    Tokens are scored in tenths, so that equal scores compare equal.
    """
    distinct = pairs.select("street", "name").distinct()
    keyed = stage(
        distinct.withColumns(
            {"wanted": name_key(F.col("street")), "offered": name_key(F.col("name"))}
        ),
        "name-pairs",
    )
    # An empty key on either side scores 0 and has no token row.
    wanted = keyed.select(
        "street", "name", "offered", F.posexplode("wanted").alias("pos", "token")
    ).withColumn(
        "tenths",
        F.when(F.array_contains("offered", F.col("token")), 10)
        .when(
            (F.length("token") == 1)
            & F.exists("offered", lambda other: other.startswith(F.col("token"))),
            7,
        )
        .otherwise(0),
    )
    open_ = (
        wanted.where(
            (F.col("tenths") == 0) & (F.length("token") >= p.similar_token_length)
        )
        .select("street", "name", "pos", "token", F.explode("offered").alias("other"))
        .where(may_be_similar(F.col("token"), F.col("other"), p.similar_token_floor))
    )
    # Python sees each distinct token pair once.
    alike = (
        open_.select("token", "other")
        .distinct()
        .where(token_similarity(F.col("token"), F.col("other")) >= p.similar_token_floor)
    )
    near = open_.join(alike, ["token", "other"], "left_semi").select(
        "street", "name", "pos"
    ).distinct().withColumn("near", F.lit(9))
    summed = (
        wanted.select("street", "name", "pos", "tenths")
        .join(near, ["street", "name", "pos"], "left")
        .groupBy("street", "name")
        .agg(
            (
                F.sum(F.coalesce("near", "tenths")) / (F.count(F.lit(1)) * 10)
            ).alias("score")
        )
    )
    return keyed.select("street", "name").join(summed, ["street", "name"], "left").select(
        "street", "name", F.coalesce("score", F.lit(0.0)).alias("score")
    )


SPOT = ["lat", "lon", "street"]


def corridor_candidates(
    spots: DataFrame, chunks: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Corridors within the snap radius of each (position, street), with their scores."""
    # Read twice, for the names and for the distances; the spatial join runs once.
    near = stage(near_corridors(spots, chunks, p), "near-corridors")
    pairs = spots.select(*SPOT).join(near, ["lat", "lon"])
    return pairs.join(name_scores(pairs, p), ["street", "name"]).select(
        *SPOT, "corridor_id", "name", "distance", "score"
    )


def assign_corridors(
    sites: DataFrame, chunks: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """(site_id, corridor_id) for every given site; NULL where no name is close enough.

    The best score wins, then the smaller distance, then the lower corridor. The
    choice depends on position and street alone, so it is made once for all
    sites that share them.
    """
    rank = F.struct(-F.col("score"), F.col("distance"), F.col("corridor_id"))
    best = (
        corridor_candidates(sites.select(*SPOT).distinct(), chunks, p)
        .where(F.col("score") >= p.name_floor)
        .groupBy(*SPOT)
        .agg(F.min_by("corridor_id", rank).alias("corridor_id"))
    )
    best = small_side(stage(best, "best-corridors"))
    # With several periods a site comes once for each.
    return sites.select("site_id", *SPOT).distinct().join(best, SPOT, "left").select(
        "site_id", "corridor_id"
    )


def unmatched_names(sites: DataFrame, assigned: DataFrame) -> DataFrame:
    """Street names of sites without a corridor, most frequent first."""
    lost = assigned.where(F.col("corridor_id").isNull()).select("site_id")
    return (
        sites.join(lost, "site_id", "left_semi")
        .groupBy("street")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "street")
    )


def unmatched_in_slice(slice_: DataFrame, assigned: DataFrame) -> DataFrame:
    return with_corridor(slice_, assigned).agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.count_if(F.col("corridor_id").isNull()).alias("n_unmatched"),
    )


def with_corridor(slice_: DataFrame, assigned: DataFrame) -> DataFrame:
    return slice_.join(assigned, "site_id", "left")


def matching_summary(ways: DataFrame, chunks: DataFrame, assigned: DataFrame) -> DataFrame:
    """Network and matching totals, in one row."""
    roads = chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_distinct("corridor_id").alias("n_corridors"),
    )
    n_ways = ways.agg(F.count(F.lit(1)).alias("n"))
    return assigned.agg(
        F.count("corridor_id").alias("n_matched"),
        F.count(F.lit(1)).alias("n_mappable"),
        F.count_distinct("corridor_id").alias("n_claimed"),
    ).select(
        n_ways.scalar().alias("n_ways"),
        roads.select("n_chunks").scalar().alias("n_chunks"),
        roads.select("n_corridors").scalar().alias("n_corridors"),
        "n_matched",
        "n_mappable",
        "n_claimed",
    )
