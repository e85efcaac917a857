"""Readings and roads derived from the sample `events` table.

Stands in for the raw feed in tests, checks and benchmarks. The constants make
every quality rule fire on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.operators.numbering import dense_ids

PLACEHOLDER = (-3489 / 100, -5622 / 100)


def feed_from_events(events: DataFrame) -> DataFrame:
    """Raw readings under their canonical names."""
    event, user = F.col("event_id"), F.col("user_id")
    point = F.floor(user / 2).cast("int")
    hour = F.hour("ts")

    def street(offset: int):
        return F.concat(F.lit("Street "), ((point + offset) % 12).cast("string"))

    speed = (
        F.when(event % 13 == 0, F.lit(None).cast("bigint"))
        .when(event % 401 == 0, 300)
        .when(point % 20 == 3, event % 2)
        .when((user % 9 == 4) & (event % 2 == 1), 0)
        .when(event % 11 == 0, 0)
        .when((point % 20 == 5) & hour.between(7, 21), 1 + event % 2)
        .when(point % 20 == 8, 4 + event % 5)
        .otherwise(F.floor("value") % 60 + 1)
    )
    misplaced = point % 10 == 7
    lat = F.when(event % 97 == 0, F.lit(None).cast("double")).otherwise(
        F.when(misplaced, F.lit(PLACEHOLDER[0])).otherwise(
            (F.lit(-3492) + point % 13).cast("double") / F.lit(100.0)
        )
    )
    lon = F.when(misplaced, F.lit(PLACEHOLDER[1])).otherwise(
        (F.lit(-5628) + point % 24).cast("double") / F.lit(100.0)
    )
    return events.select(
        user.alias("detector_id"),
        (event % 2 + 1).cast("int").alias("lane"),
        F.to_date("ts").alias("date"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        street(0).alias("street"),
        street(1).alias("from_street"),
        street(2).alias("to_street"),
        lat.alias("lat"),
        lon.alias("lon"),
        speed.cast("double").alias("speed"),
    )


def read_sample_feed(spark: SparkSession, folder: str) -> DataFrame:
    return feed_from_events(spark.read.parquet(f"{folder}/events.parquet"))


def ways_from_sites(sites: DataFrame) -> DataFrame:
    """Road polylines through the located sites, as (way_id, name, coords)."""
    placed = sites.where(
        (F.col("lat") != PLACEHOLDER[0]) | (F.col("lon") != PLACEHOLDER[1])
    )
    spots = dense_ids(
        placed.select("lat", "lon", "street", "from_street").distinct(),
        ["lat", "lon", "street", "from_street"],
        "i",
        start=0,
    )
    lat, lon, i = F.col("lat"), F.col("lon"), F.col("i")
    n = F.split_part("street", F.lit(" "), F.lit(2)).cast("int")
    d = 0.003

    def point(x, y):
        return F.struct(x.alias("lon"), y.alias("lat"))

    first = F.array(point(lon - d, lat), point(lon, lat), point(lon + d, lat + d / 2))
    second = F.array(point(lon - d, lat + 0.0003), point(lon + d, lat + d / 2 + 0.0003))
    cross = F.array(point(lon, lat - d), point(lon, lat + d))
    spelled = F.when(n % 4 == 2, F.replace("street", F.lit("Street"), F.lit("Streeet")))
    own = F.concat(
        F.when(n % 2 == 0, "Avenida ").otherwise("Av. "), spelled.otherwise(F.col("street"))
    )
    has_own = i % 9 != 5

    def way(kind: int, name, coords, present):
        return F.struct(
            (i * 3 + kind).alias("way_id"),
            name.alias("name"),
            coords.alias("coords"),
            present.alias("present"),
        )

    return (
        spots.select(
            F.explode(
                F.array(
                    way(0, own, first, has_own),
                    way(1, own, second, has_own & (n % 3 == 0)),
                    way(
                        2,
                        F.concat(F.lit("Calle "), F.col("from_street")),
                        cross,
                        F.lit(True),
                    ),
                )
            ).alias("w")
        )
        .where("w.present")
        .select("w.way_id", "w.name", "w.coords")
    )
