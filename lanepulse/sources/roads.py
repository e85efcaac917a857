"""Named road polylines from JSON response documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse.joins import small_side
from lanepulse.operators.numbering import with_offsets
from lanepulse.staging import stage

DOCUMENT = T.StructType(
    [
        T.StructField(
            "elements",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "geometry",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("lat", T.DoubleType()),
                                        T.StructField("lon", T.DoubleType()),
                                    ]
                                )
                            ),
                        ),
                        T.StructField(
                            "tags", T.StructType([T.StructField("name", T.StringType())])
                        ),
                    ]
                )
            ),
        )
    ]
)


def read_ways(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Named ways of all documents as (way_id, name, coords).

    A path is one document or a folder of them. `way_id` follows the input
    order: path, file, element. Elements without a geometry or a name are left out.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups = []
    for index, path in enumerate(paths):
        documents = (
            spark.read.schema(DOCUMENT)
            .option("multiLine", True)
            .option("recursiveFileLookup", True)
            .option("mode", "FAILFAST")
            .json(path)
        )
        kept = F.filter("elements", lambda e: (F.size(e["geometry"]) > 0) & (
            F.coalesce(F.length(e["tags"]["name"]), F.lit(0)) > 0))
        groups.append(
            documents.select(
                F.lit(index).alias("source"),
                F.col("_metadata.file_path").alias("file"),
                # A file is read by one task, so this follows the order of its documents.
                F.monotonically_increasing_id().alias("document"),
                kept.alias("kept"),
            ).select("source", "file", "document", F.posexplode("kept").alias("position", "element"))
        )
    # Positions have no gaps, so a number is the position and the ways of earlier documents:
    # coordinates are written once, and only their counts are put in order.
    ways = stage(
        reduce(DataFrame.unionByName, groups).select(
            "source", "file", "document", "position", F.col("element.tags.name").alias("name"),
            F.transform(
                "element.geometry",
                lambda point: F.struct(point["lon"].alias("lon"), point["lat"].alias("lat")),
            ).alias("coords"),
        ), "read-ways",
    )
    key = ["source", "file", "document"]
    counts = with_offsets(ways.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key).drop("n")
    return ways.join(small_side(stage(counts, "ways-before")), key).select(
        (F.col("before") + F.col("position")).alias("way_id"), "name", "coords"
    )
