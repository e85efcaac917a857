"""The measured part of the road network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.operators.matching import (
    assign_corridors,
    matching_summary,
    unmatched_names,
)
from lanepulse.operators.numbering import dense_ids
from lanepulse.operators.quality import flag_sites, mappable
from lanepulse.operators.roads import build_chunks
from lanepulse.params import DEFAULTS, Params
from lanepulse.sources.roads import read_ways
from lanepulse.sources.tables import read_table, write_table
from lanepulse.staging import stage


def claimed_network(chunks: DataFrame, assigned: DataFrame) -> DataFrame:
    """Chunks of corridors that some site stands on, corridors renumbered from 0."""
    claimed = assigned.where(F.col("corridor_id").isNotNull()).select("corridor_id").distinct()
    renumbered = dense_ids(claimed, ["corridor_id"], "new_id", start=0)
    return (
        chunks.join(renumbered, "corridor_id")
        .withColumn("corridor_id", F.col("new_id"))
        .drop("new_id")
    )


def build_network(
    spark: SparkSession,
    road_paths: str | Sequence[str],
    detectors: DataFrame,
    out: str,
    p: Params = DEFAULTS,
) -> dict[str, DataFrame]:
    """Road documents to the stored `streets` table, with the matching reports.

    Only usable and located sites claim a corridor here; views match every
    located site against the result.
    """
    ways = stage(read_ways(spark, road_paths), "ways")
    chunks = stage(build_chunks(ways, p), "chunks")
    sites = stage(mappable(flag_sites(detectors, p)), "mappable")
    assigned = stage(assign_corridors(sites, chunks, p), "assigned")
    write_table(claimed_network(chunks, assigned), f"{out}/streets")
    return {
        "streets": read_table(spark, f"{out}/streets"),
        "summary": matching_summary(ways, chunks, assigned),
        "unmatched_names": unmatched_names(sites, assigned),
    }
