"""Headline timings on one node; prints a single JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
threads. Every figure is wall-clock for a full result. `etl_csv` starts from CSV
files with the month-sized row count the published figure refers to; they are
derived from `events` before the clock starts, and a load of a few rows warms
the session up.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.plans import registry
from lanepulse.plans.ingest import build_tables
from lanepulse.session import build_session
from lanepulse.sources.sample_feed import feed_from_events
from lanepulse.sources.readings import write_readings_csv

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ETL_ROWS = int(os.environ.get("BENCH_ETL_ROWS", "3100000"))

# Raw readings to stored tables comes first; what follows reads those tables.
QUERIES = [
    "reading_classes",
    "measurements",
    "detectors",
    "site_flags",
    "city_profile",
    "street_profile",
    "slice_weekday_1730",
    "slice_every_bucket",
    "slowest_12",
    "surface_cells",
    "surface_every_bucket",
    "corridors",
    "road_chunks",
    "site_corridor",
    "field_blend",
    "field_nearest",
    "field_stub",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def month_of_csv(spark: SparkSession, path: str, rows: int) -> int:
    """The sample feed repeated on later days until it has the wanted rows."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    copies = -(-rows // events.count())
    later = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    shifted = later.withColumns(
        {
            "ts": F.expr("ts + make_dt_interval(copy)"),
            "event_id": F.col("event_id") + F.col("copy") * 1_000_003,
        }
    )
    write_readings_csv(feed_from_events(shifted.repartition(int(CPUS))), path)
    return events.count() * copies


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="lanepulse-bench-") as scratch:
        measure(scratch)


def measure(scratch: str) -> None:
    spark = build_session(
        "lanepulse-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": f"{scratch}/checkpoints",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    seconds = {}
    csv_rows = month_of_csv(spark, f"{scratch}/csv", ETL_ROWS)
    month_of_csv(spark, f"{scratch}/few", 1)
    build_tables(spark, f"{scratch}/few", f"{scratch}/few-tables")
    seconds["etl_csv"] = timed(
        lambda: build_tables(spark, f"{scratch}/csv", f"{scratch}/tables")
    )
    known = registry.queries()
    for name in QUERIES:
        seconds[name] = timed(lambda: run(known[name](spark, FOLDER)))
    spark.stop()

    line = {
        "metric": "lanepulse_headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "etl_csv_rows": csv_rows,
        "etl_csv_rows_per_sec": round(csv_rows / seconds["etl_csv"]),
        # 48 half hours times 3 day scopes in one job.
        "surface_ms_each": round(seconds["surface_every_bucket"] / 144 * 1000, 1),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
