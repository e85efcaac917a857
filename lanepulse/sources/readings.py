"""Raw lane readings from CSV."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the feed, with the spellings seen in the wild.
ALIASES = {
    "detector": ("cod_detector", "id_detector"),
    "speed": ("velocidad", "velocidad_promedio"),
}
# Canonical column to the first accepted spelling.
FEED_NAMES = {
    "detector_id": "cod_detector",
    "lane": "id_carril",
    "date": "fecha",
    "time": "hora",
    "street": "dsc_avenida",
    "from_street": "dsc_int_anterior",
    "to_street": "dsc_int_siguiente",
    "lat": "latitud",
    "lon": "longitud",
    "speed": "velocidad",
}
TEXTS = ("dsc_avenida", "dsc_int_anterior", "dsc_int_siguiente")
# Columns that are not text, with their types.
NUMBERS = {
    "cod_detector": "bigint", "id_detector": "bigint", "id_carril": "int", "latitud": "double",
    "longitud": "double", "velocidad": "double", "velocidad_promedio": "double",
}
DATES = ("fecha",)
# Headers are read by so many connections at a time.
PROBES = 16


def _csv(spark: SparkSession, sep: str) -> DataFrameReader:
    """Quotes inside quotes are doubled; blanks stay, as a blank text is not a missing one."""
    return spark.read.option("header", True).option("sep", sep).option("escape", '"')


def header_columns(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from the header line; no data is read."""
    return [c.strip() for c in _csv(spark, sep).csv(path).columns]


def files_by_header(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, list[str]]:
    """The files under `paths`, globs and folders included, by their header line.

    Spark lists the files as it would for reading them. Of each, the first line is fetched,
    packed or not; the driver holds names and headers only. Files without a line are left out.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop, java = jvm.org.apache.hadoop, jvm.java
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)

    def probe(uri: str) -> tuple[str | None, str]:
        path = hadoop.fs.Path(java.net.URI(uri))
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            unpacked = codec.createInputStream(stream) if codec is not None else stream
            line = java.io.BufferedReader(java.io.InputStreamReader(unpacked, "UTF-8")).readLine()
        finally:
            stream.close()
        return line, path.toString()

    found: dict[str, list[str]] = {}
    with ThreadPoolExecutor(PROBES) as pool:
        for line, path in pool.map(probe, sorted(spark.read.text(paths).inputFiles())):
            if line is not None:
                found.setdefault(line.removeprefix("\ufeff").strip(), []).append(path)
    return found


def pick_alias(columns: Sequence[str], role: str) -> str:
    """First accepted spelling of a column that the file has."""
    found = [name for name in ALIASES[role] if name in columns]
    if not found:
        raise ValueError(
            f"no {role} column: looked for {', '.join(ALIASES[role])} "
            f"among {', '.join(sorted(columns))}"
        )
    return found[0]


def _proper(name: str, date_format: str) -> Column:
    """The value of a column that is not a name; one that cannot be read stops the job.

    A silent NULL would count as a missing reading.
    """
    text = F.nullif(F.trim(F.col(name)), F.lit(""))
    kind = "date" if name in DATES else NUMBERS.get(name, "string")
    value = F.try_to_date(text, date_format) if kind == "date" else text.try_cast(kind)
    odd = F.raise_error(F.concat(F.lit(f"malformed {name}: "), text))
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(odd.cast(kind))


def _read_alike(spark: SparkSession, files: list[str], sep: str, date_format: str) -> DataFrame:
    """Files with one header."""
    columns = _csv(spark, sep).csv(files[0]).columns
    names = [c.strip() for c in columns]
    detector, speed = pick_alias(names, "detector"), pick_alias(names, "speed")
    raw = (
        _csv(spark, sep)
        .schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        .option("enforceSchema", False)
        # A row of another length stops the job.
        .option("mode", "FAILFAST")
        .csv(files)
        .toDF(*names)
    )
    found = {**FEED_NAMES, "detector_id": detector, "speed": speed}
    # A quoted nothing is as empty as an unquoted one; a blank is a text of its own.
    return raw.select(*[
        (F.nullif(F.col(c), F.lit("")) if c in TEXTS else _proper(c, date_format)).alias(n)
        for n, c in found.items()
    ])


def read_readings(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    sep: str = ",",
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Readings under their canonical names from all files under `paths`.

    Files may spell and order their columns each in its own way, also under one folder or
    glob: those with equal headers are read together, so a year of months is a few reads.
    """
    groups = files_by_header(spark, paths)
    if not groups:
        raise ValueError(f"no file with a header under {paths}")
    return reduce(DataFrame.unionByName, [_read_alike(spark, f, sep, date_format) for f in groups.values()])


def write_readings_csv(
    readings: DataFrame, path: str, spelling: dict[str, str] | None = None
) -> None:
    """Canonical readings as headed CSV, in the order of their columns; `spelling` overrides feed names."""
    names = {**FEED_NAMES, **(spelling or {})}
    readings.select(*[F.col(c).alias(names[c]) for c in readings.columns if c in names]).write.mode(
        "overwrite"
    ).option("header", True).option("escape", '"').csv(path)
