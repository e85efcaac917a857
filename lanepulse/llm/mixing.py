"""Mixing sources to target weights by Poisson replication.

A source's rate is its share of the target over its share of the rows. Each document
inverts a Poisson distribution with that mean at a number hashed from its id, is
repeated so often, and all copies are shuffled by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.joins import small_side
from lanepulse.staging import stage

# Target weights follow the number of rows to this power where none are given.
POWER = 0.5
# A larger rate is a sum of equal Poisson parts of at most this mean.
PART = 16.0
# Terms of a part's distribution; past them lies less than 1e-15.
TERMS = 80
SEED = "mix"


def hashed(*parts: Column) -> Column:
    """A 52-bit number from a digest of the parts as text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint")


def source_rates(docs: DataFrame, source_column: str = "source", weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n, rate): rows and mean repetitions; NULL counts as the empty name."""
    counts = docs.groupBy(F.coalesce(F.col(source_column), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(POWER)))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighed = counts.join(given, "source", "left").fillna(0.0, ["weight"])
    total = weighed.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights"))
    return weighed.crossJoin(F.broadcast(total)).select(
        "source", "n", F.round(F.col("weight") / F.col("weights") * F.col("rows") / F.col("n"), 9).alias("rate")
    )


def mix(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source",
    weights: dict[str, float] | None = None, *, seed: str = SEED,
) -> DataFrame:
    """All columns of `docs`, repeated by source rate and shuffled, and rate, n_copies, copy, shuffle_key.

    A document of rate r is repeated Poisson(r) times, so it may go; copies count from
    1. Rows that share an id are repeated equally; NULL ids count as one id. Sources
    without a given weight go. A clashing column of `docs` is replaced; an empty
    table gives an empty result.
    """
    rates = stage(source_rates(docs, source_column, weights), "rates")
    part = F.col("rate") / F.col("parts")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.array(F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("c"))),
        lambda done, k: F.concat(done, F.array(F.struct(
            (F.element_at(done, -1)["p"] * part / k).alias("p"),
            (F.element_at(done, -1)["c"] + F.element_at(done, -1)["p"] * part / k).alias("c"),
        ))),
    )
    table = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).select(
        F.col("source").alias("mix_source"), "rate", F.col("parts").alias("mix_parts"),
        F.transform(steps, lambda s: s["c"]).alias("mix_below"),
    )
    table = small_side(stage(table, "distributions"))
    name = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    kept = docs.drop("rate", "n_copies", "copy", "shuffle_key")
    own = F.coalesce(F.col(source_column), F.lit(""))
    joined = kept.join(table, own == F.col("mix_source"))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("mix_parts")), F.lit(0),
        lambda done, j: done + F.size(F.filter(
            "mix_below",
            lambda c: c <= (hashed(name, j.cast("string"), F.lit(seed)) + 0.5) / F.lit(float(2**52)),
        )),
    )
    counted = joined.withColumn("n_copies", copies).where("n_copies > 0")
    repeated = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = repeated.withColumn(
        "shuffle_key", hashed(name, F.col("copy").cast("string"), F.lit(seed + " order"))
    )
    shuffled = keyed.select(*kept.columns, "rate", "n_copies", "copy", "shuffle_key")
    return shuffled.repartitionByRange("shuffle_key", F.xxhash64(F.col(id_column), F.col("copy"))).sortWithinPartitions("shuffle_key")


MIX_SQL = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1
), rates AS (
  SELECT source, n,
    round(pow(n::DOUBLE, {POWER}) / sum(pow(n::DOUBLE, {POWER})) OVER () * sum(n) OVER () / n, 9) AS rate
  FROM counts
), parts AS (
  SELECT source, rate, greatest(ceil(rate / {PART}), 1)::INT AS parts FROM rates
), below(source, part, k, p, c) AS (
  SELECT source, rate / parts, 0, exp(-(rate / parts)), exp(-(rate / parts)) FROM parts
  UNION ALL
  SELECT source, part, k + 1, p * part / (k + 1), c + p * part / (k + 1) FROM below WHERE k < {TERMS}
), drawn AS (
  SELECT d.doc_id, d.source, p.source AS name, p.rate, j,
    (('0x' || substr(md5(concat_ws('|', coalesce(d.doc_id::VARCHAR, 'null'), j::VARCHAR, '{SEED}')), 1, 13))::BIGINT
      + 0.5) / {float(2**52)!r}::DOUBLE AS u
  FROM documents d JOIN parts p ON coalesce(d.source, '') = p.source, unnest(range(1, p.parts + 1)) AS t(j)
), counted AS (
  SELECT doc_id, r.source, rate, count(*)::INT AS n_copies
  FROM drawn r JOIN below b ON b.source = r.name AND b.c <= r.u GROUP BY ALL
)
SELECT doc_id, source, rate, n_copies, i::INT AS copy,
  ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), i::VARCHAR, '{SEED} order')), 1, 13))::BIGINT
    AS shuffle_key
FROM counted, unnest(range(1, n_copies + 1)) AS t(i)
"""
