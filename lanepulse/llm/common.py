"""Steps that several operators share: row keys, sizes, deals over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.operators.numbering import dense_ids


def keyed(rows: DataFrame, id_column: str, text_column: str, bits: int | None = None) -> DataFrame:
    """(key, id, text) of every row; `key` is unique and follows the order of ids.

    The id itself is the key where ids are whole: not NULL and not repeated.
    Otherwise rows are numbered by id, NULL first, and then by text, so that
    rows which share an id are documents of their own. With `bits`, keys that need more
    than so many bits are renumbered as well.
    """
    plain = rows.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")
    )
    ids = plain.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"),
        F.min("id").alias("low"), F.max("id").alias("high"),
    ).first()
    fits = bits is None or not ids["d"] or (ids["low"] >= 0 and ids["high"] < 2**bits)
    if ids["n"] == ids["d"] and fits:
        return plain.select(F.col("id").alias("key"), "id", "text")
    order = plain.withColumn("has_id", F.col("id").isNotNull())
    return dense_ids(order, ["has_id", "id", "text"], "key", start=0).select("key", "id", "text")


def keyed_rows(docs: DataFrame, id_column: str, text_column: str, bits: int | None = None) -> DataFrame:
    """keyed() with the whole row beside it as the struct `row`."""
    # Within a struct NULL sorts first, in keyed() last.
    text = F.col(text_column)
    body = F.struct(text.isNull().alias("none"), text.alias("text"), F.struct("*").alias("row"))
    rows = keyed(docs.select(F.col(id_column), body.alias("body")), id_column, "body", bits)
    return rows.select("key", "id", F.col("text.text").alias("body"), "text.row").withColumnRenamed("body", "text")


def text_bytes(rows: DataFrame, column: str = "text") -> int:
    return rows.agg(F.sum(F.octet_length(F.col(column)).cast("bigint")).alias("b")).first()["b"] or 0


def n_parts(total: int, each: int) -> int:
    """Parts of about `each`; odd, so that keys with a common step spread as well."""
    return max(1, -(-total // each)) | 1


def dealt(key: Column, n: int) -> Column:
    """Part of an integer key; numpy repeats it as deal()."""
    return F.pmod(key.bitwiseXOR(F.shiftrightunsigned(key, 13)), F.lit(n)).cast("int")


def deal(keys, n: int):
    mixed = keys ^ (keys.view("u8") >> 13).view("i8")
    return (mixed % n).astype("i4")

