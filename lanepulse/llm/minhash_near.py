"""Near duplicates by b-bit MinHash.

Sets of word shingles are reduced to minima of many hash functions. Whole minima,
three at a time, make the bands that bring candidates together; of every minimum
only the low four bits are kept, packed sixteen to a long, and the similarity of a
candidate is the share of equal parts less what chance makes equal, counted with
bit operations. Candidates are then confirmed on their full sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.joins import small_side
from lanepulse.llm.common import keyed, keyed_rows
from lanepulse.llm.linking import SIGNED, linked_components, signed, tuned_for
from lanepulse.staging import stage

# A link at 0.8 is missed by every band with probability 0.488 ** 32, under 2e-10.
BANDS, ROWS = 32, 3
# Minima beyond those of the bands make the estimate sharper.
MINIMA = 320
# Three and a half standard deviations of the estimate below 0.8: 0.024 each.
FLOOR = 0.715


def _sign(size: int):
    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield from signed(nodes, batch.column(1), size, BANDS, ROWS, MINIMA)

    return run


def near_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, size: int = 5, threshold: int = 80
) -> DataFrame:
    """(key, id, n_shingles, group_key, group_id) of every row of `docs`.

    Words are runs without ASCII white space, A-Z lowered; shingles are `size`
    words, shorter texts have one of all their words, and texts without words
    (empty, NULL, blank) none and no link. Texts with 100 * intersection >=
    threshold * union are linked; group_key is the smallest key reachable. Equal
    sets are one node, so copies make no pairs. Rows that share an id are rows of
    their own in the order of their text, and a NULL id comes first. Other columns
    are ignored, an empty table gives an empty result.
    """
    return grouped(keyed(docs, id_column, text_column), size=size, threshold=threshold)


def first_of_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, size: int = 5, threshold: int = 80
) -> DataFrame:
    """The rows of `docs`, all columns, that have the smallest key of their group."""
    rows = keyed_rows(docs, id_column, text_column)
    groups = grouped(rows.select("key", "id", "text"), size=size, threshold=threshold)
    kept = small_side(stage(groups.where("key = group_key").select("key"), "kept-keys"))
    return rows.join(kept, "key", "left_semi").select("row.*")


def grouped(rows: DataFrame, *, size: int, threshold: int) -> DataFrame:
    """near_groups() of rows that have key, id and text; a threshold under 80 is refused."""
    tuned_for(threshold)
    signs = stage(rows.select("key", "text").mapInArrow(_sign(size), SIGNED), "signatures")
    firsts = signs.where("name is not null").groupBy("name").agg(F.min("node").alias("first"))
    firsts = stage(firsts, "set-firsts")
    heads = small_side(firsts.select(F.col("first").alias("node")))
    items = signs.select("node", "n_shingles", "sig", "bands").join(heads, "node", "left_semi")
    texts = rows.select(F.col("key").alias("node"), "text")
    labels = linked_components(
        items, texts, size=size, threshold=threshold, count=MINIMA, floor=FLOOR
    )
    placed = signs.select("node", "n_shingles", "name").join(firsts, "name", "left")
    if labels is None:
        placed = placed.withColumn("label", F.col("first"))
    else:
        placed = placed.join(labels.select(F.col("node").alias("first"), "label"), "first", "left")
    placed = placed.select(
        F.col("node").alias("key"), "n_shingles", F.coalesce("label", "first", "node").alias("group_key")
    )
    ids = rows.select("key", "id")
    named = ids.select(F.col("key").alias("group_key"), F.col("id").alias("group_id"))
    return placed.join(ids, "key").join(named, "group_key").select(
        "key", "id", "n_shingles", "group_key", "group_id"
    )
