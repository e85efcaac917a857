"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Candidate rows are dealt into blocks. A block sorts its rows once in each dimension.
An anchor reads these lists from the end its own component points to: downwards where
the component is positive, upwards where it is negative. Every row met in any list is
scored at once by a whole inner product (random access). After each depth the sum of
the anchor's components times the values reached is the threshold: no row not met yet
can score more. Reading stops once the threshold falls strictly below the last place asked for;
strictly, as a row with an equal score may win its tie.

The first pass finds each anchor's positives in the blocks of its label. Their scores
make the windows of the second pass, over blocks of all rows: a window's best rows of
other labels are complete when the threshold is strictly below its last place, or below
the window. Blocks give at most the places asked for, which are ranked over all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.joins import small_side
from lanepulse.staging import stage

SCALE = 256
BLOCK_ROWS = 16384
ANCHOR_ROWS = 16384
FIRST_DEPTH = 16


def _finite(batches):
    """Rows whose vectors hold numbers only, as bytes of doubles, with their width."""
    for batch in batches:
        good, vectors = [], []
        for value in batch.column("vector"):
            value = value.as_py()
            vector = None if value is None or None in value else np.array(value, "<f8")
            good.append(vector is not None and bool(np.isfinite(vector).all()))
            if good[-1]:
                vectors.append(vector)
        rows = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), rows.column("label"), pa.array([v.tobytes() for v in vectors], pa.binary()),
             pa.array([len(v) for v in vectors], pa.int32())],
            names=["id", "label", "vector", "width"],
        )


def integers(vectors: list[bytes]) -> np.ndarray:
    """floor(SCALE * x) as exact numbers: doubles, or Python integers where scaling would overflow."""
    x = np.stack([np.frombuffer(v, "<f8") for v in vectors]) if vectors else np.zeros((0, 0))
    if x.size and np.abs(x).max() > 1e300:
        # Doubles of this size are whole numbers.
        return np.array(
            [[int(v) * SCALE if abs(v) > 2**60 else int(np.floor(SCALE * v)) for v in row] for row in x], object
        ).reshape(x.shape)
    return np.floor(SCALE * x)


def fitted(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type in which inner products of their rows are exact."""
    if any(a.dtype == object for a in arrays):
        return [_whole(a) for a in arrays]
    bound = max(1, arrays[0].shape[1])
    for a in arrays:
        bound *= int(np.abs(a).max()) if a.size else 1
    if bound < 2**53:
        return list(arrays)
    # Each component is below the bound, as all others are whole and not all zero.
    return [a.astype(np.int64) for a in arrays] if bound < 2**63 else [_whole(a) for a in arrays]


def _whole(a: np.ndarray) -> np.ndarray:
    if a.dtype == object:
        return a
    return np.array([[int(v) for v in row] for row in a], object).reshape(a.shape)


class SortedLists:
    """A block of rows with one sorted list per dimension."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable").T

    def scan(self, anchor: np.ndarray):
        """(row numbers met, their scores, threshold) at growing depths; no threshold when all are met."""
        n = len(self.rows)
        used = np.flatnonzero(anchor)
        weights, falls = anchor[used], anchor[used] > 0
        met = np.zeros(n, bool)
        low, depth = 0, FIRST_DEPTH
        while len(used) and depth < n:
            at = np.arange(low, depth)
            places = np.where(falls[:, None], n - 1 - at, at)
            rows = self.order[used[:, None], places]
            threshold = (weights * self.rows[rows[:, -1], used]).sum()
            rows = rows.ravel()
            rows = np.unique(rows[~met[rows]])
            met[rows] = True
            yield rows, self.rows[rows] @ anchor, threshold
            if met.all():
                return
            low, depth = depth, depth * 2
        rows = np.flatnonzero(~met)
        yield rows, self.rows[rows] @ anchor, None


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, ties by id."""
    if len(scores) > 4 * k and scores.dtype != object:
        # Everything that ties with the k-th place stays in until ids decide.
        last = np.partition(scores, len(scores) - k)[len(scores) - k]
        held = np.flatnonzero(scores >= last)
        return held[np.lexsort((ids[held], -scores[held]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def best_in_windows(lists: SortedLists, anchor, ids, allowed, windows, k: int):
    """For each window (low, high) the places and scores of its k first allowed rows.

    A window without bounds is (None, None). `ids` break ties.
    """
    places, scores = np.zeros(0, np.int64), np.zeros(0, lists.rows.dtype)
    for rows, found, threshold in lists.scan(anchor):
        keep = allowed[rows]
        places, scores = np.concatenate([places, rows[keep]]), np.concatenate([scores, found[keep]])
        if threshold is None or all(_complete(scores, threshold, w, k) for w in windows):
            break
    out = []
    for window in windows:
        inside = np.flatnonzero(_inside(scores, window))
        first = inside[_first(scores[inside], ids[places[inside]], k)]
        out.append((places[first], scores[first]))
    return out


def _inside(scores, window):
    low, high = window
    return np.ones(len(scores), bool) if low is None else ((scores >= low) & (scores <= high)).astype(bool)


def _complete(scores, threshold, window, k: int) -> bool:
    if window[0] is not None and threshold < window[0]:
        return True
    return int((_inside(scores, window) & (scores > threshold)).sum()) >= k


def _block(table: pa.Table):
    return (table["key"].to_numpy(), table["id"].to_numpy(), np.array(table["label"].to_pylist(), object),
            integers(table["vector"].to_pylist()))


def _long(values) -> pa.Array:
    """Scores as 64-bit numbers; one that does not fit stops the job."""
    return pa.array([int(v) for v in values], pa.int64())


def _positives(k: int):
    names = ["anchor_key", "anchor_id", "positive_id", "score"]

    def run(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if anchors.num_rows and block.num_rows:
            _, ids, _, rows = _block(block)
            keys, asked, _, wanted = _block(anchors)
            rows, wanted = fitted(rows, wanted)
            lists = SortedLists(rows)
            for key, anchor_id, anchor in zip(keys, asked, wanted):
                (places, scores), = best_in_windows(lists, anchor, ids, ids != anchor_id, [(None, None)], k)
                out[0] += [key] * len(places)
                out[1] += [anchor_id] * len(places)
                out[2] += ids[places].tolist()
                out[3] += scores.tolist()
        return pa.Table.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], _long(out[3])], names=names)

    return run


def _negatives(k: int, low: int, high: int):
    names = ["anchor_key", "anchor_id", "place", "positive_id", "negative_id", "positive_score", "negative_score"]

    def run(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if anchors.num_rows and block.num_rows:
            _, ids, labels, rows = _block(block)
            keys, asked, own, wanted = _block(anchors)
            rows, wanted = fitted(rows, wanted)
            lists = SortedLists(rows)
            for key, anchor_id, label, anchor, positives in zip(
                keys, asked, own, wanted, anchors["positives"].to_pylist()
            ):
                # low * p <= 100 * n <= high * p, in whole numbers.
                windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
                open_ = [i for i, w in enumerate(windows) if w[0] <= w[1]]
                best = best_in_windows(lists, anchor, ids, labels != label, [windows[i] for i in open_], k)
                for i, (places, scores) in zip(open_, best):
                    n, p = len(places), positives[i]
                    columns = ([key] * n, [anchor_id] * n, [p["place"]] * n, [p["positive_id"]] * n,
                               ids[places].tolist(), [p["score"]] * n, scores.tolist())
                    for column, values in zip(out, columns):
                        column += values
        return pa.Table.from_arrays(
            [*[pa.array(c, pa.int64()) for c in out[:6]], _long(out[6])], names=names
        )

    return run


def mine(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    *, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    Anchors are the rows whose id is divisible by `every`. Scores are inner products of the
    vectors as whole numbers floor(256 * x). An anchor's positives are the first rows
    of its label, its negatives for a positive the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score; higher scores
    come first, ties by the smaller id.

    Rows with a NULL id, label or vector, or a NULL or non-finite component, take
    no part. Rows are compared with rows of the same width; an empty vector scores 0
    with another. Rows that share an id are rows of their own, but not
    candidates of an anchor with that id. A score beyond 64 bits stops the job. An empty
    table, anchors without positives and windows without rows give nothing. Other columns
    are ignored.
    """
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    ).where("id is not null and label is not null and vector is not null")
    whole = rows.mapInArrow(_finite, "id long, label string, vector binary, width int")
    whole = stage(whole.withColumn("key", F.monotonically_increasing_id()), "whole-vectors")
    columns = ["key", "id", "label", "vector"]

    def renewed(df: DataFrame) -> DataFrame:
        # Columns of their own, told apart from the blocks they meet.
        return df.select(*[F.col(c).alias(c) for c in df.columns])

    anchors = renewed(whole.where(F.col("id") % every == 0))

    def part(count, share=block_rows):
        return F.pmod(F.xxhash64("key"), F.ceil(count / share)).cast("int")

    # Labels of more rows than a block, at most one for each block of the table.
    n = F.count(F.lit(1)).alias("n")
    crowded = stage(whole.groupBy("width", "label").agg(n).where(F.col("n") > block_rows), "crowded-labels")
    crowded = small_side(crowded)
    sized = whole.join(crowded, ["width", "label"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    shards = stage(anchors.groupBy("width", "label").agg(n).where(F.col("n") > anchor_rows), "crowded-anchors")
    shards = small_side(shards.withColumnRenamed("n", "n_anchors"))
    sized = sized.join(shards, ["width", "label"], "left").withColumn("n_anchors", F.coalesce("n_anchors", F.lit(1)))

    def every_part(count, share):
        return F.explode(F.sequence(F.lit(0), (F.ceil(count / share) - 1).cast("int")))

    keys = ["width", "home", "part", "shard"]
    blocks = sized.select(
        "width", F.col("label").alias("home"), *columns, part(F.col("n")).alias("part"),
        every_part(F.col("n_anchors"), anchor_rows).alias("shard"),
    )
    asked = renewed(sized.where(F.col("id") % every == 0)).select(
        "width", F.col("label").alias("home"), *columns, every_part(F.col("n"), block_rows).alias("part"),
        part(F.col("n_anchors"), anchor_rows).alias("shard"),
    )
    near = asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(
        _positives(positives), "anchor_key long, anchor_id long, positive_id long, score long"
    )
    order = Window.partitionBy("anchor_key").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    windows = stage(
        near.groupBy(F.col("anchor_key").alias("key")).agg(
            F.collect_list(F.struct("place", "positive_id", "score")).alias("positives")
        ), "windows",
    )

    # One row per width of vectors.
    totals = whole.groupBy("width").agg(n, F.sum(F.when(F.col("id") % every == 0, 1)).alias("n_anchors"))
    totals = small_side(stage(totals.na.fill(1, ["n_anchors"]), "widths"))
    keys = ["width", "part", "shard"]
    blocks = whole.join(totals, "width").select(
        "width", *columns, part(F.col("n")).alias("part"), every_part(F.col("n_anchors"), anchor_rows).alias("shard")
    )
    asked = anchors.join(windows, "key").join(totals, "width").select(
        "width", *columns, "positives", every_part(F.col("n"), block_rows).alias("part"),
        part(F.col("n_anchors"), anchor_rows).alias("shard"),
    )
    mined = asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(
        _negatives(negatives, low, high),
        "anchor_key long, anchor_id long, place long, positive_id long, negative_id long, "
        "positive_score long, negative_score long",
    )
    order = Window.partitionBy("anchor_key", "place").orderBy(F.desc("negative_score"), "negative_id")
    return mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


MINE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score,
       s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
