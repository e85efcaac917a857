"""Exact top-k by inner product through a pivot-distance index.

Vectors are extended by one component that makes all of one length, so that a larger
inner product is a smaller distance. Each vector is keyed by its nearest pivot and its
distance from it; the distances of a pivot are cut into annuli. A query first searches
the annuli around its own distance, which gives a score to beat; by the triangle
inequality an annulus [a, b] of a pivot at distance d holds nothing nearer than
max(a - d, d - b, 0), and the annuli that cannot beat the score are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanepulse.joins import small_side
from lanepulse.llm.hard_negatives import fitted, integers
from lanepulse.staging import stage

PIVOTS = 48
RINGS = 12
# Pivots are chosen from at most so many vectors; every vector is indexed.
SAMPLE = 2000
CELL_ROWS = 4096
QUERY_ROWS = 1024
SCALE = 256


def _finite(batches):
    """Rows whose vectors hold finite numbers only: the vector as doubles, its square as integers, its width."""
    for batch in batches:
        good, vectors = [], []
        for value in batch.column(1):
            value = value.as_py()
            vector = None if value is None or None in value else np.array(value, "<f8")
            good.append(vector is not None and bool(np.isfinite(vector).all()))
            if good[-1]:
                vectors.append(vector)
        scaled = [np.floor(SCALE * v) for v in vectors]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(pa.array(good, pa.bool_())),
             pa.array([v.tobytes() for v in vectors], pa.binary()),
             pa.array([float(v @ v) for v in scaled], pa.float64()),
             pa.array([len(v) for v in vectors], pa.int32())],
            names=["id", "vector", "square", "width"],
        )


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart start, then a few rounds of means."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(0)) ** 2).sum(1).argmax())]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen].copy()
    for _ in range(5):
        near = distances(sample, pivots).argmin(1)
        for k in range(len(pivots)):
            if (near == k).any():
                pivots[k] = sample[near == k].mean(0)
    return pivots


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _extended(vectors: np.ndarray, bound: float, query: bool) -> np.ndarray:
    last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(bound - (vectors**2).sum(1), 0))
    return np.concatenate([vectors, last[:, None]], axis=1)


def _matrix(column) -> np.ndarray:
    """Vectors as integers in doubles; rounded where components pass 2**53, so for distances only."""
    return np.floor(SCALE * _stored(column))


def _stored(column) -> np.ndarray:
    rows = [np.frombuffer(x.as_py(), "<f8") for x in column]
    return np.stack(rows) if rows else np.zeros((0, 0))


def _keyed(pivots: np.ndarray, bound: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            far = distances(_extended(_matrix(batch.column("vector")), bound, False), pivots)
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("id"), batch.column("vector"), pa.array(near.astype(np.int32)),
                 pa.array(far[np.arange(len(far)), near])],
                names=["key", "id", "vector", "pivot", "distance"],
            )

    return run


def _reach(pivots: np.ndarray, bound: float, rings: list[dict], k: int, first: bool):
    """Queries to the annuli they have to search.

    In the first pass the annuli nearest to the query, until they hold k rows besides
    the query; in the second those not searched yet whose bound reaches its score.
    """
    pivot = np.array([r["pivot"] for r in rings])
    low, high = np.array([r["low"] for r in rings]), np.array([r["high"] for r in rings])
    held = np.array([r["n"] for r in rings])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            far = distances(_extended(vectors, bound, True), pivots)[:, pivot]
            gap = np.maximum(np.maximum(low - far, far - high), 0)
            order = np.argsort(gap, axis=1, kind="stable")
            need = (np.cumsum(held[order], axis=1) < k + 1).sum(1) + 1
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(len(rings))[None, :].repeat(len(order), 0), 1)
            seen = rank < need[:, None]
            if first:
                take = seen
            else:
                square = (vectors**2).sum(1)
                # Distances and products carry rounding errors, which grow with the squares they come from.
                slack = 0.5 + 1e-9 * (square[:, None] + bound)
                best = (square[:, None] + bound - gap**2) / 2 + slack
                floor = np.array([-np.inf if x is None else x for x in batch.column("score").to_pylist()])
                take = ~seen & (best >= floor[:, None])
            row, ring = np.nonzero(take)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row)) for c in ("key", "id", "vector", "shard")),
                 pa.array(ring.astype(np.int32))], names=["query_key", "query_id", "query", "shard", "ring"],
            )

    return run


_FOUND = "query_key long, query_id long, vec_id long, score long"


def _search(k: int):
    names = ["query_key", "query_id", "vec_id", "score"]

    def run(queries: pa.Table, cell: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if queries.num_rows and cell.num_rows:
            ids = cell["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            # Exact products: doubles, 64-bit or Python integers, as the components ask for.
            rows, wanted = fitted(
                integers(cell["vector"].take(pa.array(order)).to_pylist()), integers(queries["query"].to_pylist())
            )
            scores = wanted @ rows.T
            for key, q, row in zip(queries["query_key"].to_pylist(), queries["query_id"].to_pylist(), scores):
                # Ties go to the smaller id: ids ascend and the sort is stable.
                best = np.argsort(-row, kind="stable")
                best = best[ids[best] != q][:k]
                out[0] += [key] * len(best)
                out[1] += [q] * len(best)
                out[2] += ids[best].tolist()
                out[3] += [int(x) for x in row[best]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return run


def top_k(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *, k: int = 5,
    every: int = 50, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows for each query.

    Queries are the ids divisible by `every`. Scores are inner products of the
    vectors as integers floor(256 * x), exact at any size; ties go to the smaller id, and one
    beyond 64 bits stops the job. Vectors that are NULL or hold a NULL or non-finite
    component, and rows without id, take no part. Rows that share an id are candidates and
    queries of their own, but not candidates of a query with that id. Vectors meet those of
    their own width: the most frequent width (the larger on a tie) through the index, the rest
    in plain blocks. Other columns are ignored; an empty table, or one vector, gives no rows.
    """
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    ).where("id is not null and vector is not null")
    whole = rows.mapInArrow(_finite, "id long, vector binary, square double, width int")
    whole = stage(whole.withColumn("key", F.monotonically_increasing_id()), "finite-vectors")
    widths = whole.where("width > 0").groupBy("width").agg(
        F.count(F.lit(1)).alias("n"), F.max("square").alias("square"))
    common = widths.orderBy(F.desc("n"), F.desc("width")).first()
    width = common["width"] if common else -1
    found = _in_blocks(whole.where(F.col("width") != width), k, every, cell_rows, query_rows)
    if common:
        if not common["square"] < 1e300:
            raise OverflowError("vectors are too long to be compared")
        bound = float(common["square"])
        found = found.unionByName(
            _by_index(whole.where(F.col("width") == width), bound, k, every, cell_rows, query_rows)
        )
    best_first = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _in_blocks(whole: DataFrame, k: int, every: int, cell_rows: int, query_rows: int) -> DataFrame:
    """Every query against every row of its width, in blocks of bounded size."""
    query = F.col("id") % every == 0
    sizes = stage(whole.groupBy("width").agg(
        F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts"),
        F.greatest(F.lit(1), F.ceil(F.sum(query.cast("int")) / query_rows)).cast("int").alias("shards"),
    ), "widths")
    drawn = F.xxhash64("key")

    def all_of(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    sized = whole.join(small_side(sizes), "width")
    cells = sized.select(
        "width", "id", "vector", F.pmod(drawn, F.col("parts")).cast("int").alias("part"), all_of("shards").alias("shard")
    )
    asked = sized.where(query).select(
        F.col("width").alias("width"), F.col("key").alias("query_key"), F.col("id").alias("query_id"),
        F.col("vector").alias("query"), all_of("parts").alias("part"),
        F.pmod(drawn, F.col("shards")).cast("int").alias("shard"),
    )
    keys = ["width", "part", "shard"]
    return asked.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(_search(k), _FOUND)


def _by_index(
    whole: DataFrame, bound: float, k: int, every: int, cell_rows: int, query_rows: int
) -> DataFrame:
    """The same for vectors of one width, leaving out annuli that hold nothing good enough."""
    sample = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    points = np.floor(SCALE * np.stack([np.frombuffer(r["vector"], "<f8") for r in sample]))
    pivots = choose_pivots(_extended(points, bound, False), PIVOTS)

    keyed = stage(
        whole.select("key", "id", "vector").mapInArrow(
            _keyed(pivots, bound), "key long, id long, vector binary, pivot int, distance double"
        ), "pivot-keys",
    )
    shares = [i / RINGS for i in range(1, RINGS)]
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("distance", shares, 1000).alias("cuts"))
    at = F.size(F.array_distinct(F.filter("cuts", lambda c: c < F.col("distance"))))
    ringed = stage(keyed.join(F.broadcast(cuts), "pivot").withColumn("at", at).drop("cuts"), "rings")
    query = F.col("id") % every == 0
    # PIVOTS * RINGS rows at most, whatever the number of vectors.
    found = ringed.groupBy("pivot", "at").agg(
        F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n"),
        F.sum(query.cast("int")).alias("queries"),
    ).orderBy("pivot", "at").collect()
    rings = [r.asDict() for r in found]
    cells, before = [], 0
    for i, r in enumerate(rings):
        cells.append((r["pivot"], r["at"], i, max(1, -(-r["n"] // cell_rows)), before, max(1, r["queries"])))
        before += r["queries"]
    cells = F.broadcast(whole.sparkSession.createDataFrame(
        cells, "pivot int, at int, ring int, parts int, before long, queries long"
    ))
    drawn = F.xxhash64("key")
    placed = ringed.join(cells, ["pivot", "at"])
    # Queries of neighbouring annuli search the same cells, so they are dealt out together.
    shard = F.floor((F.col("before") + F.pmod(drawn, F.col("queries"))) / query_rows).cast("int")
    asked = stage(placed.where(query).select("key", "id", "vector", shard.alias("shard")), "queries")
    members = placed.select("id", "vector", "ring", F.pmod(drawn, F.col("parts")).cast("int").alias("part"))
    parts = cells.select("ring", "parts")

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        to = queries.mapInArrow(
            _reach(pivots, bound, rings, k, first),
            "query_key long, query_id long, query binary, shard int, ring int",
        )
        to = stage(to.join(parts, "ring").select(
            "query_key", "query_id", "query", "ring", "shard",
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        ), "asked-cells")
        # A cell goes to the shards that ask for it.
        wanted = to.select(F.col("ring").alias("ring"), F.col("part").alias("part"), F.col("shard").alias("shard"))
        sent = members.join(small_side(stage(wanted.distinct(), "wanted-cells")), ["ring", "part"])
        keys = ["ring", "part", "shard"]
        return to.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_search(k), _FOUND)

    best_first = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    near = stage(searched(asked, True), "near-scores")
    floor = near.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") == k)
    floors = floor.select(F.col("query_key").alias("key"), "score")
    return near.unionByName(searched(asked.join(floors, "key", "left"), False))
