"""Resharding by minimum-cost flow: equal bytes, as few bytes moved as possible.

Documents with equal texts stay together. Groups are hashed into BLOCKS blocks, whose
sizes are the only thing the driver sees. A flow from the old shards' sizes to the new
capacities, where a byte that stays is free and a byte that moves costs one, says how
much each pair of shards exchanges; whole blocks then carry it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse.joins import is_small
from lanepulse.llm.common import keyed, keyed_rows
from lanepulse.staging import stage

SHARDS = 8
OLD_SHARDS = 5
BLOCKS = 4096
# Rows of a file of a rewritten shard, at most.
FILE_ROWS = 16_384
# A block's rows are dealt over so many tasks, as a group of copies may be large.
DEALS = 64


def min_cost_flow(supply: list[int], demand: list[int], cost) -> list[list[int]]:
    """Cheapest amounts from each source to each sink; the totals have to agree.

    Shortest augmenting paths over the residual network, found by relaxation.
    """
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, open_ = list(supply), list(demand)
    while any(left):
        far = [0 if left[i] else None for i in range(n)] + [None] * m
        via: list = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    c, a, b = cost(i, j), far[i], far[n + j]
                    if a is not None and (b is None or a + c < b):
                        far[n + j], via[n + j], changed = a + c, i, True
                    a, b = far[n + j], far[i]
                    if flow[i][j] and a is not None and (b is None or a - c < b):
                        far[i], via[i], changed = a - c, n + j, True
        ends = [j for j in range(m) if open_[j] and far[n + j] is not None]
        if not ends:
            break
        end = min(ends, key=lambda j: (far[n + j], j))
        path, at = [], n + end
        while via[at] is not None:
            path.append((via[at], at))
            at = via[at]
        amount = min(left[at], open_[end], *(flow[b][a - n] for a, b in path if a >= n))
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        open_[end] -= amount
    return flow


def capacities(sizes: list[int], shards: int) -> list[int]:
    """Equal shares of the total; a block larger than a share has a shard of its own."""
    rest, open_, own = sum(sizes), shards, []
    for size in sorted(sizes, reverse=True):
        if open_ <= 1 or size * open_ <= rest:
            break
        own.append(size)
        rest, open_ = rest - size, open_ - 1
    return own + [rest // open_ + (i < rest % open_) for i in range(open_)]


def transfers(blocks: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """New shard of each (block, old shard, bytes), following the cheapest flow."""
    if not blocks:
        return {}
    n_old = max(shards, max(old for _, old, _ in blocks) + 1)
    have = [0] * n_old
    for _, old, size in blocks:
        have[old] += size
    # Larger capacities go where more is already, so that large blocks need not move.
    largest = [max((s for _, o, s in blocks if o == j), default=0) for j in range(shards)]
    order = sorted(range(shards), key=lambda j: (-largest[j], -have[j], j))
    room = [0] * shards
    for j, size in zip(order, sorted(capacities([s for *_, s in blocks], shards), reverse=True)):
        room[j] = size
    flow = min_cost_flow(have, room, lambda i, j: int(i != j))
    need = list(room)
    out = {}
    for block, old, size in sorted(blocks, key=lambda b: (-b[2], b[0])):
        # To the shard with most of its flow from here left; else where most room is.
        best = max(range(shards), key=lambda j: (min(flow[old][j], need[j]), need[j], -j))
        if min(flow[old][best], need[best]) < size:
            best = max(range(shards), key=lambda j: (need[j], j == old, -j))
        flow[old][best] -= size
        need[best] -= size
        out[block] = best
    return out


def _block(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(BLOCKS)).cast("int")


def hashed_shard(text: Column, shards: int = OLD_SHARDS) -> Column:
    """Shard of a text where no other layout is known: equal texts together, by their hash alone."""
    return F.pmod(_block(text), F.lit(shards)).cast("int")


def reshard(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, old_shards: int = OLD_SHARDS,
    shards: int = SHARDS, old: Column | None = None,
) -> DataFrame:
    """(key, id, size, text_crc32, old_shard, shard, slot) of every row.

    Size is the text's UTF-8 bytes plus one; NULL counts as empty. Equal texts share
    a shard. `old` gives each row's shard so far (by default a hash of the text over
    `old_shards`); a block counts as being where most of its bytes are. Slots are
    gapless from 0 in each shard, by block and key. Rows that share an id are rows of
    their own, NULL ids come first; other columns are ignored; an empty table gives
    an empty result.
    """
    rows = keyed(docs, id_column, text_column)
    text = F.coalesce("text", F.lit(""))
    block = _block(F.col("text"))
    before = hashed_shard(F.col("text"), old_shards) if old is None else old
    placed = rows.select(
        "key", "id", (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), block.alias("block"),
        before.cast("int").alias("old_shard"),
        F.pmod(F.xxhash64("key"), F.lit(DEALS)).cast("int").alias("deal"),
    )
    placed = stage(placed, "sized-rows")
    sizes = placed.groupBy("block", "old_shard").agg(F.sum("size").alias("size"))
    # One row per block, BLOCKS at most.
    homes = sizes.groupBy("block").agg(
        F.max_by("old_shard", F.struct("size", -F.col("old_shard"))).alias("old"), F.sum("size").alias("size")
    ).orderBy("block").collect()
    chosen = transfers([(r["block"], r["old"], r["size"]) for r in homes], shards)
    spark = docs.sparkSession
    targets = spark.createDataFrame(sorted(chosen.items()), "block int, shard int")
    counts = placed.groupBy("block", "deal").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(targets), "block")
    earlier = Window.partitionBy("shard").orderBy("block", "deal").rowsBetween(Window.unboundedPreceding, -1)
    # BLOCKS * DEALS rows at most.
    starts = stage(counts.select(
        "block", "deal", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    ), "slot-starts")
    rank = F.row_number().over(Window.partitionBy("block", "deal").orderBy("key"))
    return placed.withColumn("rank", rank).join(F.broadcast(starts), ["block", "deal"]).select(
        "key", "id", "size", "text_crc32", "old_shard", "shard", (F.col("start") + F.col("rank") - 1).alias("slot")
    )


def _affected(plan: DataFrame) -> list[int]:
    """Shards that gain or lose rows."""
    moved = plan.where("old_shard <> shard")
    return sorted(r[0] for r in moved.select(F.explode(F.array("old_shard", "shard"))).distinct().collect())


def _write(rows: DataFrame, folder: str, mode: str) -> None:
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(
        "shard"
    ).parquet(folder)


def lay_out(
    docs: DataFrame, plan: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Write `docs` as they lie before `plan`, as folders shard=N by its old shards' default law, hashed_shard().

    Rows stay in the tasks that read them. Rows of shards that the plan leaves alone have their slots
    from the start, others have none until rewrite().
    """
    rows = keyed_rows(docs.drop("shard", "slot"), id_column, text_column)
    affected = _affected(plan)
    lasting = plan.where(~F.col("shard").isin(affected)).select("key", "slot")
    if lasting.isEmpty():
        rows = rows.withColumn("slot", F.lit(None).cast("bigint"))
    else:
        rows = rows.join(lasting, "key", "left")
    _write(rows.select("row.*", "slot", hashed_shard(F.col("text")).alias("shard")), folder, "errorifexists")


def rewrite(
    docs: DataFrame, plan: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text"
) -> list[int]:
    """Write the shards that gain or lose rows as folders shard=N; returns their numbers.

    Shards that keep exactly their rows are not touched, and the folder of a shard that
    ends without rows is removed. `plan` is reshard()'s result for `docs`, by the same
    columns; rows meet it by their unique key, so NULL and repeated ids are kept. All
    columns of `docs` are written, but for clashing ones called shard or slot.
    """
    touched = _affected(plan)
    new = stage(plan.where(F.col("shard").isin(touched)).select("key", "shard", "slot"), "moves")
    filled = {r[0] for r in new.select("shard").distinct().collect()}
    rows = keyed_rows(docs.drop("shard", "slot"), id_column, text_column).select("key", "row")
    if is_small(new):
        placed = rows.join(F.broadcast(new), "key").repartition("shard", F.floor(F.col("slot") / FILE_ROWS))
    else:
        # The join deals the rows already; texts are not shuffled again.
        placed = rows.join(new, "key")
    _write(placed.select("row.*", "shard", "slot").sortWithinPartitions("shard", "slot"), folder, "overwrite")
    spark = docs.sparkSession
    for shard in touched:
        if shard not in filled:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={shard}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return touched


def resharded(
    docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", *, shards: int = SHARDS
) -> DataFrame:
    """All rows of `docs` as read from the shards under `folder`: its columns, slot and shard.

    They are laid out by hashed_shard() and then the affected shards are rewritten by reshard()'s plan.
    """
    plan = stage(reshard(docs, id_column, text_column, shards=shards), "reshard-plan")
    lay_out(docs, plan, folder, id_column, text_column)
    rewrite(docs, plan, folder, id_column, text_column)
    fields = [*docs.drop("shard", "slot").schema, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())]
    return docs.sparkSession.read.schema(T.StructType(fields)).parquet(folder)
