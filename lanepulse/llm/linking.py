"""Near-duplicate texts as components of verified links, without listing all pairs.

Texts that share a band are candidates. Only connections matter for components, so
each round lets every text propose one partner: in each of its bands a leader is
looked up, in turn the member that shares most with others and one drawn by hash, and
the leader of the best estimate is proposed. The
proposals are checked on the full shingle sets, and bands whose members are all in
one component take no further part. When a round links little, what is left over
(same band, different components) is compared in blocks of bounded size: signatures
first, then the full sets of those that look similar, each text sent once to a block
that doubts it. So no link is lost, and pairs are never rows: a block gives at most one
link less than it has members.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.joins import small_side
from lanepulse.llm import kernels as K
from lanepulse.operators.roads import component_labels
from lanepulse.staging import stage

BITS = 4
NIBBLES = 16
# A side of a block holds about so many members, and no more than so many shingles.
PART_ROWS = 2000
PART_SHINGLES = 1 << 22
# Rounds of proposals go on while one in so many links.
PROGRESS = 5
# Floors, bands and minima of the operators are tuned for this similarity.
LEAST = 80
SIGNED = "node long, n_shingles long, name binary, sig array<long>, bands array<long>"
_SIGNED = pa.schema([("node", pa.int64()), ("n_shingles", pa.int64()), ("name", pa.binary()),
                     ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
_RNG = np.random.default_rng(77)
_MULTIPLIERS = _RNG.integers(0, 2**31, 512, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 2**32, 512, dtype=np.uint32)


def tuned_for(threshold: int) -> None:
    """Stop on a threshold whose links the floors would drop unseen."""
    if not LEAST <= threshold <= 100:
        raise ValueError(f"threshold has to be from {LEAST} to 100, not {threshold}")


def minima(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """(documents, count): smallest value of each hash function over each set."""
    folded = (values ^ (values >> np.uint64(20))).astype(np.uint32)
    out = np.empty((len(starts), count), np.uint32)
    for k in range(count):
        h = folded * _MULTIPLIERS[k] + _SHIFTS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def signed(nodes: np.ndarray, column, size: int, bands: int, rows: int, count: int):
    """Batches of SIGNED for texts; a text without words has no name, signature or bands.

    The name is a digest of the whole set, the signature keeps the low BITS bits of
    every minimum, 16 to a long, and a band is a hash of `rows` whole minima.
    """
    data, offsets = K.flat(column)
    for lo, hi, values, doc in K.shingle_sets(data, offsets, size):
        n = np.bincount(doc, minlength=hi - lo)
        have = np.flatnonzero(n)
        starts = K.groups(doc)
        names: list = [None] * (hi - lo)
        for d, a, m in zip(have, starts, n[have]):
            names[d] = hashlib.blake2b(values[a : a + m].tobytes(), digest_size=16).digest()
        low = minima(values, starts, count) if len(have) else np.zeros((0, count), np.uint32)
        seed = np.arange(bands, dtype=np.uint64)
        band = low[:, : bands * rows].reshape(len(have), bands, rows).astype(np.uint64)
        key = np.broadcast_to(seed, (len(have), bands)).copy()
        for k in range(rows):
            key = K.mix(key * np.uint64(0x100000001B3) + band[:, :, k])
        nibble = (low & np.uint32(NIBBLES - 1)).astype(np.uint64)
        pad = -nibble.shape[1] % 16
        nibble = np.pad(nibble, ((0, 0), (0, pad))).reshape(len(have), -1, 16)
        sig = (nibble << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)

        def lists(matrix):
            cut = np.zeros(hi - lo + 1, np.int32)
            cut[1:] = np.cumsum(np.where(n > 0, matrix.shape[1], 0))
            return pa.ListArray.from_arrays(pa.array(cut), pa.array(matrix.view(np.int64).ravel()))

        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[lo:hi]), pa.array(n.astype(np.int64)), pa.array(names, pa.binary()),
             lists(np.ascontiguousarray(sig)), lists(np.ascontiguousarray(key))],
            schema=_SIGNED,
        )


def estimate(a: Column, b: Column, count: int) -> Column:
    """Similarity from the share of equal low bits, less what chance makes equal."""
    longs = -(-count // 16)
    differing = F.lit(0)
    for k in range(longs):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    share = (F.lit(float(count)) - differing) / F.lit(float(count))
    return (share - 1 / NIBBLES) / (1 - 1 / NIBBLES)


def _verified(size: int, threshold: int):
    """Pairs with both texts to whether their sets are similar enough, exactly."""
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        for batch in batches:
            texts = pa.concat_arrays([batch.column("text_hi"), batch.column("text_lo")])
            n = batch.num_rows
            distinct = texts.dictionary_encode()
            data, offsets = K.flat(distinct.dictionary)
            sets = []
            for lo, hi, values, doc in K.shingle_sets(data, offsets, size):
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                sets += [values[a:b] for a, b in zip(cut[:-1], cut[1:])]
            code = distinct.indices.to_numpy()
            linked = []
            for a, b in zip(code[:n], code[n:]):
                x, y = sets[a], sets[b]
                both = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * both >= threshold * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("hi"), batch.column("lo"), pa.array(linked, pa.bool_())], schema=schema
            )

    return run


def _check(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    one = texts.select(F.col("node").alias("hi"), F.col("text").alias("text_hi"))
    two = texts.select(F.col("node").alias("lo"), F.col("text").alias("text_lo"))
    both = pairs.join(one, "hi").join(two, "lo").select("hi", "lo", "text_hi", "text_lo")
    return both.mapInArrow(_verified(size, threshold), "hi long, lo long, linked boolean")


_BLOCK = ["band", "x", "y"]
_DOUBTS = "band long, x int, y int, node long, mates binary"


def _groups(batches):
    """Tables of the rows of one block each; `batches` are sorted by block."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        if not rows.num_rows:
            continue
        change = np.zeros(rows.num_rows - 1, bool)
        for name in _BLOCK:
            values = rows[name].to_numpy()
            change |= values[1:] != values[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:]):
            yield rows.slice(lo, hi - lo)
        kept = rows.slice(edges[-1])
    if kept is not None:
        yield kept


def _doubts(count: int, floor: float):
    """Members of blocks that look similar to one of another component, with their mates.

    A pair is named in the first band it shares, by one of its two members.
    """
    longs = -(-count // NIBBLES)
    ones = np.uint64(0x1111111111111111)
    schema = pa.schema([("band", pa.int64()), ("x", pa.int32()), ("y", pa.int32()),
                        ("node", pa.int64()), ("mates", pa.binary())])

    def run(batches):
        for rows in _groups(batches):
            node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
            band, x, y, at = (rows[c][0].as_py() for c in ("band", "x", "y", "at"))
            lists = [rows[c].combine_chunks().flatten().to_numpy().reshape(len(node), -1) for c in ("sig", "bands")]
            sig, bands = lists[0].view(np.uint64)[:, :longs], lists[1]
            chunk = rows["chunk"].to_numpy()
            one, two = np.flatnonzero(chunk == x), np.flatnonzero(chunk == y)
            mates = {}
            for k, i in enumerate(one):
                others = two[k + 1 :] if x == y else two
                d = sig[others] ^ sig[i]
                d |= d >> np.uint64(2)
                d |= d >> np.uint64(1)
                equal = 1 - np.bitwise_count(d & ones).sum(axis=1) / count
                like = others[
                    ((equal - 1 / NIBBLES) / (1 - 1 / NIBBLES) >= floor) & (label[others] != label[i])
                ]
                if at:
                    like = like[~(bands[like, :at] == bands[i, :at]).any(axis=1)]
                if len(like):
                    mates[i] = node[like].tobytes()
                    for j in like:
                        mates.setdefault(j, None)
            n = len(mates)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([band] * n, pa.int64()), pa.array([x] * n, pa.int32()), pa.array([y] * n, pa.int32()),
                     pa.array(node[list(mates)]), pa.array(list(mates.values()), pa.binary())], schema=schema,
                )

    return run


def _settled(size: int, threshold: int):
    """Blocks of doubtful members with their texts to links that connect all that link."""
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches):
        for rows in _groups(batches):
            nodes = rows["node"].to_pylist()
            place = {node: i for i, node in enumerate(nodes)}
            data, offsets = K.flat(rows["text"].combine_chunks())
            sets = []
            for lo, hi, values, doc in K.shingle_sets(data, offsets, size):
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                sets += [values[a:b] for a, b in zip(cut[:-1], cut[1:])]
            above = list(range(len(nodes)))

            def top(i):
                while above[i] != i:
                    above[i] = above[above[i]]
                    i = above[i]
                return i

            his, los = [], []
            for i, mates in enumerate(rows["mates"].to_pylist()):
                for mate in np.frombuffer(mates or b"", np.int64).tolist():
                    j = place[mate]
                    a, b = sets[i], sets[j]
                    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)) or top(i) == top(j):
                        continue
                    both = np.concatenate([a, b])
                    both.sort(kind="stable")
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * shared >= threshold * (len(both) - shared) and shared:
                        above[top(i)] = top(j)
                        his.append(max(nodes[i], mate))
                        los.append(min(nodes[i], mate))
            if his:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(his, pa.int64()), pa.array(los, pa.int64())], schema=schema
                )

    return run


def _leftover_links(
    told: DataFrame, sigs: DataFrame, texts: DataFrame, *, size: int, threshold: int, count: int, floor: float
) -> DataFrame:
    """(hi, lo) that connect members of one band and different components.

    Members outside the leader's component meet each other and the leader's. Both
    kinds are cut into chunks, and a block is a pair of chunks: its size is bounded
    however long the band or the texts.
    """
    wide = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    away = F.col("label") != F.col("leader_label")
    told = told.join(sigs.select("node", "n_shingles"), "node").withColumn("away", away)
    spared = F.lit(0).cast("bigint")

    def chunks(kind: Column) -> Column:
        rows = F.sum(kind.cast("bigint")) / F.lit(PART_ROWS)
        shingles = F.sum(F.when(kind, F.col("n_shingles")).otherwise(spared)) / F.lit(PART_SHINGLES)
        return F.greatest(F.ceil(rows), F.ceil(shingles)).cast("int")

    cuts = stage(told.groupBy("band").agg(
        chunks(F.col("away")).alias("aways"), chunks(~F.col("away")).alias("owns"),
        F.sum(F.col("away").cast("int")).alias("n_away"),
    ), "band-chunks")
    drawn = F.xxhash64("node")
    mine = F.when(F.col("away"), F.pmod(drawn, F.col("aways"))).otherwise(
        F.col("aways") + F.pmod(drawn, F.col("owns"))
    ).cast("int")
    block = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    to_aways = F.transform(
        F.sequence(F.lit(0), F.col("aways") - 1),
        lambda c: block(F.least(c, F.col("chunk")), F.greatest(c, F.col("chunk"))),
    )
    to_owns = F.transform(F.sequence(F.lit(0), F.col("owns") - 1), lambda c: block(F.col("chunk"), F.col("aways") + c))
    # One member away has only the leader's component to meet.
    spots = F.when(F.col("away") & (F.col("n_away") > 1), F.concat(to_aways, to_owns)).when(
        F.col("away"), to_owns
    ).otherwise(to_aways)
    spotted = told.join(small_side(cuts), "band").withColumn("chunk", mine).select(
        "band", F.explode(spots).alias("block"), "chunk", "at", "node", "label"
    ).select("band", "block.*", "chunk", "at", "node", "label")
    dealt = spotted.join(sigs.drop("n_shingles"), "node").repartition(wide, *_BLOCK).sortWithinPartitions(*_BLOCK)
    doubts = stage(
        dealt.select(*_BLOCK, "chunk", "at", "node", "label", "sig", "bands").mapInArrow(
            _doubts(count, floor), _DOUBTS
        ), "doubts",
    )
    read = doubts.join(texts, "node").repartition(wide, *_BLOCK).sortWithinPartitions(*_BLOCK)
    links = read.select(*_BLOCK, "node", "mates", "text").mapInArrow(_settled(size, threshold), "hi long, lo long")
    return stage(links, "leftover-links")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]


def linked_components(
    items: DataFrame, texts: DataFrame, *, size: int, threshold: int, count: int, floor: float
) -> DataFrame | None:
    """(node, label) of nodes linked with another; None if there is no link.

    `items` has node, n_shingles, sig, bands with distinct sets; `texts` finds a node's text.
    Sets with 100 * intersection >= threshold * union are linked; candidates with an
    estimate under `floor` are not looked at. The label is the smallest node.
    """
    spread = items.select("node", F.posexplode("bands").alias("at", "value")).select(
        "node", "at", F.xxhash64("at", "value").alias("band")
    )
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(shared, "shared-bands")
    members = stage(spread.join(small_side(shared), "band"), "band-members")
    # A text that many are similar to shares the most bands with the most texts.
    weights = small_side(stage(members.groupBy("node").agg(F.sum("n").alias("weight")), "candidates"))
    nodes = weights.select("node")
    texts = stage(texts.join(nodes, "node", "left_semi"), "candidate-texts")
    signs = items.select("node", "n_shingles", "sig", "bands").join(nodes, "node", "left_semi")
    sigs = stage(signs, "candidate-signatures")

    links = refused = labels = None
    progress, round_no = True, 0
    while True:
        current = members if labels is None else members.join(
            small_side(labels), "node", "left"
        )
        label = F.col("node") if labels is None else F.coalesce("label", "node")
        current = current.join(weights, "node").select("band", "at", "n", "node", "weight", label.alias("label"))
        drawn = F.xxhash64("node", F.lit(round_no))
        order = F.struct(F.col("weight"), drawn) if round_no % 2 == 0 else F.struct(drawn)
        mixed = current.groupBy("band").agg(
            F.min("label").alias("a"), F.max("label").alias("b"),
            F.max_by(F.struct("node", "label"), order).alias("leader"),
        ).where("a <> b").select("band", "leader")
        current = stage(current.join(mixed, "band"), "open-bands")
        told = current.select(
            "band", "at", "n", "node", "label", F.col("leader.node").alias("leader"),
            F.col("leader.label").alias("leader_label"),
        )
        if not progress:
            found = _leftover_links(
                told, sigs, texts, size=size, threshold=threshold, count=count, floor=floor
            )
            if found.isEmpty():
                return labels
            return component_labels(found if links is None else links.unionByName(found))
        pairs = told.where("label <> leader_label").select("node", "leader").distinct()
        theirs = sigs.select(F.col("node").alias("leader"), F.col("sig").alias("leader_sig"))
        own = sigs.select("node", "sig")
        scored = pairs.join(own, "node").join(theirs, "leader").withColumn(
            "score", estimate(F.col("sig"), F.col("leader_sig"), count)
        ).where(F.col("score") >= floor)
        if refused is not None:
            scored = scored.select(*_ordered(F.col("node"), F.col("leader")), "node", "leader", "score").join(
                refused, ["hi", "lo"], "left_anti"
            )
        pairs = scored.groupBy("node").agg(
            F.max_by("leader", F.struct("score", "leader")).alias("leader")
        ).select(*_ordered(F.col("node"), F.col("leader"))).distinct()
        pairs = stage(pairs, "proposals")
        checked = stage(_check(small_side(pairs), texts, size, threshold), "checked-pairs")
        found = checked.where("linked").select("hi", "lo")
        counts = checked.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("linked").cast("int")).alias("yes")
        ).first()
        if counts["yes"]:
            links = found if links is None else links.unionByName(found)
            labels = component_labels(links)
        no = checked.where("not linked").select("hi", "lo")
        refused = no if refused is None else refused.unionByName(no)
        # Go on with proposals while enough of them link; they cost one check a node.
        progress = (counts["yes"] or 0) * PROGRESS >= max(counts["n"], 1)
        round_no += 1
