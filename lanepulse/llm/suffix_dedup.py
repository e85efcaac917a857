"""Repeated byte strings across documents, by anchors and window hashes.

These replace prefix doubling: no (rank, rank at +k) pairs are built and nothing is
reranked at growing offsets. A string of LENGTH bytes that starts in a document and in
one with a smaller key is removed. Anchors are positions whose GRAM-byte hash is
smallest within some LENGTH-byte window. Equal windows hold equal anchors at equal
places, so no match is lost. Two steps:

1. the GRAM bytes at an anchor are named by their hash. Spark deals the (name,
   document, place) triples over tasks by name; each task sorts its own in numpy and
   drops names that only one document has (nothing longer can repeat there).
2. every LENGTH-byte window around a surviving anchor is named by a polynomial hash of
   its bytes, a difference of two prefix sums. Again sorted by name inside a task, the
   smallest document of a name keeps its string.

Copies within a batch are settled before anything is shuffled, so a passage in a third
of all documents sends one triple per batch. Equal whole texts are settled first.

Names of windows are 64-bit hashes compared inside a part of the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.llm import kernels as K
from lanepulse.llm.common import dealt, deal, keyed, n_parts, text_bytes
from lanepulse.joins import small_side
from lanepulse.staging import stage

LENGTH = 50
GRAM = 20
WINDOWS = LENGTH - GRAM + 1
SIDE = WINDOWS - 1
CONTEXT = LENGTH + SIDE
RANK_BYTES = 8 << 20
TEXT_BYTES = 8 << 20
MATRIX_ROWS = 1 << 15

_PACKED = "part int, settled boolean, target int, keys binary, at binary, data binary"
_TRIPLES = pa.schema(
    [("part", pa.int32()), ("settled", pa.bool_()), ("target", pa.int32()),
     ("keys", pa.binary()), ("at", pa.binary()), ("data", pa.binary())]
)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `data` that some whole window of one document is named after, with ranks."""
    places, ranks = [], []
    n = len(data)
    for lo in range(0, n, K.PIECE):
        piece = data[lo : lo + K.PIECE + LENGTH - 1]
        size = min(K.PIECE, len(piece) - LENGTH + 1)
        if size <= 0:
            break
        rank = K.gram_hash(piece, GRAM)
        lowest = K.sliding(np.minimum, rank, WINDOWS)[:size]
        starts = np.arange(lo, lo + size)
        first = np.searchsorted(offsets, lo, "right") - 1
        ends = offsets[first + 1 :]
        ends = ends[: int(np.searchsorted(ends, lo + size, "left")) + 1]
        edges = np.concatenate([[lo], np.minimum(ends, lo + size)])
        room = np.repeat(ends, np.diff(edges)) - starts
        lowest[room < LENGTH] = 0
        pad = np.zeros(SIDE, np.uint64)
        named = K.sliding(np.maximum, np.concatenate([pad, lowest, pad]), WINDOWS)
        m = min(len(named), len(rank))
        at = np.flatnonzero(named[:m] == rank[:m])
        places.append(at + lo)
        ranks.append(rank[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, rank = np.concatenate(places), np.concatenate(ranks)
    keep = np.unique(place, return_index=True)[1]
    return place[keep], rank[keep]


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _packed(part, settled, target, keys, at, data) -> list[list]:
    """One row per part (or target) of parallel arrays; `data` may be a matrix."""
    by = target if settled else part
    order = np.argsort(by, kind="stable")
    starts = K.groups(by[order])
    rows = [[] for _ in range(6)]
    for lo, hi in zip(starts, np.append(starts[1:], len(order))):
        some = order[lo:hi]
        one = some[0]
        for row, value in zip(
            rows,
            (int(part[one]), settled, int(target[one]) if target is not None else -1,
             _bytes(keys[some], "<i8"), _bytes(at[some], "<i4"), data[some].tobytes()),
        ):
            row.append(value)
    return rows


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(rows, _TRIPLES)], schema=_TRIPLES
    )


def _shared(rank: np.ndarray, keys: np.ndarray):
    """Sort order by rank, group starts, and which groups hold several documents."""
    order = np.lexsort((keys, rank))
    starts = K.groups(rank[order])
    lengths = K.run_lengths(starts, len(order))
    sorted_keys = keys[order]
    last = starts + lengths - 1
    return order, starts, lengths, sorted_keys[starts] != sorted_keys[last]


def _scan_ranks(n_rank: int, n_text: int):
    """Texts to (rank, document, place); ranks shared within a batch are settled at once."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = K.flat(batch.column(1))
            place, rank = anchors(data, offsets)
            if not len(place):
                continue
            doc = np.searchsorted(offsets, place, "right") - 1
            at = (place - offsets[doc]).astype(np.int32)
            key = keys[doc]
            order, starts, lengths, several = _shared(rank, key)
            known = np.zeros(len(rank), bool)
            known[order] = np.repeat(several, lengths)
            part = ((rank >> np.uint64(40)) % np.uint64(n_rank)).astype(np.int32)
            if known.any():
                kept = np.flatnonzero(known)
                yield _batch(_packed(
                    part[kept], True, deal(key[kept], n_text), key[kept], at[kept], rank[kept]
                ))
            # One witness stands for a settled rank; its place is marked as told.
            told = np.zeros(len(rank), bool)
            told[order[starts[several]]] = True
            sent = np.flatnonzero(~known | told)
            at = np.where(told, -1, at)
            yield _batch(_packed(part[sent], False, part[sent], key[sent], at[sent], rank[sent]))

    return run


def _joined(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _share_ranks(n_text: int):
    """Rows of one part to survivors by the part of their document."""

    def run(table: pa.Table) -> pa.Table:
        settled = table.column("settled").to_numpy()
        out = [table.filter(pa.array(settled))]
        rest = table.filter(pa.array(~settled))
        if rest.num_rows:
            keys, at = _joined(rest["keys"], "<i8"), _joined(rest["at"], "<i4")
            rank = _joined(rest["data"], "<u8")
            order, _, lengths, several = _shared(rank, keys)
            alive = np.zeros(len(rank), bool)
            alive[order] = np.repeat(several, lengths)
            alive &= at >= 0
            if alive.any():
                keys, at, rank = keys[alive], at[alive], rank[alive]
                target = deal(keys, n_text)
                rows = _packed(target, True, target, keys, at, rank)
                out.append(pa.Table.from_batches([_batch(rows)]))
        return pa.concat_tables([t.cast(_TRIPLES) for t in out])

    return run


def _context_rows(data, begin, end, place):
    """Bytes around each place, with how many are there on either side."""
    left = np.minimum(place - begin, SIDE)
    right = np.minimum(end - place - GRAM, SIDE)
    padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(CONTEXT, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[place]
    inside = np.arange(CONTEXT)
    clear = (inside < (SIDE - left)[:, None]) | (inside >= (SIDE + GRAM + right)[:, None])
    rows = np.where(clear, 0, rows).astype(np.uint8)
    return np.concatenate([rows, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)


def _contexts(n_rank: int, n_text: int):
    """Texts and their surviving places to the bytes around each place."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        none = pa.Table.from_batches([], schema=_TRIPLES)
        if not docs.num_rows or not found.num_rows:
            return none
        keys = docs["key"].to_numpy().astype(np.int64)
        data, offsets = K.flat(docs["text"])
        key, at = _joined(found["keys"], "<i8"), _joined(found["at"], "<i4")
        rank = _joined(found["data"], "<u8")
        by_key = np.argsort(keys)
        doc = by_key[np.searchsorted(keys[by_key], key)]
        begin, end = offsets[doc], offsets[doc + 1]
        part = ((rank >> np.uint64(40)) % np.uint64(n_rank)).astype(np.int32)
        order = np.lexsort((key, rank))
        out = []
        for lo in range(0, len(order), MATRIX_ROWS):
            some = order[lo : lo + MATRIX_ROWS]
            rows = _context_rows(data, begin[some], end[some], begin[some] + at[some])
            # Within a batch of whole equal contexts the first stands for all.
            name = K.prefix_hash(K.BYTE_TABLE[rows])[:, -1]
            by_name = np.lexsort((key[some], name))
            starts = K.groups(name[by_name])
            first = np.repeat(key[some][by_name][starts], K.run_lengths(starts, len(by_name)))
            copy = np.zeros(len(some), bool)
            copy[by_name] = key[some][by_name] != first
            if copy.any():
                one = some[copy]
                mask = _room(rows[copy, -2], rows[copy, -1])
                target = deal(key[one], n_text)
                out.append(_batch(_packed(part[one], True, target, key[one], at[one], mask)))
            one = some[~copy]
            out.append(_batch(_packed(part[one], False, part[one], key[one], at[one], rows[~copy])))
        return pa.Table.from_batches(out, schema=_TRIPLES)

    return run


def _room(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit o is set where the window starting o bytes before the anchor is inside."""
    o = np.arange(WINDOWS)
    inside = (o <= left[:, None]) & (SIDE - o <= right[:, None])
    return (inside.astype(np.uint32) << o.astype(np.uint32)).sum(axis=1, dtype=np.uint32)


def _settle_windows(n_text: int):
    """Contexts of one part to bit masks of the windows a smaller document has."""

    def run(table: pa.Table) -> pa.Table:
        settled = table.column("settled").to_numpy()
        out = [table.filter(pa.array(settled))]
        rest = table.filter(pa.array(~settled))
        if rest.num_rows:
            keys, at = _joined(rest["keys"], "<i8"), _joined(rest["at"], "<i4")
            rows = _joined(rest["data"], "u1").reshape(len(keys), CONTEXT + 2)
            names = np.empty((WINDOWS, len(keys)), np.uint64)
            _, down = K.powers(CONTEXT + 1)
            for lo in range(0, len(keys), MATRIX_ROWS):
                sums = K.prefix_hash(K.BYTE_TABLE[rows[lo : lo + MATRIX_ROWS, :CONTEXT]])
                spans = (sums[:, LENGTH:] - sums[:, :-LENGTH]) * down[: SIDE + 1]
                names[:, lo : lo + MATRIX_ROWS] = spans[:, ::-1].T
            room = _room(rows[:, -2], rows[:, -1])
            mask = np.zeros(len(keys), np.uint32)
            by_key = np.argsort(keys, kind="stable")
            for o in range(WINDOWS):
                have = by_key[(room[by_key] >> np.uint32(o)) & 1 == 1]
                if not len(have):
                    continue
                order = have[np.argsort(names[o][have], kind="stable")]
                starts = K.groups(names[o][order])
                first = np.repeat(keys[order][starts], K.run_lengths(starts, len(order)))
                mask[order[keys[order] != first]] |= np.uint32(1 << o)
            hit = np.flatnonzero(mask)
            if len(hit):
                target = deal(keys[hit], n_text)
                rows = _packed(target, True, target, keys[hit], at[hit], mask[hit])
                out.append(pa.Table.from_batches([_batch(rows)]))
        return pa.concat_tables([t.cast(_TRIPLES) for t in out])

    return run


_SPANS = pa.schema([("key", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _spans(found: pa.Table) -> pa.Table:
    """Masks of one part of documents to maximal runs of covered bytes."""
    key, at, mask = _joined(found["keys"], "<i8"), _joined(found["at"], "<i4"), _joined(found["data"], "<u4")
    o = np.arange(WINDOWS)
    row, back = np.nonzero((mask[:, None] >> o.astype(np.uint32)) & 1)
    doc, start = key[row], at[row].astype(np.int64) - back
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    run_doc, run_start, run_end = doc[first], start[first], start[last] + LENGTH
    heads = K.groups(run_doc)
    cut = pa.array(np.append(heads, len(run_doc)), pa.int32())
    return pa.Table.from_arrays(
        [pa.array(run_doc[heads]), pa.ListArray.from_arrays(cut, pa.array(run_start)),
         pa.ListArray.from_arrays(cut, pa.array(run_end))], schema=_SPANS,
    )


def repeated_spans(docs: DataFrame, rank_bytes: int = RANK_BYTES, text_part: int = TEXT_BYTES) -> DataFrame:
    """(key, starts, ends) of the byte runs that a smaller document also holds.

    `docs` has a unique long `key` and `text`; texts are distinct. Documents
    without such a run have no row. Empty and NULL texts have none.
    """
    total = text_bytes(docs)
    n_rank, n_text = n_parts(total, rank_bytes), n_parts(total, text_part)
    scan = docs.select("key", "text")
    triples = scan.mapInArrow(_scan_ranks(n_rank, n_text), _PACKED)
    alive = triples.groupBy("part").applyInArrow(_share_ranks(n_text), _PACKED)
    placed = scan.withColumn("target", dealt(F.col("key"), n_text))
    around = (
        placed.groupBy("target").cogroup(alive.groupBy("target"))
        .applyInArrow(_contexts(n_rank, n_text), _PACKED)
    )
    masks = around.groupBy("part").applyInArrow(_settle_windows(n_text), _PACKED)
    return masks.groupBy("target").applyInArrow(
        _spans, "key long, starts array<long>, ends array<long>"
    )


_CUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                  ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(with_bytes: bool):
    def run(batches):
        for batch in batches:
            rows = [[] for _ in _CUT]
            columns = [batch.column(n) for n in ("id", "text", "starts", "ends")]
            for ident, text, starts, ends in zip(*columns):
                raw = (text.as_py() or "").encode()
                kept, at, gone = [], 0, 0
                for a, b in zip(starts.as_py() or (), ends.as_py() or ()):
                    kept.append(raw[at:a])
                    gone += b - a
                    at = b
                left = b"".join([*kept, raw[at:]])
                for row, value in zip(rows, (
                    ident.as_py(), len(raw), gone, len(kept), hashlib.sha256(left).hexdigest(),
                    left if with_bytes else None,
                )):
                    row.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(rows, _CUT)], schema=_CUT
            )

    return run


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, with_bytes: bool = True
) -> DataFrame:
    """Each document without the bytes that repeat from a smaller id.

    Returns id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the
    kept bytes (a cut may fall inside a character). NULL text counts as empty,
    other columns are ignored. Rows that share an id count as documents in the
    order of their text; rows without id come first and keep the NULL. An empty
    table gives an empty result.
    """
    rows = keyed(docs, id_column, text_column).select(
        "key", "id", F.coalesce("text", F.lit("")).alias("text")
    )
    name = F.md5(F.col("text").cast("binary"))
    first = rows.groupBy(name.alias("name")).agg(F.min("key").alias("key")).select("key")
    first = small_side(stage(first, "first-copies"))
    heads = rows.join(first, "key", "left_semi")
    spans = small_side(stage(repeated_spans(heads), "repeated-spans"))
    # A later copy is covered as a whole if it holds any string of that length.
    whole = F.octet_length("text").cast("bigint")
    copies = rows.join(first, "key", "left_anti").select(
        "id", "text",
        F.when(whole >= LENGTH, F.array(F.lit(0).cast("bigint"))).alias("starts"),
        F.when(whole >= LENGTH, F.array(whole)).alias("ends"),
    )
    marked = heads.join(spans, "key", "left").select("id", "text", "starts", "ends")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return marked.unionByName(copies).mapInArrow(_cut(with_bytes), schema)
