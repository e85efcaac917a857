"""Repeated paragraphs: MinHash bands, exact check, components, first place kept.

A paragraph is a line of a document of at least MIN_WORDS words. Lines are compared by
their sets of word shingles; equal sets are one node. Bands are tuned for recall: a pair at
the threshold is missed with the probability that miss_rate() gives.

Passages inside and across lines are found by pieces of PIECE words, which start where the
hash of three words is the smallest of some WINDOW in a row. Whatever stands around it, a
passage of PIECE + WINDOW - 1 = 23 words holds a piece at the same place, so of a
passage of 51 words with one word changed a piece is left. Equal pieces collide with the
first of their kind; pieces in a row that collide with a row of the same document are one
stretch. A stretch is widened on both sides by word edit distance: past a word that is changed,
missing or added if RESUME equal words follow. It goes if it has LEAST words then.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanepulse.joins import small_side
from lanepulse.llm import kernels as K
from lanepulse.llm.common import keyed, keyed_rows
from lanepulse.llm.linking import SIGNED, linked_components, signed, tuned_for
from lanepulse.staging import stage

MIN_WORDS = 20
ROWS = 3
RECALL = 0.9998
LINE_BITS = 24
MINIMA = 320
# Three and a half standard deviations of the estimate below 0.8.
FLOOR = 0.715
BLOCK = 1 << 14
PIECE = 12
WINDOW = 12
GRAM = 3
# Words of a stretch that goes, at least.
LEAST = 24
# Words looked at on either side of a stretch: more than may lie between two pieces of one passage.
SIDE = 40
RESUME = 5


def tuned_bands(threshold: int, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of `rows` minima that bring a pair at the threshold together often enough."""
    bands = 1
    while miss_rate(threshold, bands, rows) > 1 - recall:
        bands += 1
    return bands


def miss_rate(threshold: int, bands: int, rows: int = ROWS) -> float:
    return (1 - (threshold / 100) ** rows) ** bands


def _paragraphs(keys, texts, min_words: int):
    """Blocks (nodes, lines) of the lines that are long enough to be compared."""
    nodes, lines, last = [], [], (1 << LINE_BITS) - 1
    for key, text in zip(keys, texts):
        for no, line in enumerate((text or "").split("\n", last)):
            if len(line) >= 2 * min_words - 1 and len(line.split(None, min_words - 1)) >= min_words:
                nodes.append((key << LINE_BITS) | no)
                lines.append(line)
        if len(lines) >= BLOCK:
            yield nodes, lines
            nodes, lines = [], []
    if lines:
        yield nodes, lines


def _sign(size: int, min_words: int, bands: int):
    def run(batches):
        for batch in batches:
            rows = (x.as_py() for x in batch.column(1))
            for nodes, lines in _paragraphs(batch.column(0).to_pylist(), rows, min_words):
                yield from signed(np.array(nodes, np.int64), pa.array(lines, pa.string()), size, bands, ROWS, MINIMA)

    return run


def _lines(min_words: int):
    def run(batches):
        for batch in batches:
            rows = (x.as_py() for x in batch.column(1))
            for nodes, lines in _paragraphs(batch.column(0).to_pylist(), rows, min_words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], names=["node", "text"]
                )

    return run


def anchors(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words that start a piece, of words given by hash and document.

    Of a run of equal words only every WINDOW-th start counts.
    """
    n = len(hashes) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    sums = K.prefix_hash(hashes)
    _, down = K.powers(len(hashes) + 1)
    gram = K.mix((sums[GRAM:] - sums[:-GRAM]) * down[:n]) | np.uint64(1)
    low = K.sliding(np.minimum, gram, WINDOW)
    low = np.where(doc[: len(low)] == doc[WINDOW + GRAM - 2 :], low, np.uint64(0))
    best = K.sliding(np.maximum, np.pad(low, WINDOW - 1), WINDOW)
    at = np.arange(n)
    start = np.ones(n, bool)
    start[1:] = (gram[1:] != gram[:-1]) | (doc[1:n] != doc[: n - 1])
    run = np.maximum.accumulate(np.where(start, at, 0))
    found = np.flatnonzero((gram == best) & ((at - run) % WINDOW == 0))
    found = found[found + PIECE <= len(hashes)]
    return found[doc[found] == doc[found + PIECE - 1]]


def _keys(batch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _name_pieces(batches):
    """(node, name): a node is a document's key and the number of a word, a name the hash of its words."""
    for batch in batches:
        keys, (data, offsets) = _keys(batch), K.flat(batch.column(1))
        for lo, hi in K.blocks(offsets):
            start, end, doc = K.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            hashes = K.word_hash(data[offsets[lo] : offsets[hi]], start, end)
            at = anchors(hashes, doc)
            no = at - np.searchsorted(doc, doc[at])
            at, no = at[no < 1 << LINE_BITS], no[no < 1 << LINE_BITS]
            sums = K.prefix_hash(hashes)
            _, down = K.powers(len(hashes) + 1)
            name = K.mix((sums[at + PIECE] - sums[at]) * down[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys[lo:hi][doc[at]] << LINE_BITS) | no), pa.array(name.view(np.int64))],
                names=["node", "name"],
            )


def _repeated(
    signs: DataFrame, texts: DataFrame, *, size: int, threshold: int, count: int, floor: float
) -> DataFrame:
    """(node, first, label) of nodes that have copies or a smaller node in their component.

    The first is the smallest node of the same set, the label the smallest that is linked.
    """
    signs = stage(signs, "paragraphs")
    firsts = stage(
        signs.where("name is not null").groupBy("name").agg(
            F.min("node").alias("first"), F.count(F.lit(1)).alias("n")
        ), "paragraph-firsts",
    )
    # Copies are fewer than firsts, so theirs is the smaller list to look up.
    copied = small_side(firsts.where("n > 1").select("name", "first"))
    copies = signs.select("node", "name").join(copied, "name").where("node <> first").select("node")
    items = signs.where("name is not null").select("node", "n_shingles", "sig", "bands").join(
        small_side(stage(copies, "copies")), "node", "left_anti"
    )
    labels = linked_components(items, texts, size=size, threshold=threshold, count=count, floor=floor)
    if labels is None:
        heads = firsts.where("n > 1").select("name", "first", F.col("first").alias("label"))
    else:
        labels = small_side(labels.select(F.col("node").alias("first"), "label"))
        heads = firsts.join(labels, "first", "left").where("n > 1 or label is not null").select(
            "name", "first", F.coalesce("label", "first").alias("label")
        )
    return signs.select("node", "name").join(small_side(stage(heads, "repeated-names")), "name").drop("name")


def repeated_lines(
    rows: DataFrame, *, size: int = 5, threshold: int = 80, min_words: int = MIN_WORDS
) -> DataFrame:
    """(key, lines) of the lines that repeat an earlier one; `rows` has key and text.

    Earlier means a smaller key, or the same document and a smaller line number.
    """
    scan = rows.select("key", "text")
    placed = _repeated(
        scan.mapInArrow(_sign(size, min_words, tuned_bands(threshold)), SIGNED),
        scan.mapInArrow(_lines(min_words), "node long, text string"),
        size=size, threshold=threshold, count=MINIMA, floor=FLOOR,
    )
    mask = F.lit((1 << LINE_BITS) - 1).cast("bigint")
    return placed.where("node <> label").groupBy(
        F.shiftright("node", LINE_BITS).alias("key")
    ).agg(F.collect_list(F.col("node").bitwiseAND(mask).cast("int")).alias("lines"))


_STRETCHES = pa.schema([(c, pa.int64()) for c in ("key", "start", "stop", "ref_key", "ref_start", "ref_stop")])


def _stretches(batches):
    """Pieces in a row that are held against a row of pieces of one document, as one stretch."""
    mask = (1 << LINE_BITS) - 1
    for batch in batches:
        rows = [[] for _ in _STRETCHES]
        for key, found in zip(batch.column("key").to_pylist(), batch.column("found")):
            found = found.values
            at, first = (found.field(c).to_numpy() for c in ("at", "first"))
            order = np.argsort(at)
            at, first = at[order], first[order]
            ref, there = first >> LINE_BITS, first & mask
            new = np.ones(len(at), bool)
            new[1:] = (ref[1:] != ref[:-1]) | (np.diff(at) != np.diff(there)) | (np.diff(at) > PIECE)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at)) - 1
            columns = at[begin], at[end] + PIECE, ref[begin], there[begin], there[end] + PIECE
            rows[0] += [key] * len(begin)
            for row, column in zip(rows[1:], columns):
                row += column.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=_STRETCHES)


_EDGES = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("own", pa.bool_()), ("ref", pa.bool_()),
                    ("words", pa.list_(pa.int32()))])


def _edges(batches):
    """Hashes of the up to SIDE words that come before and after the places asked for.

    Words after a place are given as they stand, words before it (`at` below 0, as ~at) backwards.
    """
    for batch in batches:
        keys, places, own, ref, words = [], [], [], [], []
        for key, text, asked in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("asked")):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            start, end, _ = K.words(data, np.array([0, len(data)]))
            hashes = K.word_hash(data, start, end).astype(np.uint32).view(np.int32)
            asked = asked.values
            for at, ours, theirs in zip(*(asked.field(c).to_pylist() for c in ("at", "own", "ref"))):
                keys.append(key)
                places.append(at)
                own.append(ours)
                ref.append(theirs)
                words.append(hashes[at : at + SIDE] if at >= 0 else hashes[max(0, ~at - SIDE) : ~at][::-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip((keys, places, own, ref, words), _EDGES)], schema=_EDGES
        )


def agreeing(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words of a and of b from their start on that agree by edits with RESUME equal words after each."""
    i = j = 0
    while True:
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        n = int(differ[0]) if len(differ) else n
        i, j = i + n, j + n
        for more, other in ((1, 1), (1, 0), (0, 1)):
            ours, theirs = a[i + more : i + more + RESUME], b[j + other : j + other + RESUME]
            if len(ours) == RESUME == len(theirs) and (ours == theirs).all():
                i, j = i + more, j + other
                break
        else:
            return i, j


_BEGUN = pa.schema([(c, pa.int64()) for c in ("key", "start", "stop", "ref_key", "ref_stop")])


def _begun(batches):
    """Stretches widened to the left; the words before them are not needed any more."""
    for batch in batches:
        start = batch.column("start").to_pylist()
        words = [[x.values.to_numpy() for x in batch.column(c)] for c in ("words", "ref_words")]
        start = [at - agreeing(ours, theirs)[0] for at, ours, theirs in zip(start, *words)]
        columns = [pa.array(start, pa.int64()) if c == "start" else batch.column(c) for c in _BEGUN.names]
        yield pa.RecordBatch.from_arrays(columns, schema=_BEGUN)


_SPANS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _spans(batches):
    for batch in batches:
        rows = [[] for _ in _SPANS]
        numbers = (batch.column(c).to_pylist() for c in _BEGUN.names)
        words = [[x.values.to_numpy() for x in batch.column(c)] for c in ("words", "ref_words")]
        for key, start, stop, ref, ref_stop, ours, theirs in zip(*numbers, *words):
            more, other = agreeing(ours, theirs)
            stop += more
            if key == ref:
                # What a document repeats of itself begins after the words repeated.
                start = max(start, ref_stop + other)
            if stop - start >= LEAST:
                for row, value in zip(rows, (key, start, stop)):
                    row.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=_SPANS)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(key, start, end) in words of the spans that repeat earlier words; `rows` has key and text.

    Earlier is as in repeated_lines(). A piece is held against the first of its kind, so a
    kind of any number of pieces makes that many rows. The words around stretches are asked
    for once for each place of a document, however many stretches are held against it.
    """
    scan = rows.select("key", "text")
    pieces = stage(scan.mapInArrow(_name_pieces, "node long, name long"), "pieces")
    firsts = stage(pieces.groupBy("name").agg(
        F.min("node").alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").drop("n"), "piece-firsts")
    mask = F.lit((1 << LINE_BITS) - 1).cast("bigint")
    found = pieces.join(firsts, "name").where("node <> first").groupBy(
        F.shiftright("node", LINE_BITS).alias("key")
    ).agg(F.collect_list(F.struct(F.col("node").bitwiseAND(mask).alias("at"), "first")).alias("found"))
    stretches = stage(found.mapInArrow(
        _stretches, "key long, start long, stop long, ref_key long, ref_start long, ref_stop long"
    ), "stretches")
    places = [
        stretches.select(F.col(key).alias("key"), at.alias("at")).distinct()
        for key, at in (("key", F.bitwise_not("start")), ("key", F.col("stop")),
                        ("ref_key", F.bitwise_not("ref_start")), ("ref_key", F.col("ref_stop")))
    ]
    # A place's words go only to the joins that ask for them.
    uses = [
        part.withColumns({"own": F.lit(own), "ref": F.lit(not own)})
        for part, own in zip(places, (True, True, False, False))
    ]
    asked = uses[0].union(uses[1]).union(uses[2]).union(uses[3]).groupBy("key", "at").agg(
        F.max("own").alias("own"), F.max("ref").alias("ref")
    ).groupBy("key").agg(F.collect_list(F.struct("at", "own", "ref")).alias("asked"))
    edges = stage(
        scan.join(asked, "key").select("key", "text", "asked").mapInArrow(
            _edges, "key long, at long, own boolean, ref boolean, words array<int>"
        ), "words-around",
    )

    def with_words(rows: DataFrame, at: Column, ref_at: Column, sign: str) -> DataFrame:
        for key, place, use, name in (("key", at, "own", "words"), ("ref_key", ref_at, "ref", "ref_words")):
            side = edges.where(f"{use} and at {sign} 0").select(
                F.col("key").alias("edge_key"), F.col("at").alias("edge_at"), F.col("words").alias(name)
            )
            rows = rows.withColumn("place", place).join(
                side, (F.col(key) == F.col("edge_key")) & (F.col("place") == F.col("edge_at"))
            ).drop("place", "edge_key", "edge_at")
        return rows

    # One side after the other, so that a shuffled row holds the words of one place at most.
    begun = with_words(stretches, F.bitwise_not("start"), F.bitwise_not("ref_start"), "<").mapInArrow(
        _begun, "key long, start long, stop long, ref_key long, ref_stop long"
    )
    around = with_words(begun, F.col("stop"), F.col("ref_stop"), ">=")
    return around.mapInArrow(_spans, "key long, start long, end long")


def repeated(
    rows: DataFrame, *, size: int = 5, threshold: int = 80, min_words: int = MIN_WORDS
) -> DataFrame:
    """(key, lines, starts, ends) of what goes from each document that loses something.

    A threshold under 80 is refused.
    """
    tuned_for(threshold)
    lines = repeated_lines(rows, size=size, threshold=threshold, min_words=min_words)
    spans = repeated_spans(rows).groupBy("key").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    ).select("key", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    return stage(lines.join(spans, "key", "full"), "repeated-lines")


def without(text: str, gone: list[int], starts: list[int], ends: list[int]) -> tuple[str, list[int]]:
    """The text without lines and spans of words, and the numbers of the lines that go whole.

    White space after a span goes with it, or before it at the end of a line. A line
    whose words all go, goes. Under LEAST words of a span that are left beside a line
    which goes are no passage of their own: whole lines among them stay.
    """
    last = (1 << LINE_BITS) - 1
    drop = set(gone)
    if not starts:
        lines = text.split("\n", last)
        return "\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text, sorted(drop)
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    first, end, _ = K.words(data, np.array([0, len(data)]))
    turn = np.zeros(len(first) + 1, np.int64)
    np.add.at(turn, starts, 1)
    np.add.at(turn, ends, -1)
    going = np.cumsum(turn)[:-1] > 0
    if drop:
        line_of = np.searchsorted(np.flatnonzero(data == 10)[: last - 1], first)
        dropped = np.isin(line_of, list(drop))
        going &= ~dropped
        edge = np.flatnonzero(np.diff(np.concatenate([[False], going, [False]])))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a < LEAST and (dropped[a - 1 : a].any() or dropped[b : b + 1].any()):
                for no in np.unique(line_of[a:b]):
                    c, d = np.searchsorted(line_of, [no, no + 1])
                    if a <= c and d <= b:
                        going[c:d] = False
    kept, base, word = [], 0, 0
    for no, line in enumerate(raw.split(b"\n", last)):
        stop = base + len(line)
        after = int(np.searchsorted(first, stop))
        mask = going[word:after]
        if no not in drop and mask.any():
            if mask.all():
                drop.add(no)
            else:
                # From each run of words that stay: its start to the next run's, or to its last word.
                edge = np.flatnonzero(np.diff(np.concatenate([[True], mask, [True]])))
                parts = [raw[base : first[word]]]
                for a, b in zip(edge[::2], edge[1::2]):
                    more = b < len(mask) and not mask[b:].all()
                    to = first[word + b] if more else stop if b == len(mask) else end[word + b - 1]
                    parts.append(raw[first[word + a] : to])
                line = b"".join(parts)
        if no not in drop:
            kept.append(line)
        base, word = stop + 1, after
    return b"\n".join(kept).decode(), sorted(drop)


_KEPT = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n_paragraphs", pa.int64()),
                   ("n_removed", pa.int64()), ("removed", pa.list_(pa.int32())),
                   ("kept_sha256", pa.string()), ("kept", pa.string())])
_GONE = ("lines", "starts", "ends")


def _without(batches):
    last = (1 << LINE_BITS) - 1
    for batch in batches:
        rows = [[] for _ in _KEPT]
        for key, ident, text, *gone in zip(*(batch.column(n) for n in ("key", "id", "text", *_GONE))):
            text = text.as_py()
            kept, removed = without(text or "", *(x.as_py() or [] for x in gone))
            kept = None if text is None else kept
            n_lines = text.count("\n") + 1 if text else 0
            digest = hashlib.sha256((kept or "").encode()).hexdigest()
            values = (key.as_py(), ident.as_py(), min(n_lines, last + 1), len(removed), removed, digest, kept)
            for row, value in zip(rows, values):
                row.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _KEPT)], schema=_KEPT)


def _shortened(batches):
    for batch in batches:
        kept = []
        for text, *gone in zip(*(batch.column(n) for n in ("text", *_GONE))):
            text = text.as_py()
            kept.append(None if text is None else without(text, *(x.as_py() or [] for x in gone))[0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(kept, pa.string())], names=["key", "kept"]
        )


def remove_paragraphs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how
) -> DataFrame:
    """Each document without the lines and spans that near-repeat earlier ones.

    Returns key, id, n_paragraphs, n_removed, removed (numbers of the lines that go
    whole), kept_sha256 and kept (the text; NULL stays NULL). Of a component of similar
    lines the one at the smallest (id, place) stays, of equal pieces the first. Lines under `min_words`
    words go only as part of a repeated passage. Rows that share an id are documents of
    their own in the order of their text, NULL ids first. Other columns are ignored; an
    empty table gives an empty result. The lines past the 16 millionth of a document
    count as one, and no piece starts past its 16 millionth word.
    """
    rows = keyed(docs, id_column, text_column, bits=63 - LINE_BITS)
    gone = small_side(repeated(rows, **how))
    schema = (
        "key long, id long, n_paragraphs long, n_removed long, removed array<int>, "
        "kept_sha256 string, kept string"
    )
    return rows.join(gone, "key", "left").select("key", "id", "text", *_GONE).mapInArrow(_without, schema)


def with_kept_text(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chars_column: str = "n_chars", **how
) -> DataFrame:
    """All rows and columns of `docs`, with the text that stays and its length."""
    rows = keyed_rows(docs, id_column, text_column, bits=63 - LINE_BITS)
    gone = small_side(repeated(rows, **how))
    shortened = small_side(stage(
        rows.select("key", "text").join(gone, "key").mapInArrow(_shortened, "key long, kept string"), "shortened"
    )).withColumn("is_shortened", F.lit(True))
    text = F.when(F.col("is_shortened"), F.col("kept")).otherwise(F.col("text"))
    changed = {text_column: text}
    if chars_column in docs.columns:
        changed[chars_column] = F.when(F.col("is_shortened"), F.char_length(text).cast(
            docs.schema[chars_column].dataType
        )).otherwise(F.col(f"row.{chars_column}"))
    return rows.join(shortened, "key", "left").select(
        *[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
