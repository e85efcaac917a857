"""Runs of words that repeat with a period, found by internal pattern matching.

The words of a document are numbered, and blocks of 1, 2, 4, ... words get names by
prefix doubling; the last names are the suffix array. A run of period q holds, within
its first q words, a block of 2^k words at a multiple of 2^k, with 2^k about a quarter
to a half of q, and the same block again q words on. So each such block asks for its
own occurrences in the window of neighbouring places its level stands for. The
occurrences of a block are a range of the suffix array, and a wavelet tree over that
array answers by range successor: how many lie in the window, and which is the first,
the second. Three or more in a window as long as the block form an arithmetic
progression, whose two ends settle the candidate periods without listing it. A
candidate is widened to both sides by the block names and kept if it is long enough.

Documents are worked on many at a time inside a task: names never cross documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
# Words worked on together; a longer document is worked on alone.
CHUNK_WORDS = 1 << 17

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class WaveletTree:
    """Counts and order statistics over ranges of an array of numbers 0..n-1, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.top = len(values)
        self.bits = range(self.top.bit_length() - 1, -1, -1)
        self.zeros = []
        for bit in self.bits:
            one = (values >> bit) & 1 == 1
            before = np.zeros(self.top + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def below(self, low, high, limit) -> np.ndarray:
        """How many values of [low, high) are smaller than `limit`."""
        limit = np.minimum(limit, self.top)
        count = np.zeros(len(low), np.int64)
        for bit, zeros in zip(self.bits, self.zeros):
            z_low, z_high = zeros[low], zeros[high]
            one = (limit >> bit) & 1 == 1
            count += np.where(one, z_high - z_low, 0)
            low = np.where(one, zeros[-1] + low - z_low, z_low)
            high = np.where(one, zeros[-1] + high - z_high, z_high)
        return count

    def nth(self, low, high, n) -> np.ndarray:
        """The value of [low, high) that has n smaller ones there."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros in zip(self.bits, self.zeros):
            z_low, z_high = zeros[low], zeros[high]
            one = n >= z_high - z_low
            n = np.where(one, n - (z_high - z_low), n)
            value += one.astype(np.int64) << bit
            low = np.where(one, zeros[-1] + low - z_low, z_low)
            high = np.where(one, zeros[-1] + high - z_high, z_high)
        return value


class BlockNames:
    """Names of the blocks of 2^k words at every place, and the suffix array.

    Equal names of a level mean equal blocks of one document. A name is the place of
    the first suffix that starts with the block, so a block's occurrences are a range
    of the suffix array. Only names that several places share are refined.
    """

    def __init__(self, words: np.ndarray, document: np.ndarray):
        n = len(words)
        key = document * (int(words.max()) + 1 if n else 1) + words
        order = np.argsort(key, kind="stable")
        self.levels: list[np.ndarray] = []
        name = np.full(n + 1, -1, np.int32)
        slots, parts = np.arange(n), key[order]
        moved = order
        step = 1
        while True:
            first = np.ones(len(slots), bool)
            first[1:] = parts[1:] != parts[:-1]
            start = np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))
            name[moved] = slots[start]
            order[slots] = moved
            alone = first.copy()
            alone[:-1] &= first[1:]
            if alone.all():
                break
            self.levels.append(name.copy())
            slots, moved = slots[~alone], moved[~alone]
            there = np.minimum(moved + step, n)
            inside = (there < n) & (document[np.minimum(there, n - 1)] == document[moved])
            parts = name[moved].astype(np.int64) * (n + 1) + np.where(inside, name[there], -1) + 1
            sort = np.argsort(parts, kind="stable")
            parts, moved = parts[sort], moved[sort]
            step *= 2
        self.suffixes = order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on (i < j)."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][at] == self.levels[k][to]
            at += same << k
            to += same << k
        return at - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and before j (i < j)."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            same = (at >= step) & (self.levels[k][at - step] == self.levels[k][to - step])
            at -= same << k
            to -= same << k
        return i - at


def _progressions(names: BlockNames, block, first, second, count):
    """Candidate periods of blocks that occur `count` times, first, second and so on.

    The occurrences lie in one stretch of period second - first, and so does the
    block itself. If that is the same stretch, it has the smaller period. Otherwise a
    longer period moves one stretch to the other, so it moves its start or its end;
    only where the two touch can it move the block anywhere between.
    """
    step = second - first
    own = block - names.behind(block, block + step), block + step + names.ahead(block, block + step)
    far = first - names.behind(first, first + step), first + step + names.ahead(first, first + step)
    other = own[0] != far[0]
    found = [], []
    for period in (far[0] - own[0], far[1] - own[1]):
        shift = period - (first - block)
        fits = other & (shift >= 0) & (shift % step == 0) & (shift // step < count)
        found[0].append(block[fits])
        found[1].append(period[fits])
    touch = other & (far[0] <= own[1])
    times = count[touch]
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    found[0].append(np.repeat(block[touch], times))
    found[1].append(np.repeat(first[touch] - block[touch], times) + turn * np.repeat(step[touch], times))
    return np.concatenate(found[0]), np.concatenate(found[1])


def _candidates(names: BlockNames, tree: WaveletTree, level: int, least: int):
    """(block, period) that the blocks of 2^level words give."""
    n, size = len(names.suffixes), 1 << level
    # Every stretch of `least` words holds a block of two words, and of q words one of (q+1)/2 or less.
    nearest = 1 if level == 1 else 2 * size - 1
    furthest = max(least, 4 * size - 2) if level == 1 else 4 * size - 2
    block = np.arange(0, n, size)
    low = names.levels[level][block].astype(np.int64)
    held = np.bincount(names.levels[level][:n], minlength=n)[low]
    block, low, held = block[held > 1], low[held > 1], held[held > 1]
    high = low + held
    before = tree.below(low, high, block + nearest)
    some = tree.below(low, high, block + furthest + 1) > before
    block, low, high, before = block[some], low[some], high[some], before[some]
    out = []
    for edge in range(nearest, furthest + 1, size):
        after = tree.below(low, high, block + min(edge + size, furthest + 1))
        count = after - before
        hit = count > 0
        b, lo, hi, c = block[hit], low[hit], high[hit], count[hit]
        first = tree.nth(lo, hi, before[hit])
        more = c > 1
        second = first.copy()
        second[more] = tree.nth(lo[more], hi[more], before[hit][more] + 1)
        many = c > 2
        out.append((b[~many], (first - b)[~many]))
        two = more & ~many
        out.append((b[two], (second - b)[two]))
        if many.any():
            out.append(_progressions(names, b[many], first[many], second[many], c[many]))
        before = after
    return np.concatenate([b for b, _ in out]), np.concatenate([q for _, q in out])


def runs_of(words: np.ndarray, document: np.ndarray, min_words: int = MIN_WORDS):
    """(start, end, period) of all runs, by start and period.

    `words` are numbers of words and `document` ascending numbers of the documents
    they belong to. A run has at least max(min_words, 2 * period) words, and
    `min_words` at least 6.
    """
    if min_words < 6:
        raise ValueError("min_words must be 6 or more: blocks have two words at least")
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    names = BlockNames(words, document)
    if len(names.levels) < 2:
        return none, none, none
    tree = WaveletTree(names.suffixes)
    # A run of a period up to min_words / 2 leaves so many places for the start of its first block.
    least = max(6, (min_words + 1) // 2)
    found = [_candidates(names, tree, k, least) for k in range(1, len(names.levels))]
    block = np.concatenate([b for b, _ in found])
    period = np.concatenate([q for _, q in found])
    start = block - names.behind(block, block + period)
    end = block + period + names.ahead(block, block + period)
    enough = end - start >= np.maximum(min_words, 2 * period)
    start, end, period = start[enough], end[enough], period[enough]
    # A multiple of the smallest period reaches equally far.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _settle(held: list[list[bytes]], min_words: int, with_text: bool):
    """Columns n_words, runs, n_dropped and collapsed of the documents given as lists of words."""
    sizes = np.array([len(w) for w in held], np.int64)
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(held)), np.int64, int(sizes.sum()))
    start, end, period = runs_of(words, np.repeat(np.arange(len(held)), sizes), min_words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    stays = np.cumsum(change)[:-1] == 0
    begins = np.cumsum(sizes) - sizes
    cuts = np.append(np.searchsorted(start, begins), len(start)).astype(np.int32)
    fields = [start - np.repeat(begins, np.diff(cuts)), end - start, period]
    runs = pa.ListArray.from_arrays(
        pa.array(cuts), pa.StructArray.from_arrays([pa.array(f) for f in fields], ["start", "length", "period"])
    )
    dropped, texts = [], []
    for ws, at, some in zip(held, begins, np.diff(cuts) > 0):
        kept = stays[at:at + len(ws)] if some else None
        dropped.append(len(ws) - int(kept.sum()) if some else 0)
        if with_text:
            texts.append(b" ".join(compress(ws, kept.tolist()) if some else ws))
    text = pa.array(texts, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(held), pa.string())
    return [pa.array(sizes), runs, pa.array(dropped, pa.int64()), text]


def _finder(min_words: int, with_text: bool, chunk_words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            held, words, begin = [], 0, 0
            for i in range(batch.num_rows):
                # bytes.split() parts at exactly the six white-space bytes.
                held.append((texts[i].as_py() or b"").split())
                words += len(held[-1])
                if words >= chunk_words or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, len(held)), *_settle(held, min_words, with_text)],
                        names=["id", "n_words", "runs", "n_dropped", "collapsed"],
                    )
                    held, words, begin = [], 0, i + 1

    return run


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, min_words: int = MIN_WORDS,
    with_text: bool = True, chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """(id, n_words, runs, n_dropped, collapsed) of every document.

    Words are stretches without ASCII white space. `runs` holds start, length and
    period of every maximal stretch of at least max(min_words, 2 * period) words in which
    words one period apart are equal and no smaller period does, by start and then
    period. `collapsed` is the text of the words that no run contains after its first
    period, joined by one space (NULL unless `with_text`).

    Every row gives one row, whatever its id: ids may be NULL or repeated, as
    documents never meet. A NULL or empty text has no words, no runs and an empty
    collapsed text. Other columns are ignored. An empty table gives no rows. There is no
    shuffle; memory grows with the longest single document.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(
        _finder(min_words, with_text, chunk_words),
        f"id bigint, n_words bigint, runs {RUNS}, n_dropped bigint, collapsed string",
    )


def run_columns(found: DataFrame) -> DataFrame:
    """periodic_runs() with the number of runs, the longest one and digests in place of lists and text."""
    # Longest first; ties go to the smaller start, then the smaller period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")
    ))
    return found.withColumn("best", best).select(
        "id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words", "n_dropped",
    )


def _looped(batches):
    for batch in batches:
        texts = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            h = zlib.crc32(str(key).encode()) if key is not None else 1
            if h % 10 == 0 and text:
                words = text.split()
                n, g = len(words), h // 10
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    turns = -(-(n - a) // p)
                    text = b" ".join(words[:a] + (words[a:a + p] * turns)[: n - a])
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"]
        )


def with_looped_tails(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text): about a tenth of the documents, chosen by id, end in a repeated stretch.

    With h = crc32 of the decimal id, g = floor(h / 10): if h % 10 is 0, each of the n words
    from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    A NULL id changes nothing.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_looped, "doc_id bigint, text string")
