"""Fingerprints of texts from prefix polynomial hashes.

With the prefix sums of code point times power of a base, modulo a prime, the hash of
any span is a difference of two sums times an inverse power. Equal spans are found by
one comparison and longest common extensions by binary search. A fingerprint holds the
length, the hash of the whole text and the SKETCH smallest hashes of its spans of SPAN
code points; the likeness of two is the share of spans in common that these show.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.llm import kernels as K
from lanepulse.llm.common import keyed, n_parts, text_bytes

PRIME = 2**31 - 1
BASES = (1_000_003_861, 1_640_531_527)
SPAN = 16
SKETCH = 64
RANGE_BYTES = 8 << 20
_BLOCK = 1 << 19
_P, _S = np.uint64(PRIME), np.uint64(31)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S)
    return (x & _P) + (x >> _S)


def _exact(x: np.ndarray) -> np.ndarray:
    x = _fold(x)
    return x - _P * (x >= _P)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, built by doubling."""
    up, down = _TABLES.get(base, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    while len(up) < n:
        size = len(up)
        step, back = pow(base, size, PRIME), pow(pow(base, -1, PRIME), size, PRIME)
        up = np.concatenate([up, _exact(up * np.uint64(step))])
        down = np.concatenate([down, _exact(down * np.uint64(back))])
    _TABLES[base] = up, down
    return up[:n], down[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix sums of one text for both bases."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        value = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base in BASES:
            up, _ = _powers(base, self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_fold(value * up[: self.n]), out=sums[1:])
            self.sums.append(_exact(sums))

    def spans(self, start, end):
        """Hashes of the spans [start, end), 62 bits each."""
        out = np.uint64(0)
        for base, sums in zip(BASES, self.sums):
            _, down = _powers(base, self.n + 1)
            out = (out << _S) | _exact((sums[end] + _P - sums[start]) * down[start])
        return out

    def extension(self, at: int, other: Prefixes, there: int) -> int:
        """Length of the longest common run from `at` here and `there` in the other."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.spans(at, at + middle) == other.spans(there, there + middle):
                low = middle
            else:
                high = middle - 1
        return low


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct values."""
    share = 3 * SKETCH / max(len(hashes), 1)
    while share < 0.5:
        some = np.unique(hashes[hashes < np.uint32(share * 2**32)])
        if len(some) >= SKETCH:
            return some[:SKETCH]
        share *= 4
    return np.unique(hashes)[:SKETCH]


def sketches(texts: list[str]) -> list[tuple[str, np.ndarray]]:
    """(whole-text part, span sketch) of each text; the texts are hashed together."""
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    table = Prefixes(code_points("".join(texts)))
    whole = table.spans(offsets[:-1], offsets[1:])
    n = int(offsets[-1])
    starts = np.arange(max(n - SPAN + 1, 0))
    spans = (K.mix(table.spans(starts, starts + SPAN)) >> np.uint64(32)).astype(np.uint32)
    out = []
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if b - a >= SPAN:
            low = _smallest(spans[a : b - SPAN + 1])
        elif b > a:
            low = (K.mix(whole[k : k + 1]) >> np.uint64(32)).astype(np.uint32)
        else:
            low = np.zeros(0, np.uint32)
        out.append((f"{b - a:x}.{int(whole[k]):016x}", low))
    return out


def text_of(part: tuple[str, np.ndarray]) -> str:
    return f"{part[0]}.{base64.b64encode(part[1].astype('<u4').tobytes()).decode()}"


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    """1 for equal fingerprints, else twice the common spans over all, as the sketches show."""
    if a[0] == b[0]:
        return 1.0
    x, y = a[1], b[1]
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)
    # Past the largest value of a full sketch it says nothing about the text.
    limit = min(s[-1] if len(s) == SKETCH else np.uint32(2**32 - 1) for s in (x, y))
    union = union[union <= limit]
    both = len(np.intersect1d(x, y)) if not len(union) else int(
        np.count_nonzero(np.isin(union, x) & np.isin(union, y))
    )
    share = both / max(len(union), 1)
    return min(2 * share / (1 + share), 1.0)


def parse(fingerprint: str) -> tuple[str, np.ndarray]:
    head, _, tail = fingerprint.rpartition(".")
    return head, np.frombuffer(base64.b64decode(tail), "<u4")


def edited(text: str, other: str) -> str:
    """The last half of `text` replaced by as much of `other`, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_ROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n_chars", pa.int64()),
                  ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                  ("near_next", pa.float64()), ("same_start_next", pa.int64())])


def _rows(run: list[tuple], following: tuple):
    """Fingerprint rows of consecutive documents; `following` comes after the last."""
    texts = [t for *_, t in run] + [following[2]]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own, other = sketches(texts), sketches(changed)
    rows = [[] for _ in _ROW]
    before = Prefixes(code_points(texts[0]))
    for k, (key, ident, text) in enumerate(run):
        after = Prefixes(code_points(texts[k + 1]))
        values = (
            key, ident, len(text), hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest(),
            text_of(own[k]), text_of(other[k]), likeness(own[k], other[k]), likeness(own[k], own[k + 1]),
            before.extension(0, after, 0),
        )
        before = after
        for row, value in zip(rows, values):
            row.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ROW)], schema=_ROW)


def _stream(batches):
    """Rows in order of (range, key); the last of each range is there for its neighbour alone."""
    run, size = [], 0
    for batch in batches:
        names = ("range", "key", "id", "text", "borrowed")
        for part, key, ident, text, borrowed in zip(*(batch.column(n) for n in names)):
            row = (key.as_py(), ident.as_py(), text.as_py() or "")
            if run and (borrowed.as_py() or size >= _BLOCK):
                yield _rows(run, row)
                run, size = [], 0
            if not borrowed.as_py():
                run.append(row)
                size += len(row[2])


def fingerprint(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Fingerprints of each text and of its edit with the next one, and their likeness.

    Returns key, id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and same_start_next (code points that both start with).
    The next document is that of the next id, after the last the first; a single
    document follows itself. NULL counts as empty. Rows that share an id follow in
    the order of their text, NULL ids first; other columns are ignored; an empty
    table gives an empty result. Ranges of keys are cut by size, and the first row
    of a range is lent to the one before.
    """
    rows = keyed(docs, id_column, text_column)
    wanted = n_parts(text_bytes(rows), range_bytes)
    if wanted > 1:
        shares = [k / wanted for k in range(1, wanted)]
        cuts = sorted(set(rows.agg(F.percentile_approx("key", shares, 10 * wanted)).first()[0] or []))
    else:
        cuts = []
    spark = rows.sparkSession
    # Ranges are as many as cuts plus one, a number set by range_bytes.
    bounds = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    ranged = rows.withColumn("range", F.size(F.filter(bounds, lambda c: c < F.col("key"))))
    heads = sorted(
        (r["range"], r["key"]) for r in ranged.groupBy("range").agg(F.min("key").alias("key")).collect()
    )
    if not heads:
        return spark.createDataFrame([], _SCHEMA)
    lent = [(heads[k][1], heads[k - 1][0]) for k in range(len(heads))]
    lent = F.broadcast(spark.createDataFrame(lent, "key long, lender int"))
    home = F.struct(F.col("range"), F.lit(False).alias("borrowed"))
    away = F.struct(F.col("lender").alias("range"), F.lit(True).alias("borrowed"))
    places = F.when(F.col("lender").isNull(), F.array(home)).otherwise(F.array(home, away))
    both = ranged.join(lent, "key", "left").withColumn("to", F.explode(places)).select(
        "to.range", "to.borrowed", "key", "id", "text"
    )
    placed = both.repartition(n_parts(len(heads), 2), "range").sortWithinPartitions("range", "borrowed", "key")
    return placed.mapInArrow(_stream, _SCHEMA)


_SCHEMA = (
    "key long, id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, same_start_next long"
)
