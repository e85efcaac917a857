"""Documents packed into fixed sequences: first-fit decreasing on a tournament tree.

Each document is tokenised once and cut into full pieces and a rest. Documents are
dealt into random groups of bounded size; within a group pieces go, longest first,
into the first sequence with room, which the tree of free room finds in log time.
"""

from __future__ import annotations

import os
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanepulse.staging import stage

SEQUENCE = 2048
END = 1
GROUP_PIECES = 4096
CACHED_WORDS = 400_000
LONGEST_CACHED = 48
_BLOCK = 1 << 20

_PIECES = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


# How byte-level tokenizers write a byte: printable ones as their character, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHARACTER = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
# Texts whose ids show whether a tokenizer does what the look-up of words takes for granted.
_PROBES = ["One", "two", "\u00c9t\u00e9", "stra\u00dfe", "\u03b1\u03b2\u03b3", "it's", "x.", "a-b,", "9z", "\u4e2d\u6587"]


class Encoder:
    """Token ids as little-endian 32-bit bytes; words seen before are looked up.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its chunks between spaces and line ends. Only these four characters
    cut: every engine agrees on them. It also parts letters from marks and lowers
    all letters, so a word's forms share one entry. The first CACHED_WORDS forms
    are kept, which the frequent ones are among. Words of letters alone go to the vocabulary's
    merges at once, past normaliser and splitter, where that gives the same ids. A tokenizer
    that does not keep to this is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        alone = self._ids(_PROBES)
        together = self._ids([" " + " \n\t".join(_PROBES) + "\r ", " ".join(_PROBES).lower()])
        if {b"".join(alone)} != set(together):
            raise ValueError(f"{path} does not drop white space and letter case")
        words = [(w.lower(), ids) for w, ids in zip(_PROBES, alone) if w.isalpha()]
        self.direct = self._letter_ids([w for w, _ in words]) == [ids for _, ids in words]
        self.seen: dict[str, bytes] = dict(zip("., ", self._ids([".", ",", " "])))

    def _ids(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _letter_ids(self, words: list[str]) -> list[bytes]:
        """Ids of composed lower-case words of letters."""
        tokenize = self.model.tokenize
        written = (
            w if w.isascii() else w.encode().decode("latin-1").translate(_AS_CHARACTER) for w in words
        )
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in written]

    def _learn(self, new: set[str]) -> list[str]:
        seen, forms, unknown, words = self.seen, [], [], set()
        for chunk in new:
            mark = chunk[-1:] if chunk[-1:] in (".", ",") else ""
            stem = chunk[: len(chunk) - len(mark)]
            if stem.isalpha() and "\u03a3" not in stem and "\u0130" not in stem:
                low = stem.lower()
                forms.append((chunk, low, mark))
                if low not in seen:
                    words.add(low)
            else:
                unknown.append(chunk)
        if not self.direct:
            unknown += words
            words = set()
        odd = {w for w in words if not (w.isascii() or w.isalpha() and is_normalized("NFC", w))}
        words, unknown = list(words - odd), list({*unknown, *odd})
        seen.update(zip(unknown, self._ids(unknown)))
        seen.update(zip(words, self._letter_ids(words)))
        unknown += words
        for chunk, low, mark in forms:
            seen[chunk] = seen[low] + seen[mark] if mark else seen[low]
        return [c for c, _, _ in forms] + unknown

    def encode(self, texts: list[str]):
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        room = max(0, CACHED_WORDS - len(self.seen))
        new = self._learn(set().union(*split) - self.seen.keys())
        for chunks in split:
            yield b"".join(map(self.seen.__getitem__, chunks))
        for k, chunk in enumerate(new):
            if k >= room or len(chunk) > LONGEST_CACHED:
                self.seen.pop(chunk, None)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that later tasks find the words of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _tokenised(path: str, length: int, end: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()

    def blocks(batch):
        ids, keys, texts, size = batch.column("id"), batch.column("key"), batch.column("text"), 0
        part = []
        for key, ident, text in zip(keys, ids, texts):
            text = text.as_py() or ""
            part.append((key.as_py(), ident.as_py(), text))
            size += len(text)
            if size >= _BLOCK:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches):
        words = encoder(path)
        for batch in batches:
            for part in blocks(batch):
                rows = [[] for _ in _PIECES]
                for (key, ident, _), raw in zip(part, words.encode([t for _, _, t in part])):
                    raw += tail
                    total = len(raw) // 4
                    for start in range(0, total, length):
                        piece = raw[4 * start : 4 * (start + length)]
                        values = (key, ident, start, len(piece) // 4, zlib.crc32(piece), total,
                                  piece if with_ids else None)
                        for row, value in zip(rows, values):
                            row.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(rows, _PIECES)], schema=_PIECES
                )

    return run


def first_fit(sizes, capacity: int) -> list[int]:
    """Bin of each size, taken in the given order; bins are opened from the left.

    The tree holds at each node the largest free room below it, so the first bin
    with room is found by going left whenever the left side has enough.
    """
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    placed = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        placed.append(node - leaves)
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
    return placed


def _group(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "key", "start"], ascending=[False, True, True])
        local = first_fit(pieces["length"].tolist(), capacity)
        pieces["sequence_id"] = pieces["pack"].astype("int64") * 2**24 + local
        pieces["offset"] = pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"]
        return pieces.drop(columns="pack")

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", *,
    length: int = SEQUENCE, end: int = END, with_ids: bool = True, seed: int = 0,
) -> DataFrame:
    """One row per piece: key, id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    `tokenizer` is the path of the vocabulary file, the same on every machine. `ids`
    are little-endian 32-bit, NULL unless asked for. NULL and empty texts have the
    end id alone. Rows that share an id are documents of their own; NULL ids stay
    NULL. Other columns are ignored; an empty table gives an empty result.
    """
    # The key only has to be unique: it is written with the pieces and then read.
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_column).cast("bigint").alias("id"),
        F.col(text_column).alias("text"),
    )
    schema = "key long, id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = stage(rows.mapInArrow(_tokenised(tokenizer, length, end, with_ids), schema), "pieces")
    # A long document has many pieces, so groups are of pieces, by document and place.
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    place = F.xxhash64("key", F.floor(F.col("start") / F.lit(length * 64)), F.lit(seed))
    narrow = pieces.select("key", "start", "length", F.pmod(place, F.lit(groups)).alias("pack"))
    placed = narrow.groupBy("pack").applyInPandas(
        _group(length), "key long, start long, length long, sequence_id long, offset long"
    )
    return pieces.join(placed.drop("length"), ["key", "start"])
