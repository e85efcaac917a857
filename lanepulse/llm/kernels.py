"""Array helpers that run inside tasks: flat texts, rolling hashes, word spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
# Positions hashed at once: the arrays of a piece stay in the processor's cache.
PIECE = 1 << 19


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and offsets; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any bits of them can be used."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value times power; a span's hash is a difference of two."""
    up, _ = powers(values.shape[-1])
    out = np.zeros((*values.shape[:-1], values.shape[-1] + 1), np.uint64)
    np.cumsum(values * up, axis=-1, out=out[..., 1:])
    return out


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of the k bytes from each position on."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    sums = prefix_hash(BYTE_TABLE[data])
    _, down = powers(len(data))
    return mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over every run of `width` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span, y = 1, x
    while 2 * span <= width:
        y = op(y[:-span], y[span:])
        span *= 2
    if span < width:
        y = op(y[:n], y[width - span : width - span + n])
    return y[:n]


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def run_lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word: bytes between ASCII white space."""
    ink = ~_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[inner] = ink[inner]
    ends = inner[1:] - 1
    last[ends] = ink[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word with A-Z lowered, piece by piece."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base = start[lo]
        hi = max(lo + 1, int(np.searchsorted(end, base + PIECE, "right")))
        sums = prefix_hash(BYTE_TABLE[_LOWER[data[base : end[hi - 1]]]])
        a, b = start[lo:hi] - base, end[lo:hi] - base
        _, down = powers(int(b[-1]) + 1)
        out[lo:hi] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    return out


SET_BITS = 52
_BLOCK_DOCS = 1 << (64 - SET_BITS)
_BLOCK_BYTES = 1 << 22


def blocks(offsets: np.ndarray):
    """Runs of documents, few and short enough to be worked on together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + _BLOCK_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), lo + _BLOCK_DOCS, n)
        yield lo, hi
        lo = hi


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Blocks (lo, hi, values, doc): the distinct shingles of documents lo to hi.

    Values are 52-bit hashes in ascending order within a document. A document
    of fewer words than `size` has one shingle of all its words; one without
    words has none.
    """
    for lo, hi in blocks(offsets):
        cut = offsets[lo : hi + 1] - offsets[lo]
        text = data[offsets[lo] : offsets[hi]]
        start, end, doc = words(text, cut)
        hashes = word_hash(text, start, end)
        count = np.bincount(doc, minlength=hi - lo)
        head = np.concatenate([[0], np.cumsum(count)[:-1]])
        sums = prefix_hash(hashes)
        width = np.minimum(count, size)
        n_each = np.where(count > 0, count - width + 1, 0)
        of = np.repeat(np.arange(hi - lo), n_each)
        begin = np.concatenate([[0], np.cumsum(n_each)[:-1]])
        at = np.arange(len(of)) - begin[of] + head[of]
        _, down = powers(len(hashes) + 1)
        value = mix((sums[at + width[of]] - sums[at]) * down[at] + width[of].astype(np.uint64))
        value >>= np.uint64(64 - SET_BITS)
        key = np.sort((of.astype(np.uint64) << np.uint64(SET_BITS)) | value)
        key = key[groups(key)]
        yield lo, hi, key & np.uint64(2**SET_BITS - 1), (key >> np.uint64(SET_BITS)).astype(np.int64)
