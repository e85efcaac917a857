"""Document quality by a factorisation machine over words and structure.

Features are hashed words (log counts, scaled to unit length) and statistics of
the text's make-up: lengths, shares of letters, digits and marks, repetition.
They come from the text alone. Pairs of features interact through vectors of RANK
numbers, and all pairs are summed in linear time, as half of the square of the sum
less the sum of squares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse.llm import kernels as K

BUCKETS = 4096
RANK = 8
# Labelled rows that the model is fitted on, taken in the order of a hash of the id.
SAMPLE = 4000
EPOCHS = 80
_MARKS = b"!#$%&*|,.:;-_/'\"()<>@=+?[]{}^~`\\"
_DOCS = 256


def _table(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_KINDS = [
    _table(range(65, 91)), _table(range(97, 123)), _table(range(48, 58)), _table(b" "), _table(b"\n"),
    _table(range(128, 256)), _table(_MARKS), *(_table([c]) for c in _MARKS),
]
_KIND_TABLE = np.stack([*_KINDS, _table(b"aeiouAEIOU")], axis=1).astype(np.float64)
STATS = _KIND_TABLE.shape[1] + 7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, BUCKETS) word weights and (documents, STATS) statistics."""
    n = len(offsets) - 1
    start, end, doc = K.words(data, offsets)
    hashed = K.word_hash(data, start, end)
    bucket = (hashed >> np.uint64(52)).astype(np.int64)
    counts = np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    n_words = np.bincount(doc, minlength=n)
    length = np.diff(offsets)
    width = (end - start).astype(np.float64)
    mean = np.bincount(doc, width, n) / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, width**2, n) / np.maximum(n_words, 1) - mean**2, 0))
    told = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (hashed >> np.uint64(16)))
    distinct = np.bincount((told[K.groups(told)] >> np.uint64(48)).astype(np.int64), minlength=n)
    most = counts.max(axis=1) if n else np.zeros(0)
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    marked = np.bincount(doc, _KINDS[6][last], n) / np.maximum(n_words, 1)
    at = np.repeat(np.arange(0, 256 * n, 256), length)
    seen = np.bincount(at + data, minlength=256 * n).reshape(n, 256)
    shares = (seen @ _KIND_TABLE) / np.maximum(length, 1)[:, None]
    columns = [
        *shares.T, np.log1p(length), np.log1p(n_words), mean, spread,
        distinct / np.maximum(n_words, 1), most / np.maximum(n_words, 1), marked,
    ]
    weights = np.zeros(counts.shape, np.float32)
    some = counts.nonzero()
    weights[some] = np.log1p(counts[some])
    weights /= np.maximum(np.sqrt((weights**2).sum(axis=1, keepdims=True)), 1e-6)
    return weights, np.stack(columns, axis=1).astype(np.float32)


def _blocks(column):
    data, offsets = K.flat(column)
    for first, stop in K.blocks(offsets):
        for lo in range(first, stop, _DOCS):
            hi = min(lo + _DOCS, stop)
            cut = offsets[lo : hi + 1]
            yield lo, hi, features(data[cut[0] : cut[-1]], cut - cut[0])


class Machine:
    """Weights of the machine and of the scaling of its statistics."""

    def __init__(self, bias, linear, factors, centre, scale):
        self.bias, self.linear, self.factors = bias, linear, factors
        self.centre, self.scale = centre, scale

    def _design(self, words, stats):
        return np.concatenate([words, self._scaled(stats)], axis=1)

    def _scaled(self, stats):
        return np.clip((stats - self.centre) / self.scale, -3, 3) / np.float32(np.sqrt(STATS))

    def score(self, words, stats) -> np.ndarray:
        x = self._design(words, stats)
        both = x @ self.factors
        pairs = 0.5 * ((both**2).sum(1) - ((x**2) @ (self.factors**2)).sum(1))
        z = self.bias + x @ self.linear + pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, x, labels, epochs: int = EPOCHS, seed: int = 5) -> Machine:
        """Full-batch logistic loss by adaptive moments; the same input gives the same weights.

        `x` has word weights and then statistics, which are scaled in place.
        """
        stats = x[:, BUCKETS:].copy()
        width = BUCKETS + STATS
        rng = np.random.default_rng(seed)
        share = (labels.sum() + 1) / (len(labels) + 2)
        model = cls(
            np.float32(np.log(share / (1 - share))), np.zeros(width, np.float32),
            rng.normal(0, 0.05, (width, RANK)).astype(np.float32),
            stats.mean(0) if len(stats) else np.zeros(STATS, np.float32),
            np.maximum(stats.std(0), 1e-4) if len(stats) else np.ones(STATS, np.float32),
        )
        if not len(labels):
            model.factors[:] = 0
            return model
        x[:, BUCKETS:] = model._scaled(stats)
        squares = x**2
        state = [np.zeros_like(p) for p in (model.linear, model.factors) for _ in range(2)]
        bias_state = [0.0, 0.0]
        for step in range(1, epochs + 1):
            both = x @ model.factors
            z = model.bias + x @ model.linear + 0.5 * ((both**2).sum(1) - (squares @ model.factors**2).sum(1))
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)).astype(np.float32)
            slopes = (
                x.T @ error + 1e-5 * model.linear,
                x.T @ (error[:, None] * both) - (squares.T @ error)[:, None] * model.factors
                + 1e-5 * model.factors,
            )
            for k, (weights, slope) in enumerate(zip((model.linear, model.factors), slopes)):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (slope - m)
                v += 0.001 * (slope**2 - v)
                weights -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            slope = float(error.sum())
            bias_state[0] += 0.1 * (slope - bias_state[0])
            bias_state[1] += 0.001 * (slope**2 - bias_state[1])
            model.bias -= np.float32(
                0.05 * (bias_state[0] / (1 - 0.9**step)) / (np.sqrt(bias_state[1] / (1 - 0.999**step)) + 1e-8)
            )
        return model


_FEATURES = "words binary, stats binary, label int"


def _featured(batches):
    for batch in batches:
        for lo, hi, (words, stats) in _blocks(batch.column(0)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.astype(np.float16).tobytes() for w in words], pa.binary()),
                 pa.array([s.tobytes() for s in stats], pa.binary()),
                 batch.column(1)[lo:hi].cast(pa.int32())],
                names=["words", "stats", "label"],
            )


def is_held_out(id_column) -> F.Column:
    """Rows kept from fitting: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    *, sample: int = SAMPLE,
) -> Machine:
    """Machine fitted on at most `sample` labelled rows that are not held out.

    Labels that are NULL, or contradict each other for an id, are left out. Without
    any label every text scores one half.
    """
    ident = F.col(id_column)
    known = (
        labels.select(ident.cast("bigint").alias("id"), F.col("quality").cast("int").alias("label"))
        .where("id is not null and label is not null").where(~is_held_out(F.col("id")))
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other").select("id", "label")
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    texts = docs.select(ident.cast("bigint").alias("id"), F.col(text_column).alias("text"))
    rows = texts.join(F.broadcast(known), "id").select("id", "text", "label")
    # An id may repeat in the documents; the bound holds for rows too.
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    found = rows.select("text", "label").mapInArrow(_featured, _FEATURES).collect()
    found = sorted(found, key=lambda r: (bytes(r["stats"]), bytes(r["words"]), r["label"]))
    n = len(found)
    x = np.empty((n, BUCKETS + STATS), np.float32)
    for k, row in enumerate(found):
        x[k, :BUCKETS] = np.frombuffer(row["words"], np.float16)
        x[k, BUCKETS:] = np.frombuffer(row["stats"], np.float32)
    truth = np.array([r["label"] for r in found], np.float32)
    del found
    return Machine.fit(x, truth)


def _scored(model: Machine):
    def run(batches):
        for batch in batches:
            columns = batch.columns[:-1]
            for lo, hi, (words, stats) in _blocks(batch.columns[-1]):
                score = np.round(model.score(words, stats).astype(np.float64), 5)
                yield pa.RecordBatch.from_arrays(
                    [*(c[lo:hi] for c in columns), pa.array(score)], names=[*batch.schema.names[:-1], "score"]
                )

    return run


def score_quality(docs: DataFrame, model: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row, from the whole text alone; NULL counts as empty.

    NULL and repeated ids are returned as they are, other columns are ignored, an
    empty table gives an empty result. Equal texts have equal scores.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_scored(model), "id long, score double")


def _appended(model: Machine, at: int, column: str):
    def run(batches):
        for batch in batches:
            for lo, hi, (words, stats) in _blocks(batch.column(at)):
                score = np.round(model.score(words, stats).astype(np.float64), 5)
                yield pa.RecordBatch.from_arrays(
                    [*(c[lo:hi] for c in batch.columns), pa.array(score)], names=[*batch.schema.names, column]
                )

    return run


def with_score(docs: DataFrame, model: Machine, column: str = "score", text_column: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with their score as a further column."""
    kept = docs.drop(column)
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())])
    return kept.mapInArrow(_appended(model, kept.columns.index(text_column), column), schema)
