"""Quality classifier: Bradley-Terry pairwise ranking.

Preference pairs join a document labelled 1 with one labelled 0; the model is linear in a vector of
text shares (the statistics of the quality rules, and how often each pair of neighbouring bytes with
a mark or blank in it occurs, hashed to ``BUCKETS``), fitted by Newton's method on the logistic loss
of the pairs' feature differences. The cut is a quantile of the fitted rows' scores: the one with the
best mean of both classes' accuracy, in the middle of its plateau; the score is moved so that this
quantile becomes ``THRESHOLD``.

The fit takes at most ``MAX_PER_CLASS`` labelled rows of each class (those with the least hash of
their id; a documented bound), and only these are brought to the driver, as vectors. Scoring is one
pass without a shuffle over every whole text.

Defined results: a null text is an empty text and gets the score of a text without any marks;
labels without a document, or null labels, teach nothing; without labels of both classes every
document scores ``THRESHOLD``; repeated rows are scored alike; an empty table gives an empty table;
``score`` replaces columns of the names that it adds, ``keep`` changes no column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import least_hashed, settle
from . import outliers
from . import textvec as tv

BUCKETS = 256
MAX_PER_CLASS, PAIRS_EACH, RIDGE, THRESHOLD = 8000, 6, 1.0, 0.7
SHARES = ["f_word_len", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_punct"]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float


def _is_mark() -> np.ndarray:
    t = np.zeros(256, bool)
    t[:128] = True
    t[48:58] = t[65:91] = t[97:123] = False
    return t


def vectors(b: tv.Batch) -> np.ndarray:
    """A row for each text: the shares, then the square roots of the byte pairs' shares."""
    n = len(b.offs) - 1
    s = outliers.statistics(b)
    out = np.zeros((n, len(SHARES) + BUCKETS), np.float32)
    for i, k in enumerate(SHARES):
        out[:, i] = s[k] / 1000
    if len(b.buf) > 1:
        mark = _is_mark()[b.buf]
        at = np.flatnonzero(mark[:-1] | mark[1:])
        at = at[~np.isin(at + 1, b.offs[1:-1])]
        # letters and digits count as one kind each, so that pairs are about form and not content
        kind = np.arange(256, dtype=np.uint32)
        kind[48:58], kind[65:91], kind[97:123], kind[128:] = 48, 65, 97, 97
        pair = tv.mix((kind[b.buf[at]] * 256 + kind[b.buf[at + 1]]).astype(np.uint64)) % np.uint64(BUCKETS)
        doc = tv.rows_at(b, at)
        got = np.bincount(doc * BUCKETS + pair.astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        size = np.maximum(np.diff(b.offs), 1)[:, None]
        out[:, len(SHARES) :] = np.sqrt(got / size)
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH) -> Model:
    """x: vectors, y: labels 0 and 1, in an order that does not depend on partitions."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = ((x - mean) / scale).astype(np.float64)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(7)
    each = pairs_each * max(len(good), len(bad))
    better, worse = rng.permutation(np.resize(good, each)), rng.permutation(np.resize(bad, each))
    w = np.zeros(z.shape[1])
    for _ in range(12):
        grad, h = -RIDGE * w, RIDGE * np.eye(len(w))
        for a in range(0, each, 4096):  # differences are made a block at a time: all of them are large
            d = z[better[a : a + 4096]] - z[worse[a : a + 4096]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the pair is ordered wrongly
            grad += d.T @ p
            h += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(h, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    levels = np.quantile(raw, np.linspace(0, 1, 2001))
    ordered = [np.sort(raw[good]), np.sort(raw[bad])]
    right = [1 - np.searchsorted(ordered[0], levels) / len(good), np.searchsorted(ordered[1], levels) / len(bad)]
    quality = right[0] + right[1]
    best = levels[quality >= quality.max() - 1e-9]
    # between the neighbouring rows on both sides of the plateau
    return Model(mean, scale, w, float((best[0] + best[-1]) / 2))


def training_rows(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    lab = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("_y")).withColumn("_h", F.xxhash64("doc_id"))
    sample = least_hashed(lab.where("_y = 0"), "_h", max_per_class).unionByName(least_hashed(lab.where("_y = 1"), "_h", max_per_class))
    # at most 2 * max_per_class rows of a few bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "_y", "text")
    size = len(SHARES) + BUCKETS

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tv.slices(batches):
            v = vectors(tv.from_arrow(rb.column("text")))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size * 4), len(v), [None, pa.py_buffer(np.ascontiguousarray(v).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("_y").cast(pa.int32()), flat], names=["doc_id", "y", "v"])

    got = rows.mapInArrow(run, "doc_id long, y int, v binary").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id").combine_chunks()
    x = tv.from_arrow(got.column("v")).buf.view(np.float32).reshape(-1, size)
    return x, got.column("y").to_numpy()


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those named) with score and predicted."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tv.slices(batches):
            if model is None:
                s = np.full(rb.num_rows, THRESHOLD)
            else:
                v = vectors(tv.from_arrow(rb.column("text")))
                raw = ((v - model.mean) / model.scale).astype(np.float64) @ model.weight - model.cut
                s = 1 / (1 + np.exp(-np.clip(raw, -30, 30)) * (1 - THRESHOLD) / THRESHOLD)
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    x, y = training_rows(docs, labels)
    model = fit(x, y) if len(set(y.tolist())) == 2 else None
    del x
    settle(docs.sparkSession)
    tv.give_back()
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    return score(docs, learn(docs, labels), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score the threshold or more, with their columns as they are."""
    safe, back = tv.guarded(docs, ("doc_id", "text"))
    return score(safe, learn(safe, labels)).where("predicted = 1").select(*back)
