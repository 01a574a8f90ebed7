"""Quality classifier on random-indexing word vectors.

Every word has a fixed sparse index vector (two entries of +1 or -1, from its hash). A word's context vector is
the sum of the index vectors of its neighbours over all documents. Vectors are hashed: words share ``SLOTS`` slots,
at any real vocabulary many words one, in which the commonest tells most, and each word has a second slot for its
shape (capitals, first and last characters, length). So the vectors have a fixed size whatever the vocabulary. A document is the mean and deviation of its words' vectors; a two-layer network
gives a logit, and a temperature fitted on rows set aside turns it into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import SAMPLE, is_held_out, training_rows
from .shared import merged_counters, small_batches, unused
from .text import Chunk, chunks, mix, words

SLOTS = 1 << 14
SHAPES = 1 << 10
DIM = 48
REACH = 2  # neighbours on each side
HIDDEN = 32

_KIND = np.full(256, 3, np.uint64)  # other
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 2


def _slots(c: Chunk):
    """Words, and each one's slot and shape slot."""
    w = words(c, lower=False)
    slot = (w.hash % np.uint64(SLOTS)).astype(np.int64)
    if not len(w.start):
        return w, slot, slot
    kind = _KIND[c.buf]
    first, last, second = kind[w.start], c.buf[w.end - 1].astype(np.uint64), c.buf[np.maximum(w.end - 2, w.start)].astype(np.uint64)
    last = np.where((_KIND[c.buf[w.end - 1]] == 2) | (_KIND[c.buf[w.end - 1]] == 1), _KIND[c.buf[w.end - 1]], last)
    second = np.where(_KIND[second.astype(np.int64)] <= 2, np.uint64(0), second)
    caps = np.concatenate([[0], np.cumsum(kind == 1)])
    shape = first + (last << np.uint64(4)) + (second << np.uint64(12)) + (np.minimum(3, caps[w.end] - caps[w.start]).astype(np.uint64) << np.uint64(20)) + (np.minimum(15, (w.end - w.start) // 4).astype(np.uint64) << np.uint64(22))
    return w, slot, SLOTS + (mix(shape + np.uint64(7)) % np.uint64(SHAPES)).astype(np.int64)


def context_vectors(texts: DataFrame) -> np.ndarray:
    """Context vectors of all slots over all texts, centred and scaled to unit length."""
    rows = SLOTS + SHAPES

    def count(batches):
        total = np.zeros(rows * DIM, np.int64)
        for b in batches:
            for c in chunks(b.column(0)):
                w, slot, shape = _slots(c)
                h = mix(w.hash + np.uint64(99))
                places = [((h >> np.uint64(8 * k)) % np.uint64(DIM)).astype(np.int64) for k in (0, 1)]
                signs = [1 - 2 * ((h >> np.uint64(40 + k)) & np.uint64(1)).astype(np.int64) for k in (0, 1)]
                at, plus = [], []
                for step in range(1, REACH + 1):
                    if len(slot) <= step:
                        continue
                    same = w.doc[step:] == w.doc[:-step]
                    for mid, side in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                        for p, s in zip(places, signs, strict=True):
                            for own in (slot, shape):
                                at.append((own[mid] * DIM + p[side])[same])
                                plus.append(s[side][same])
                if at:
                    at, plus = np.concatenate(at), np.concatenate(plus)
                    total += np.bincount(at[plus > 0], minlength=len(total)) - np.bincount(at[plus < 0], minlength=len(total))
        return np.clip(total, -(2**31) + 1, 2**31 - 1).astype(np.int32)

    v = merged_counters(texts, count, rows * DIM, np.int32).reshape(rows, DIM).astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v -= v.mean(axis=0)
    return v.astype(np.float32)


def pooled(c: Chunk, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of word and shape vectors for each text of a chunk, and the logarithm of its words."""
    w, slot, shape = _slots(c)
    n = len(w.first) - 1
    out = np.zeros((n, 4 * DIM + 1), np.float32)
    count = np.diff(w.first)
    some = np.flatnonzero(count)
    for k, s in enumerate((slot, shape)):
        for lo in range(0, len(some), 64):  # few texts at a time: the gathered vectors are large
            part = some[lo : lo + 64]
            a, z = w.first[part[0]], w.first[part[-1] + 1]
            x = vectors[s[a:z]]
            at = w.first[part] - a
            size = count[part][:, None]
            mean = np.add.reduceat(x, at, axis=0) / size
            square = np.add.reduceat(x * x, at, axis=0) / size
            out[part, k * 2 * DIM : k * 2 * DIM + DIM] = mean
            out[part, k * 2 * DIM + DIM : (k + 1) * 2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[:, -1] = np.log1p(count)
    return out


class Network:
    """A two-layer network with a calibrated output, fitted by Adam on whole batches."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = 300, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.prior, self.temperature = (float(y.mean()) if len(y) else 0.5), 1.0
        self.ready = len(y) >= 8 and 0 < y.sum() < len(y)
        if not self.ready:
            return
        self.mid, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mid) / self.scale
        order = rng.permutation(len(y))
        cut = max(4, len(y) // 5)
        tune, fit = order[:cut], order[cut:]
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, steps + 1):
            h = np.tanh(x[fit] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[fit]) / len(fit)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[fit].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum()]
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        z, t = self._logit(x[tune]), y[tune]
        losses = {s: np.logaddexp(0, np.where(t == 1, -z, z) / s).mean() for s in np.geomspace(0.25, 8, 40)}
        self.temperature = min(losses, key=losses.get)

    def _logit(self, x):
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mid) / self.scale) / self.temperature, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, buckets: int = 5, held_out: int = 0, threshold: float = 0.3, sample: int = SAMPLE, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``held_out, score, predicted``; earlier columns of these names are replaced.

    ``score`` is the probability of label 1. Null and empty texts are scored as texts without words. With fewer
    than eight labelled rows or with one label only, every score is that label's share (0.5 without labels). A
    null id is kept and not held out; repeated rows each get their score. Very long texts are read whole, one at a
    time. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vectors = spark.sparkContext.broadcast(context_vectors(docs.select(F.col(text_col).cast("string").alias("text"))))

    def features(batches):
        for b in batches:
            for c in chunks(b.column("text")):
                f = pooled(c, vectors.value)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(c.lo, c.hi - c.lo).cast(pa.string()), b.column("y").slice(c.lo, c.hi - c.lo), pa.array([x.tobytes() for x in f], pa.binary())], ["id", "y", "x"])

    train = training_rows(docs, labels, label, buckets, held_out, sample, id_col, text_col).mapInArrow(features, "id string, y int, x binary").collect()
    train.sort(key=lambda r: r["id"])
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in train]).astype(np.float64) if train else np.zeros((0, 4 * DIM + 1))
    net = spark.sparkContext.broadcast(Network(x, np.array([r["y"] for r in train], np.float64)))
    keep = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    text = unused(docs, "text_")
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias(text))

    def score(batches):
        for b in batches:
            p = [net.value.probability(pooled(c, vectors.value)) for c in chunks(b.column(text))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate(p) if p else [], pa.float64())], [*keep, "score"])

    out = source.mapInArrow(score, T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())]))
    return out.select(*(F.col(f"`{c}`") for c in keep), is_held_out(F.col(id_col), buckets, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
