"""Quality by positive-unlabelled learning.

A small network on whole-text statistics minimises the non-negative unbiased risk: trusted positives against unlabelled web
text, with the class prior estimated from both. Negative labels are never shown to it. Statistics are computed in Python
tasks over the whole text; the network is fitted on the driver from bounded samples of feature rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.learning import Scaled, fold, sampled, sigmoid

FEATURES = 19
#: Byte classes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 sentence punctuation, 7 other symbol, 8 beyond ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[32, 9]], CLASS[[10, 13]], CLASS[128:] = 1, 2, 3, 4, 5, 8
CLASS[list(b".,;:?!'\"()-")] = 6
CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 7
#: Of a word's last byte: 1 ends a sentence, 2 is a symbol.
LAST = np.where(CLASS == 7, 2, 0).astype(np.uint8)
LAST[list(b".!?")] = 1
CHUNK = 1 << 16


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; an empty text has zeros and a mark of its own."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * (FEATURES - 1) + [1.0]
    seen = np.frombuffer(data, np.uint8)
    kind = CLASS[seen]
    n = np.bincount(kind, minlength=9)
    inside = np.append((kind != 4) & (kind != 5), False)
    last = LAST[seen[inside[:-1] & ~inside[1:]]]  # of the words' last bytes
    size, count = len(data), len(words)
    length = np.fromiter(map(len, words), np.int64, count)
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    squeezed = sum(len(zlib.compress(data[i:i + CHUNK], 1)) for i in range(0, size, CHUNK))
    letters = max(1, n[1] + n[2] + n[8])
    return [
        math.log(count), n[2] / letters, n[3] / size, (n[4] + n[5]) / size, n[6] / size, n[7] / size, n[8] / size, n[0] / size,
        float(length.mean()), float(length.std()), math.log1p(float(length.max())), distinct / count, math.log(distinct) / max(0.7, math.log(count + 1)),
        float((last == 1).mean()), float((last == 2).mean()), float((length == 1).mean()), len(set(lines)) / max(1, len(lines)), squeezed / size, 0.0,
    ]


def table(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(-1, FEATURES)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """Share of positives among the unlabelled, from below: the smallest ratio of densities over regions of one score.

    A first classifier separates positives from unlabelled rows. Where its score is highest the unlabelled rows are as dense as
    positives times the prior, or denser; the smallest ratio of tail shares bounds the prior.
    """
    rng = np.random.default_rng(seed)
    half_p, half_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    a, b = half_p[0::2], half_p[1::2]
    c, d = half_u[0::2], half_u[1::2]
    net = Network(positive.shape[1], seed)
    net.fit(positive[a], unlabelled[c], 0.5)
    p, u = np.sort(net(positive[b])), np.sort(net(unlabelled[d]))
    best = 1.0
    for q in np.linspace(0.0, 0.6, 25):
        t = np.quantile(p, q)
        tp, tu = (p >= t).mean(), (u >= t).mean()
        best = min(best, tu / max(tp, 1e-6))
    return float(min(0.98, max(0.05, best)))


class Network:
    """One hidden layer, fitted by Adam on the non-negative risk."""

    def __init__(self, inputs: int, seed: int, hidden: int = 24) -> None:
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / math.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
        self.rng = rng

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def _slopes(self, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(x @ self.w[0] + self.w[1])
        back = d[:, None] * self.w[2][None, :] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 40, batch: int = 512, rate: float = 5e-3, decay: float = 1e-4) -> None:
        """Risk: prior * loss(positive as 1) + max(0, loss(unlabelled as 0) - prior * loss(positive as 0)), with the log loss.

        Where the second part of a batch is negative, the step goes the other way along it, so it is not fitted below zero.
        """
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        steps = max(1, len(unlabelled) // batch)
        for _ in range(epochs):
            for _ in range(steps):
                p, u = (x[self.rng.integers(0, len(x), batch)] for x in (positive, unlabelled))
                zp, zu = self(p), self(u)
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                if negative >= 0:
                    slopes = [a + b for a, b in zip(self._slopes(p, (prior * (sigmoid(zp) - 1) - prior * sigmoid(zp)) / batch), self._slopes(u, sigmoid(zu) / batch))]
                else:
                    slopes = [a + b for a, b in zip(self._slopes(p, prior * sigmoid(zp) / batch), self._slopes(u, -sigmoid(zu) / batch))]
                t += 1
                for i, g in enumerate(slopes):
                    g = g + decay * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


class Model:
    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> None:
        self.scale = Scaled(unlabelled)
        p, u = self.scale(positive), self.scale(unlabelled)
        self.prior = class_prior(p, u)
        self.nets = [Network(p.shape[1], seed + i) for i in range(3)]
        for net in self.nets:
            net.fit(p, u, self.prior)

    def scores(self, texts: list) -> np.ndarray:
        x = self.scale(table(texts))
        return np.mean([sigmoid(net(x)) for net in self.nets], axis=0)


def learned(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", folds: int = 5, held: int = 0, n_positive: int = 6000, n_unlabelled: int = 12000) -> Model | None:
    """A model from at most n_positive trusted rows and n_unlabelled rows whose label is not looked at, of the folds other than `held`.

    Both samples are the first rows by a hash of the key. None without positives.
    """
    order = F.xxhash64(key, F.lit(9))
    trusted = labels.where(f"{key} is not null and {label} = 1").select(key).distinct().where(fold(key, folds) != held)
    trusted = sampled(trusted, n_positive, order).select(F.col(key).alias("__key"), F.lit(1).alias("mark"))
    others = docs.where(f"{key} is not null").select(key).where(fold(key, folds) != held)
    others = sampled(others, n_unlabelled, F.xxhash64(key, F.lit(13))).select(F.col(key).alias("__key"), F.lit(0).alias("mark"))
    wanted = F.broadcast(trusted.union(others).groupBy("__key").agg(F.max("mark").alias("positive"), F.min("mark").alias("least")))  # at most n_positive + n_unlabelled rows

    def run(batches):
        for b in batches:
            x = table(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("__key"), b.column("positive"), b.column("least"), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "positive", "least", "x"])
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("t")).join(wanted, "__key").select("__key", "positive", "least", "t")
    rows = sorted(rows.mapInArrow(run, "k long, positive int, least int, x array<double>").collect())
    positive = np.array([r.x for r in rows if r.positive == 1]).reshape(-1, FEATURES)
    unlabelled = np.array([r.x for r in rows if r.least == 0]).reshape(-1, FEATURES)
    return Model(positive, unlabelled) if len(positive) and len(unlabelled) else None


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.3, folds: int = 5, held: int = 0, **sizes) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts are scored by the mark of empty texts. Repeated rows score alike; a null key is scored and falls in
    the fold of the empty text. Without trusted positives every score is 0.
    """
    model = learned(docs, labels, text, key, folds=folds, held=held, **sizes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            score = sent.value.scores(texts) if sent.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
