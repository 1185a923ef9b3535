"""Quality scores: naive Bayes log-count ratios as the scale of a linear support vector machine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, random64
from .near_dedup import Shingler

BITS = 18  # features: 2**18 hashed n-grams
MAX_ROWS = 8_000  # labelled rows that the classifier is fitted on
_SLICE = 1 << 20


class NGrams:
    """Distinct n-grams of a text as sorted feature numbers.

    Words and word pairs (A-Z lower-cased), byte triples with their case, and
    the pattern of repetition: how often in a row a word follows itself.
    """

    def __init__(self):
        self.one = Shingler(1)
        self.salt = random64(4, 23)
        self.flag = np.zeros(1 << BITS, bool)

    def slot(self, h: np.ndarray, kind: int) -> np.ndarray:
        return (mix64(h + self.salt[kind]) >> np.uint64(64 - BITS)).astype(np.int64)

    def __call__(self, text: bytes) -> np.ndarray:
        flag = self.flag
        for at in range(0, len(text), _SLICE):
            part = text[max(0, at - 2) : at + _SLICE]
            d = np.frombuffer(part, np.uint8).astype(np.uint64)
            if len(d) > 2:
                flag[self.slot(d[:-2] | d[1:-1] << np.uint64(8) | d[2:] << np.uint64(16), 0)] = True
        words = self.one.ordered(text)
        flag[self.slot(words, 1)] = True
        flag[self.slot(words[:-1] * np.uint64(3) + words[1:], 2)] = True
        same = np.concatenate(([0], (words[1:] == words[:-1]).astype(np.int64), [0]))
        edge = np.flatnonzero(np.diff(same))
        longest = int((edge[1::2] - edge[::2]).max(initial=0))
        run = np.arange(min(longest.bit_length(), 16), dtype=np.uint64)  # runs of 1, 2, 4, ... repeats
        flag[self.slot(run, 3)] = True
        out = np.flatnonzero(flag)
        flag[out] = False
        return out.astype(np.int32)


@dataclass
class Model:
    """Weights of the features' indicators: scale ``ratio`` and, with it, ``weight``; margin to probability by ``slope, shift``."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        x = self.ratio[features]
        size = float(np.sqrt(x @ x))
        return float(self.weight[features] @ x) / size + self.bias if size else self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the share of a feature among the good rows' indicators over that among the bad rows'."""
    counts = np.full((2, 1 << BITS), smooth)
    for f, label in zip(rows, y):
        counts[int(label), f] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, *, cost: float = 1.0, rounds: int = 15, seed: int = 1) -> tuple[np.ndarray, float]:
    """Linear hinge-loss machine: minimise ``|w|^2 / 2 + cost * sum(max(0, 1 - y (w x + b)))`` in the dual, a row at a time."""
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    norm = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            gradient = y[i] * (w[f] @ v + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w, b


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of best likelihood (Newton steps, slight ridge)."""
    p = np.zeros(2)
    x = np.stack((margin, np.ones_like(margin)), 1)
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (q - t) + 1e-3 * p)
        p -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(p[0]), float(p[1])


def fit(rows: list[np.ndarray], label: np.ndarray, *, beta: float = 0.25, cost: float = 1.0) -> Model:
    """Fit on the features and 0/1 labels of a bounded sample; a fifth of it calibrates the margin."""
    size = 1 << BITS
    if len(set(label.tolist())) < 2:  # nothing to tell apart
        share = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(len(rows)) % 5 == 4
    if len(set(label[held].tolist())) < 2 or len(set(label[~held].tolist())) < 2:
        held = np.zeros(len(rows), bool)
    use = np.flatnonzero(~held)
    ratio = log_count_ratios([rows[i] for i in use], label[use])
    values = []
    for i in use:
        x = ratio[rows[i]]
        values.append((x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32))
    w, b = dual_coordinate_descent([rows[i] for i in use], values, np.where(label[use] > 0, 1, -1), size, cost=cost)
    w = (1 - beta) * np.abs(w).mean() + beta * w  # between naive Bayes and the machine
    model = Model(ratio.astype(np.float32), w.astype(np.float32), beta * b, 1.0, 0.0)
    test = np.flatnonzero(held) if held.any() else use
    model.slope, model.shift = calibrate(np.array([model.margin(rows[i]) for i in test]), np.where(label[test] > 0, 1, -1))
    return model


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """``text, y`` of at most ``max_rows`` labelled documents that are not held out, in the order of a hash of the id.

    The ids are chosen first, so the join sends ``max_rows`` narrow rows at most.
    """
    ids = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # one row for a repeated id


def train(docs: DataFrame, labels: DataFrame, *, target: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Model of ``labels(doc_id, target)`` on the texts of ``docs``, from ``max_rows`` rows at most."""

    def make():
        grams = NGrams()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            f = [grams(t or b"").tobytes() for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(f, pa.binary())], ["doc_id", "y", "features"])

        return fn

    rows = sample(docs, labels, target, max_rows).select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long"), F.col("y").cast("int"))
    pdf: pd.DataFrame = arrow_map(rows, make, "doc_id long, y int, features binary").toPandas().sort_values("doc_id")
    return fit([np.frombuffer(f, np.int32) for f in pdf["features"]], pdf["y"].to_numpy(np.int64))


def _scorer(spark, model: Model):
    sent = spark.sparkContext.broadcast(model)

    def make():
        grams, m = NGrams(), sent.value
        return lambda texts: [m.score(grams(t.encode() if t else b"")) for t in texts]

    return make


def quality_scores(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    The classifier is fitted on ``max_rows`` labelled rows at most (documented
    bound; ids chosen by hash, held-out ids never), the model is of fixed size
    (2**18 features), and every whole text is scored where it lies: no shuffle.

    Null or empty text has no n-grams but the repetition pattern, and gets the score of that; null ids
    are scored; repeated rows count each; without labels of both kinds every row
    gets the smoothed share of the kind there is (one half without any).
    """
    make_scores = _scorer(docs.sparkSession, train(docs, labels, max_rows=max_rows))

    def make():
        scores = make_scores()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = np.array(scores(batch.column(2).to_pylist()), float)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return fn

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return arrow_map(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def good(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns."""
    make_scores = _scorer(docs.sparkSession, train(docs, labels, max_rows=max_rows))
    at = docs.columns.index("text")

    def make():
        scores = make_scores()
        return lambda batch: batch.filter(pa.array([s >= threshold for s in scores(batch.column(at).to_pylist())], pa.bool_()))

    return arrow_map(docs, make, docs.schema)
