"""Severity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, random64
from .quality import sample

BITS = 19  # features: 2**19 hashed terms
MAX_ROWS = 8_000  # labelled rows that the model is fitted on
GRADES = 4  # 0 clean, 1 to 3 toxic, by how dense its terms are
STEMS = (4, 5, 6)  # word beginnings, in letters' bytes
GRAMS = (2, 3, 4)  # characters of overlapping pieces of runs
LONG = 64  # bytes of a word; what is longer is a run
_SLICE = 1 << 18  # words, or characters of a run, counted at a time

# letters of words: a-z (A-Z lower-cased) and all bytes of other scripts' letters
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Terms:
    """Counts of a text's words, word beginnings and pieces of runs, as ``(feature numbers, counts, words)``.

    A run is a word of more than ``LONG`` bytes, or one with characters of three
    or four bytes, which may be a whole text in a script without blanks.  All its
    pieces of 2 to 4 characters count, wherever they stand, in long words also
    those of the length of word beginnings, as if a word began there; each four
    characters begun count as a word.
    """

    def __init__(self):
        self.values = random64(256 * LONG, 29).reshape(LONG, 256)  # by place in the word
        self.salt = random64(1 + len(STEMS), 31)
        self.pieces = random64(len(GRAMS) * max(GRAMS), 37).reshape(len(GRAMS), -1) | np.uint64(1)  # by place in the piece

    def _rest(self, word: bytes) -> np.ndarray:
        """What a word's bytes after the first ``LONG`` add to its sum: values by place, times odd numbers by stretch."""
        total = np.zeros(1, np.uint64)
        for at in range(LONG, len(word), _SLICE):
            data = np.frombuffer(word, np.uint8, min(_SLICE, len(word) - at), at)
            place = np.arange(at, at + len(data))
            total += (self.values[place % LONG, data] * (2 * (place // LONG) + 1).astype(np.uint64)).sum(dtype=np.uint64)
        return total

    def _inner(self, run: bytes):
        """Hashes of a run's pieces from its second byte on that equal those of word beginnings, slice by slice."""
        for at in range(1, len(run), _SLICE):
            data = np.frombuffer(run, np.uint8, min(_SLICE + max(STEMS) - 1, len(run) - at), at)
            for k, n in enumerate(STEMS):
                m = min(_SLICE, len(data) - n + 1)
                if m > 0:
                    sums = np.full(m, self.salt[1 + k])
                    for j in range(n):
                        sums += self.values[j, data[j : j + m]]
                    yield mix64(sums)

    def _grams(self, run: str):
        """Hashes of all pieces of a run's characters, slice by slice."""
        for at in range(0, len(run), _SLICE):
            part = run[at : at + _SLICE + max(GRAMS) - 1]
            chars = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
            for own, n in zip(self.pieces, GRAMS):
                m = min(_SLICE, len(chars) - n + 1)
                if m > 0:
                    sums = np.full(m, own[0])
                    for k in range(n):
                        sums += mix64(chars[k : k + m] * own[k])
                    yield mix64(sums)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        words = text.translate(_LETTERS).split()
        total, found, in_runs = len(words), [], None
        for at in range(0, len(words), _SLICE):
            part = words[at : at + _SLICE]
            length = np.fromiter(map(len, part), np.int64, len(part))
            size = np.minimum(length, LONG)
            data = np.frombuffer(b"".join([w[:LONG] for w in part]), np.uint8)
            end = np.cumsum(size)
            start = end - size
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.values[np.arange(len(data)) - np.repeat(start, size), data], out=sums[1:])
            whole = sums[end] - sums[start]
            long = np.flatnonzero(length > LONG)
            for i in long:
                whole[i : i + 1] += self._rest(part[i])
            found.append(mix64(whole + self.salt[0]))
            for k, n in enumerate(STEMS):
                begins = start[size >= n]
                found.append(mix64(sums[begins + n] - sums[begins] + self.salt[1 + k]))
            wide = np.zeros(len(part), bool)
            wide[long] = True
            if (data >= 0xE0).any():
                wide |= np.logical_or.reduceat(data >= 0xE0, start)
            for i in np.flatnonzero(wide):
                run = part[i].decode("utf-8", "replace")
                total += (len(run) - 1) // 4
                if in_runs is None:
                    in_runs = np.zeros(1 << BITS, np.int64)
                for h in chain(self._grams(run), self._inner(part[i]) if length[i] > LONG else ()):
                    np.add.at(in_runs, self._slots(h), 1)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        slot, count = np.unique(self._slots(np.concatenate(found)), return_counts=True)
        if in_runs is not None:
            in_runs[slot] += count
            slot = np.flatnonzero(in_runs)
            count = in_runs[slot]
        return slot, count, total

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - BITS)).astype(np.int64)


def values(count: np.ndarray, words: int) -> np.ndarray:
    """Weight of a term: its count, damped, against what the length alone brings."""
    return (1 + np.log2(count)) / (1 + np.log1p(words / 50)) ** 0.5


@dataclass
class Model:
    """One weight vector for all thresholds: ``P(grade <= k) = sigmoid(cut[k] - w.x)`` with rising cuts."""

    terms: np.ndarray  # sorted feature numbers
    weight: np.ndarray
    cuts: np.ndarray

    def expected(self, slot: np.ndarray, count: np.ndarray, words: int) -> tuple[float, float]:
        """Expected grade, and the chance of a grade over 0."""
        at = np.searchsorted(self.terms, slot)
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == slot if len(self.terms) else np.zeros(len(slot), bool)
        eta = float(self.weight[at[hit]] @ values(count[hit], words))
        over = 1 / (1 + np.exp(np.clip(self.cuts - eta, -30, 30)))  # P(grade > k)
        return float(over.sum()), float(over[0])


def grades(rows: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Ordered severity of labelled rows: 0 if clean, else 1 to ``GRADES - 1`` by thirds of how often ``telling`` terms stand in a text."""
    share = np.array([c[telling[s]].sum() / max(n, 1) for s, c, n in rows])
    own = share[toxic > 0]
    edges = np.quantile(own, np.arange(1, GRADES - 1) / (GRADES - 1)) if len(own) else []
    return np.where(toxic > 0, 1 + np.searchsorted(edges, share, side="right"), 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray, *, keep_terms: int = 8192, ridge: float = 1e-4, rounds: int = 300) -> Model:
    """Fit by gradient steps (Adam) on the mean log-likelihood of the ordinal model."""
    kinds = set(toxic.tolist())
    if len(kinds) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), np.full(GRADES - 1, -5.0 if kinds == {1} else 5.0))
    seen = np.zeros((2, 1 << BITS))
    for (s, c, n), t in zip(rows, toxic):
        seen[int(t), s] += 1
    total = np.array([(toxic == 0).sum(), (toxic > 0).sum()], float)
    rate = (seen + 0.5) / (total + 1)[:, None]
    gain = np.where(seen.sum(axis=0) >= 3, (rate[1] - rate[0]) ** 2 / (rate.mean(axis=0) * (1 - rate.mean(axis=0))), 0)
    terms = np.sort(np.argsort(-gain, kind="stable")[:keep_terms])
    terms = terms[gain[terms] > 0]
    telling = np.zeros(1 << BITS, bool)
    telling[terms[(rate[1] > 4 * rate[0])[terms]]] = True
    y = grades(rows, toxic, telling)
    place = np.full(1 << BITS, -1)
    place[terms] = np.arange(len(terms))
    r, f, v = [], [], []
    for i, (s, c, n) in enumerate(rows):
        p = place[s]
        r.append(np.full((p >= 0).sum(), i))
        f.append(p[p >= 0])
        v.append(values(c[p >= 0], n))
    r, f, v = np.concatenate(r), np.concatenate(f), np.concatenate(v)
    scale = np.log(rate[1] / rate[0])[terms]  # terms of one kind may weigh more
    v = v * scale[f]
    w = np.zeros(len(terms))
    share = np.clip([(y > k).mean() for k in range(GRADES - 1)], 1e-3, 1 - 1e-3)
    cuts = np.log((1 - share) / share)
    raw = np.concatenate(([cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))))  # cuts stay ordered
    m1, m2 = np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))
    for t in range(1, rounds + 1):
        cuts = raw[0] + np.concatenate(([0], np.cumsum(np.exp(raw[1:]))))
        eta = np.bincount(r, v * w[f], len(y))
        below = 1 / (1 + np.exp(-np.clip(np.concatenate(([-40.0], cuts, [40.0]))[None, :] - eta[:, None], -30, 30)))
        below[:, 0], below[:, -1] = 0, 1
        i = np.arange(len(y))
        hi, lo = below[i, y + 1], below[i, y]
        p = np.maximum(hi - lo, 1e-12)
        dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p  # of log p by upper and lower cut
        g_eta = (dh - dl) / len(y)  # of -log p
        g_w = np.bincount(f, v * g_eta[r], len(w)) + ridge * w
        g_c = np.array([-(dh[y == k].sum() - dl[y == k + 1].sum()) for k in range(GRADES - 1)]) / len(y)
        g_raw = np.concatenate(([g_c.sum()], np.exp(raw[1:]) * np.cumsum(g_c[::-1])[::-1][1:]))
        g = np.concatenate((g_w, g_raw))
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, raw = w - step[: len(w)], raw - step[len(w) :]
    return Model(terms, w * scale, raw[0] + np.concatenate(([0], np.cumsum(np.exp(raw[1:])))))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> Model:
    """Model of ``labels(doc_id, toxic)``, from ``max_rows`` rows at most."""

    def make():
        terms = Terms()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            f = [terms(t or b"") for t in batch.column(0).to_pylist()]
            cols = [batch.column(1), batch.column(2), pa.array([x[0].astype(np.int32).tobytes() for x in f], pa.binary()), pa.array([x[1].astype(np.int32).tobytes() for x in f], pa.binary()), pa.array([x[2] for x in f], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "slots", "counts", "words"])

        return fn

    rows = sample(docs, labels, "toxic", max_rows).select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long"), F.col("y").cast("int"))
    pdf: pd.DataFrame = arrow_map(rows, make, "doc_id long, y int, slots binary, counts binary, words long").toPandas().sort_values("doc_id")
    parts = [(np.frombuffer(s, np.int32), np.frombuffer(c, np.int32), n) for s, c, n in zip(pdf["slots"], pdf["counts"], pdf["words"])]
    return fit(parts, pdf["y"].to_numpy(np.int64))


def severities(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, threshold: float = 0.5) -> DataFrame:
    """``doc_id, severity, toxic_chance, grade, toxic`` for every row of ``docs(doc_id, text)``.

    ``severity`` is the expected grade (0 to 3), ``grade`` that rounded, ``toxic``
    whether a grade over 0 has a chance of ``threshold`` or more.  Grades of the
    labelled rows: 0 where ``labels.toxic`` is 0, else 1 to 3 by thirds of how
    dense the terms are that stand out in toxic rows.  Fitted on ``max_rows`` labelled
    rows at most (documented bound); the model is of fixed size, and every whole
    text is scored where it lies, long words and scripts without blanks included
    (see :class:`Terms`).

    Null or empty text has no terms and gets the severity of that; null ids are
    scored; repeated rows count each; other columns are not read; without labels of both
    kinds every row gets the one kind (clean without any).
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows=max_rows))

    def make():
        terms, model = Terms(), sent.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = [model.expected(*terms(t or b"")) for t in batch.column(1).to_pylist()]
            e, p = np.array([x[0] for x in s], float), np.array([x[1] for x in s], float)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(e), pa.array(p), pa.array(np.rint(e).astype(np.int32)), pa.array(p >= threshold)], ["doc_id", "severity", "toxic_chance", "grade", "toxic"])

        return fn

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, make, "doc_id long, severity double, toxic_chance double, grade int, toxic boolean")
