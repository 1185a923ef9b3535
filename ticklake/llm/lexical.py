"""Ranked lexical search, a term at a time, with new accumulators only while they can still matter."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, drop_table, keep, utf8_size

TOP = 50
BLOCK_BYTES = 4 << 20  # text of the items whose terms go to the workers at a time
SEGMENT = 4_000_000  # postings that a task searches at once (about 100 MB)
SALTS = 64  # parts in which the tasks' lists of an item are merged first
_SLICE = 1 << 20  # bytes split into words at a time
# separators become a space, A-Z small letters; bytes over 127 belong to terms
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of every term of a whole text."""
    data, counts, at = (text or b"").translate(_TERMS), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + _SLICE)
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` once each, from ``items(item_id, text)``; rows of one id are one item."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in term_counts(text)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "term"])

        return fn

    return arrow_map(items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")), make, "item_id long, term binary").distinct()


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, times`` of every row: its length in terms, and how often those of ``number`` occur."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def make():
        known = sent.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, terms, times = [], [], []
            for text in batch.column(1).to_pylist():
                counts = term_counts(text)
                own = [t for t in counts if t in known]
                n.append(sum(counts.values()))
                terms.append([known[t] for t in own])
                times.append([counts[t] for t in own])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "times"])

        return fn

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, "doc_id long, n long, terms array<int>, times array<int>")


class Segment:
    """Inverted lists of some documents, ``docs`` ascending in each, with the scores their entries add."""

    def __init__(self, n: np.ndarray, size: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, documents: int, length: int):
        m = 50 + (50 * n * documents) // max(length, 1)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), size)
        times = times.astype(np.int64)
        adds = weight[term] * ((1_000_000_000 * times) // (1000 * times + 20 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.docs, self.adds = doc[order], adds[order]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))
        filled = np.flatnonzero(self.start[1:] > self.start[:-1])
        self.most = np.zeros(len(weight), np.int64)  # the bound of a term here
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.adds, self.start[filled])
        self.score, self.held = np.zeros(len(n), np.int64), np.zeros(len(n), bool)

    def search(self, terms: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """``(documents, scores, accumulators made)`` of all that may be among the ``top``; ``terms`` come rarest first.

        ``least`` is a score that ``top`` documents seen elsewhere have reached.  Once
        the terms left cannot lift a document above the score that ``top`` have by
        now, no accumulator is created any more; those there are go on to be
        updated, so their scores are exact.
        """
        score, held = self.score, self.held
        score[:], held[:] = 0, False
        left, so_far = int(self.most[terms].sum()), 0
        kept: np.ndarray | None = None
        for t in terms:
            docs, adds = self.docs[self.start[t] : self.start[t + 1]], self.adds[self.start[t] : self.start[t + 1]]
            if kept is None:
                partial = least
                if so_far > left:  # else the partial scores cannot be above
                    live = score[held]
                    if len(live) >= top:
                        partial = max(least, int(np.partition(live, len(live) - top)[len(live) - top]))
                if left < partial:
                    kept = np.flatnonzero(held)
            if kept is None:
                score[docs] += adds
                held[docs] = True
            elif len(kept) and len(docs):
                at = np.searchsorted(docs, kept)
                at[at == len(docs)] = 0
                hit = docs[at] == kept
                score[kept[hit]] += adds[at[hit]]
            left -= int(self.most[t])
            so_far += int(self.most[t])
        docs = np.flatnonzero(held)
        made, own = len(docs), score[docs]
        docs, own = docs[own > 0], own[own > 0]
        if len(docs) > top:
            docs, own = (x[own >= np.partition(own, len(own) - top)[len(own) - top]] for x in (docs, own))
        return docs, own, made


def best(score: np.ndarray, missing: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` rows: highest score first, then smallest id, rows without id last."""
    return np.lexsort((doc, missing, -score))[:top]


def _segments(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b.column(2).flatten()) + b.num_rows
        if size >= rows:
            yield held
            held, size = [], 0
    if held:
        yield held


def top_documents(narrow: DataFrame, items: list[tuple[int | None, np.ndarray]], weight: np.ndarray, documents: int, length: int, *, top: int = TOP, segment: int = SEGMENT) -> DataFrame:
    """``item_id, doc_id, score``: for each item and task the best of its :func:`postings`; no shuffle."""
    sent = narrow.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        empty = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        found = [empty] * len(items)
        for part in _segments(batches, segment):
            doc = np.concatenate([b.column(0).fill_null(0).to_numpy() for b in part])
            missing = np.concatenate([b.column(0).is_null().to_numpy(zero_copy_only=False) for b in part])
            size = np.concatenate([b.column(2).value_lengths().to_numpy() for b in part])
            n, term, times = (np.concatenate([x.to_numpy() for x in xs]) for xs in ([b.column(1) for b in part], [b.column(2).flatten() for b in part], [b.column(3).flatten() for b in part]))
            here = Segment(n, size, term, times, weight, documents, length)
            for k, (_, terms) in enumerate(items):
                score, gone, ids = found[k]
                docs, own, _ = here.search(terms, top, int(score[-1]) if len(score) == top else 0)
                all_ = (np.concatenate((score, own)), np.concatenate((gone, missing[docs])), np.concatenate((ids, doc[docs])))
                order = best(*all_, top)
                found[k] = tuple(x[order] for x in all_)
        for (item, _), (score, gone, ids) in zip(items, found):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(score), pa.int64()), pa.array(ids, pa.int64(), mask=gone), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return narrow.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, *, top: int = TOP, block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms are runs of ASCII letters and digits and of all other characters over
    127, with A-Z lower-cased.  With N documents that hold a term, L terms in
    them in all, n in one, df documents holding a term and tf its occurrences in one, a
    document scores the sum over the item's distinct terms of ``w * ((10**9 tf) div
    (1000 tf + 20 m))``, where ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))`` and ``m = 50 + (50 n N) div L``.

    1. A scan writes, for each document, its length and the counts of the items'
       terms: a narrow table.  The counts over all documents come from it.
    2. Every task inverts its part of that table, a segment at a time, and goes
       through each item's terms, rarest first.  New accumulators stop as soon as
       the bounds left are below the score that ``top`` documents of the task
       have; the others are carried to their exact scores.
    3. The tasks' lists are merged in two steps, so no task sees all of them.

    Items go over all documents in blocks of ``block_bytes`` of text, one after the
    other; only the terms of one block are ever on the driver and the workers (an item's own
    terms have to fit there).

    Null, empty and blank texts have no term: such a document ranks nowhere, such
    an item has no rows.  Rows of one item_id are one item with the terms of
    all; a null item_id is an item too.  Repeated documents each take a rank; equal scores
    go by ascending doc_id, null ids last.  Documents with score 0 are left
    out.  Other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    total = items.agg(F.sum(utf8_size("text") + 64)).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    terms = keep(item_terms(items))
    found = None
    for k in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        by_item: dict[int | None, list[bytes]] = {}
        for i, t in own.orderBy("term").toLocalIterator():
            by_item.setdefault(i, []).append(bytes(t))
        number = {t: j for j, t in enumerate(sorted({t for ts in by_item.values() for t in ts}))}
        narrow = keep(postings(docs, number))
        documents, length = narrow.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = narrow.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        weight = np.zeros(len(number), np.int64)
        of = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        for t, w in held.select("t", of).collect():  # a row for each term of the block
            weight[t] = w
        plan = []
        for i, ts in by_item.items():
            t = np.array([number[x] for x in ts], np.int64)
            plan.append((i, t[np.argsort(-weight[t], kind="stable")]))  # a rarer term weighs more
        part = keep(top_documents(narrow, plan, weight, documents, length, top=top, segment=segment))
        drop_table(narrow)
        found = part if found is None else found.union(part)
    first = (F.desc("score"), F.asc_nulls_last("doc_id"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*first))).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*first))).where(F.col("rank") <= top)
    return out.select("item_id", "rank", "doc_id", "score")
