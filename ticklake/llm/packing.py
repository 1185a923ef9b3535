"""Token sequences packed by vector best fit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, keep

CAPACITY = 4096
END = 1  # id after every document
BINS_PER_GROUP = 4096  # sequences that one task packs: about 16.8 million tokens of narrow rows


def pieces(docs: DataFrame, *, file: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian 32-bit ids) of every document of ``docs(doc_id, text)``.

    A document's ids are those of its whole text without special tokens, then
    ``end``; only longer ones are cut, into pieces of ``capacity`` ids.  Null text
    counts as empty (one piece with ``end`` alone); a null doc_id is kept; repeated rows
    count each.  Texts are encoded in stretches, so a very long one needs memory
    for its ids only a piece at a time.
    """
    file = file or tokens.path(tokens.WORD_BPE)
    size = 4 * capacity
    last = np.array([end], "<u4").tobytes()

    def make():
        encoder = tokens.word_encoder(file)

        def cut(text: str):
            held = bytearray()
            for ids in encoder.encode(text):
                held += ids
                while len(held) > size:
                    yield bytes(held[:size])
                    del held[:size]
            held += last
            while len(held) > size:
                yield bytes(held[:size])
                del held[:size]
            yield bytes(held)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, no, start, length, ids = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, p in enumerate(cut(text or "")):
                    doc.append(d)
                    no.append(k)
                    start.append(k * capacity)
                    length.append(len(p) // 4)
                    ids.append(p)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

        return fn

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, piece int, start long, length long, ids binary")


def dot_product(need: np.ndarray, residual: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bin whose residual points most the way of the need."""
    return residual @ (weights * need)


def residual_norm(need: np.ndarray, residual: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bin that is left with the least."""
    return -(((residual - need) ** 2) @ weights)


def best_fit(length: np.ndarray, *, tokens: int, documents: int, cost: int, weights: tuple[float, float, float], score: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every item, longest first.

    A bin has three capacities: tokens, number of items, attention cost (sum of
    squared lengths).  Among the open bins that can take the item under all of
    them the one with the best score does; if none can, a bin is opened.  An
    item over a capacity by itself gets a bin alone.
    """
    caps = np.array([tokens, documents, cost], float)
    w = np.asarray(weights, float)
    order = np.argsort(-length, kind="stable")
    out, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    least = np.array([length.min(initial=tokens), 1, 0], float) / caps
    residual, number = np.empty((1024, 3)), np.empty(1024, np.int64)  # of open bins
    used: list[int] = []  # tokens in each bin
    n = 0
    for i in order:
        need = np.array([length[i], 1, float(length[i]) ** 2]) / caps
        able = np.flatnonzero((residual[:n, 0] >= need[0]) & (residual[:n, 1] >= need[1]) & (residual[:n, 2] >= need[2] - 1e-12))
        if len(able):
            at = able[int(np.argmax(score(need, residual[able], w)))]
        else:
            if n == len(residual):
                residual, number = np.concatenate((residual, residual)), np.concatenate((number, number))
            at, n = n, n + 1
            residual[at], number[at] = 1.0, len(used)
            used.append(0)
        b = number[at]
        out[i], offset[i] = b, used[b]
        used[b] += int(length[i])
        residual[at] -= need
        if (residual[at] < least - 1e-12).any():  # nothing fits any more
            n -= 1
            residual[at], number[at] = residual[n], number[n]
    return out, offset


def packed(
    items: DataFrame,
    *,
    tokens: int = CAPACITY,
    documents: int | None = None,
    cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    score: Callable = residual_norm,
    bins_per_group: int = BINS_PER_GROUP,
) -> DataFrame:
    """``items(length, ...)`` with ``sequence_id`` and ``offset``.

    Rows are dealt at random (by their hash) to groups of about
    ``bins_per_group`` sequences, whose number follows from the total; each group
    is packed by itself, so no task grows with the input and at most about one sequence a
    group is not filled.  Without ``documents`` and ``cost`` those capacities never
    bind.  Lengths must not be null.  An empty table gives an empty result.
    """
    documents, cost = documents or tokens, cost or tokens * tokens
    total = items.agg(F.sum("length"), F.count("*"), F.sum(F.col("length") * F.col("length"))).first()
    bins = max((total[0] or 0) / tokens, total[1] / documents, float(total[2] or 0) / cost)
    groups = int(bins // bins_per_group) + 1
    names = items.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        b, at = best_fit(pdf["length"].to_numpy(np.int64), tokens=tokens, documents=documents, cost=cost, weights=weights, score=score)
        return pdf.assign(sequence_id=b + (pdf["__g"].astype("int64").iloc[0] << 32), offset=at)[[*names, "sequence_id", "offset"]]

    dealt = items.withColumn("__g", F.pmod(F.xxhash64(*[c for c in names]), F.lit(groups)).cast("int"))
    return dealt.groupBy("__g").applyInPandas(pack, f"{types}, sequence_id long, offset long")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Place and checksum of every piece of ``docs``; the narrow piece table is written once."""
    p = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(keep(p))


def sequences(docs: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, each the ids of its pieces in their order."""
    p = keep(pieces(docs).withColumn("digest", F.sha2("ids", 256)))
    placed = packed(p.select("doc_id", "piece", "length", "digest"))
    ids = placed.join(p.groupBy("digest").agg(F.first("ids").alias("ids")), "digest")  # equal pieces are stored once
    rows = ids.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x.ids)).alias("ids"))
