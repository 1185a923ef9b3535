"""Headline and event tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..plans.ordered import IDX, Order, micros, rolling
from .base import safe_div

c = F.col
NEWS = Order(("symbol",), "timestamp", ("id",))


def score_headlines(df: DataFrame, risk: float = 1.0) -> DataFrame:
    """X17 sentiment, persistence, severity and signed effect of headlines."""
    d = df.withColumn("sentiment", tx.flag_sentiment(c("title")))
    d = d.withColumns(tx.effect_length(c("title"), c("sentiment"), F.lit(0.5), risk))
    d = d.withColumn("word_count", tx.word_count(c("title"))).withColumn("char_count", F.coalesce(F.length("title"), F.lit(0)))
    d = d.withColumn("severity", tx.severity(c("sentiment"), c("length_score"), c("importance_score"), risk))
    return d.withColumn("sentiment_effect", c("sentiment") * c("severity"))


def union_all(*frames: DataFrame) -> DataFrame:
    """U01 union by name, missing columns NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_feeds(fast: DataFrame, slow: DataFrame, keys: Sequence[str] = ("Symbol", "Timestamp")) -> DataFrame:
    """U02/J10 rows of the faster feed and those of the slower one at times the faster lacks."""
    rest = slow.join(fast.select(*keys).distinct(), list(keys), "left_anti").select(fast.columns)
    return fast.unionByName(rest)


def dedupe_first(df: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """U03 first row per key; keys may be NULL.  A min with map-side combine: hot keys cost no sort."""
    rest = [x for x in df.columns if x not in keys]
    d = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_by).alias("__r"))
    return d.select(*keys, *[c(f"__r.{x}").alias(x) for x in rest]).select(df.columns)


def dedupe_events(df: DataFrame, order_by: str, keys: Sequence[str] = ("id", "timestamp", "currency", "event")) -> DataFrame:
    """U04 one row per event: first known value of each field, union of list fields.

    List items are made distinct before they are gathered, so a much-repeated
    event holds each item once.
    """
    keys = list(keys)
    lists = [n for n, t in df.dtypes if t.startswith("array") and n not in keys]
    plain = [n for n in df.columns if n not in keys and n not in lists and n != order_by]
    known = lambda x: F.when(c(x).isNotNull() & (c(x).cast("string") != ""), c(order_by))
    out = df.groupBy(*keys).agg(*[F.min_by(x, known(x)).alias(x) for x in plain], F.min(order_by).alias(order_by))
    for x in lists:
        items = df.select(*keys, F.explode(x).alias("__i")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("__i")).alias(x))
        on = [out[k].eqNullSafe(items[k]) for k in keys]
        out = out.join(items, on, "left").select(*[out[x_] for x_ in out.columns], F.coalesce(items[x], F.array().cast(df.schema[x].dataType)).alias(x))
    return out.select(df.columns)


def dedupe_news(df: DataFrame, order_by: str) -> DataFrame:
    """U05 one row per (title, timestamp) and symbol seen first, with the symbols of its copies.

    An item is kept where it is the first one for at least one of its symbols;
    it takes over the symbols of later items that share a symbol with it.
    """
    syms = F.when(F.size("symbols") > 0, c("symbols")).otherwise(F.array(F.lit(None).cast("string")))
    long = df.select("title", "timestamp", order_by, F.explode(syms).alias("__s"))
    keys = ["title", "timestamp", "__s"]
    owner = long.groupBy(*keys).agg(F.min(order_by).alias("__own"))
    on = [long[k].eqNullSafe(owner[k]) for k in keys]
    linked = long.join(owner, on).select(long[order_by].alias("__id"), "__own").distinct()
    copies = df.select(c(order_by).alias("__id"), F.explode("symbols").alias("__sym"))
    merged = linked.join(copies, "__id").select("__own", "__sym").distinct()
    merged = merged.groupBy("__own").agg(F.array_sort(F.collect_set("__sym")).alias("__all"))
    kept = owner.select(c("__own").alias(order_by)).distinct()
    d = df.join(kept, order_by).join(merged.withColumnRenamed("__own", order_by), order_by, "left")
    return d.withColumn("symbols", F.coalesce(c("__all"), c("symbols"))).select(df.columns)


def previous_vectors(df: DataFrame, cols: Sequence[str], k: int = 3, order: Order = NEWS) -> DataFrame:
    """W43 values of the last ``k`` headlines, newest first, with zeros in FRONT while fewer are known."""

    def fn(d, w):
        have = F.least(c(IDX) + 1, F.lit(k))
        new = {}
        for x in cols:
            lagged = F.array(*[F.lag(x, i).over(w) for i in range(k)])
            for i in range(k):
                pos = F.lit(i) - (k - have)  # index into newest-first values
                new[f"{x}_{i}"] = F.when(pos >= 0, F.get(lagged, pos.cast("int"))).otherwise(F.lit(0.0))
        return d.withColumns(new)

    return rolling(df, fn, k - 1, 0, order)


def top_headlines(df: DataFrame, n: int, order: Order = NEWS) -> DataFrame:
    """K02 newest ``n`` headlines of every symbol."""
    w = Window.partitionBy(*order.keys).orderBy(*order.sort(reverse=True))
    return df.withColumn("__rn", F.row_number().over(w)).where(c("__rn") <= n).drop("__rn")


def _runs(df: DataFrame, items: Column, *keep: str) -> DataFrame:
    """``keep`` and ``runs``: per row the distinct ``items`` as ``struct(n, p, v)``, count, first place and value.

    Row by row: the items are sorted once, and a run of equal ones is a value.
    """
    d = df.select(*keep, F.array_sort(F.transform(items, lambda w, i: F.struct(w.alias("v"), i.alias("p")))).alias("__s"))
    at = F.sequence(F.lit(0), F.size("__s") - 1)
    first = F.when(F.size("__s") > 0, F.filter(at, lambda i: (i == 0) | (F.get("__s", i)["v"] != F.get("__s", i - 1)["v"]))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("__f", first)
    end = lambda k: F.coalesce(F.get("__f", k + 1), F.size("__s"))
    run = lambda i, k: F.struct((end(k) - i).alias("n"), F.get("__s", i)["p"].alias("p"), F.get("__s", i)["v"].alias("v"))
    return d.select(*keep, F.transform("__f", run).alias("runs"))


def top_keywords(df: DataFrame, n: int = 6, text: str = "text", row_id: str = "id") -> DataFrame:
    """K07 the ``n`` commonest tokens of each text, first seen first on ties.  No shuffle; one counter at a time."""
    d = df.where(c(text).isNotNull()).select(row_id, F.lower(text).alias("__t"))
    schema = T.StructType([d.schema[row_id], *[T.StructField(*x) for x in (("keyword", T.StringType()), ("n", T.LongType()), ("rank", T.IntegerType()))]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, word, times, rank = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                best = Counter(w for w in letters.findall(t) if w not in stop).most_common(n)  # keeps the order of first sight
                place += [i] * len(best)
                rank += range(1, len(best) + 1)
                word += [w for w, _ in best]
                times += [k for _, k in best]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(word, pa.string()), pa.array(times, pa.int64()), pa.array(rank, pa.int32())], names)

    names, stop, letters = schema.names, frozenset(tx.STOP_WORDS), re.compile(tx.LETTERS)
    return d.mapInArrow(count, schema)


def embed_long(df: DataFrame, text: str = "text", row_id: str = "id", dim: int = 32) -> DataFrame:
    """X23 sparse hashed embedding, one row (id, slot, weight) per used slot.  No shuffle; rows with equal ids stay apart."""
    d = _runs(df, F.transform(tx.words(c(text)), lambda w: tx.word_slot(w, dim)), row_id)
    norm = F.sqrt(F.aggregate("runs", F.lit(0.0), lambda a, r: a + r["n"].cast("double") * r["n"]))
    cells = F.transform("runs", lambda r: F.struct(r["v"].alias("slot"), (r["n"].cast("double") / c("__l")).alias("weight")))
    return d.withColumn("__l", norm).select(row_id, F.inline(cells))


def _vectors(df: DataFrame, text: str, row_id: str, dim: int) -> DataFrame:
    """(id, v) with the used slots of every text; texts without words have none."""
    d = _runs(df, F.transform(tx.words(F.coalesce(c(text), F.lit(""))), lambda w: tx.word_slot(w, dim)), row_id)
    norm = F.sqrt(F.aggregate("runs", F.lit(0.0), lambda a, r: a + r["n"].cast("double") * r["n"]))
    cells = F.transform("runs", lambda r: F.struct(r["v"].alias("slot"), (r["n"].cast("double") / c("__l")).alias("weight")))
    return d.withColumn("__l", norm).select(row_id, cells.alias("v"))


SIMILARITIES = 1 << 18  # pairs of a text and a query that a task holds at once


def similar_events(
    events: DataFrame, queries: DataFrame, k: int = 5, text: str = "text", row_id: str = "id", query_id: str = "qid", block: int = 4_096
) -> DataFrame:
    """J19 the ``k`` nearest past texts of every query text by hashed embedding, exactly.

    Queries go over the texts in blocks of about ``block``, so what is sent at once
    is bounded; a task compares about ``SIMILARITIES`` pairs at a time.  Each task keeps its best ``k``
    per query, so only those reach the final ranking.
    """
    import numpy as np

    dim = 32

    def dense(cells: pa.ListArray) -> np.ndarray:
        m, flat = np.zeros((len(cells), dim)), cells.flatten()
        row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
        m[row, flat.field("slot").to_numpy()] = flat.field("weight").to_numpy()
        return m

    q = _vectors(queries, text, query_id, dim)
    emb = _vectors(events, text, row_id, dim)
    schema = f"{query_id} {q.schema[query_id].dataType.simpleString()}, {row_id} {emb.schema[row_id].dataType.simpleString()}, similarity double"

    def best_of(shared):
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, qm = shared.value
            step = max(k, SIMILARITIES // len(qids))  # rows at a time
            sims, ids, kind = np.empty((0, len(qids))), None, None
            for batch in batches:
                kind = batch.schema.field(row_id).type
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    sim = np.round(1 - np.sqrt(np.maximum(2 - 2 * (dense(part.column("v")) @ qm.T), 0.0)) / 2, 12)
                    rid = part.column(row_id).to_pandas().to_numpy()
                    rid = np.broadcast_to(rid[:, None], sim.shape)
                    sims = np.concatenate((sims, sim))
                    ids = rid if ids is None else np.concatenate((ids, rid))
                    top = np.lexsort((ids, -sims), axis=0)[:k]
                    sims, ids = np.take_along_axis(sims, top, 0), np.take_along_axis(ids, top, 0)
            if ids is not None:
                each = pa.array(np.tile(qids, len(ids)))
                yield pa.RecordBatch.from_arrays([each, pa.array(ids.ravel(), from_pandas=True).cast(kind), pa.array(sims.ravel())], [query_id, row_id, "similarity"])

        return best

    n = int(queries.count() // block) + 1
    part = None
    for i in range(n):
        rows = q.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == i).collect()
        if not rows:
            continue
        cells = pa.array([[x.asDict() for x in r[1]] for r in rows], pa.list_(pa.struct([("slot", pa.int32()), ("weight", pa.float64())])))
        shared = events.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), dense(cells)))
        found = emb.mapInArrow(best_of(shared), schema)
        part = found if part is None else part.unionByName(found)
    if part is None:
        part = events.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy(query_id).orderBy(c("similarity").desc(), c(row_id))
    return part.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def mean_similarity(similar: DataFrame, query_id: str = "qid") -> DataFrame:
    """J19 mean similarity of a query to its nearest past texts."""
    return similar.groupBy(query_id).agg(F.avg("similarity").alias("similarity"))


def news_between(df: DataFrame, start: Column, end: Column, symbol: str | None = None) -> DataFrame:
    """T11 events of a time range, optionally of one symbol."""
    d = df.where((c("timestamp") >= start) & (c("timestamp") <= end))
    return d if symbol is None else d.where(F.array_contains("symbols", symbol))


def live_news(df: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """T11 events no older than the time to live."""
    return df.where(micros("timestamp") >= micros(now) - ttl_hours * 3_600_000_000)


def pnl_with_news(trades: DataFrame, sentiment: DataFrame, keys: Sequence[str] = ("symbol", "timestamp")) -> DataFrame:
    """J23 results of trades as they were and scaled by the sentiment known at their time."""
    d = trades.join(sentiment.select(*keys, "sentiment"), list(keys), "left")
    return d.withColumn("pnl_news", c("pnl") * (1 + F.coalesce(c("sentiment"), F.lit(0.0))))
