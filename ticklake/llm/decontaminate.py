"""Documents that hold a benchmark passage, by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_table, keep, utf8_size

Q = 8  # bytes of a q-gram: one 64-bit word
BLOCK_BYTES = 4 << 20  # benchmark text that goes to the workers at a time
_SLICE = 1 << 18  # bytes of a document that are searched at a time
_PAIRS = 1 << 20  # (place in text, place in item) pairs looked at at a time
_REGIONS = 4096  # alignments remembered at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21
_ONE = 1 << 32  # an edit, beside the start column in one integer


def normal(text: str | None) -> bytes:
    """Lower-cased words with one space between."""
    return b" ".join((text or "").lower().encode().split())


def grams(data: bytes) -> np.ndarray:
    out = np.empty(max(len(data) - Q + 1, 0), np.uint64)
    for k in range(min(Q, len(out))):
        out[k::Q] = np.frombuffer(data, np.uint64, (len(data) - k) // Q, k)[: len(out[k::Q])]
    return out


def align(item: bytes, text: bytes, band: int, allowed: int, before: int = 0) -> tuple[int, int, int]:
    """``(edits, start, end)`` of the stretch of ``text`` nearest to ``item``; ``text`` begins ``before`` places above the lowest diagonal.

    Row by row over the item with the ``band`` diagonals as one array; a cell holds
    edits and start column in one integer, so the least cell has the fewest edits
    and, of those, the earliest start.  It ends early once no cell of a row is
    within ``allowed`` edits.
    """
    a, pad = np.frombuffer(item, np.uint8), len(item) + band
    b = np.full(pad, -1, np.int16)
    part = np.frombuffer(text, np.uint8)[: pad - before]
    b[before : before + len(part)] = part
    step = np.arange(band, dtype=np.int64) * _ONE
    cell = np.arange(band, dtype=np.int64)
    for i, c in enumerate(a):
        new = cell + np.where(b[i : i + band] == c, 0, _ONE)
        np.minimum(new[:-1], cell[1:] + _ONE, out=new[:-1])
        cell = np.minimum.accumulate(new - step) + step
        if i % 8 == 7 and cell.min() >> 32 > allowed:
            return allowed + 1, 0, 0
    at = int(np.argmin(cell + np.arange(band)))
    start, end = int(cell[at] & (_ONE - 1)) - before, len(item) + at - before
    return int(cell[at] >> 32), max(start, 0), min(max(end, 0), len(text))


class Finder:
    """Benchmark items by their q-grams.  ``items`` are ``(id, text)``; ``rate`` is the edits allowed per byte."""

    def __init__(self, items: list[tuple[object, str | None]], rate: float):
        named = [(i, normal(t)) for i, t in items]
        self.short = [(i, t) for i, t in named if 0 < len(t) < Q]  # looked up as they are
        self.items = [(i, t) for i, t in named if len(t) >= Q]
        size = np.array([len(t) for _, t in self.items], np.int64)
        # q-gram lemma: a stretch within k edits shares at least m - q + 1 - q k of them
        self.edits = np.minimum((rate * size).astype(np.int64), (size - Q) // Q)
        self.needed = size - Q + 1 - Q * self.edits
        g = [grams(t) for _, t in self.items]
        gram = np.concatenate(g) if g else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(g)), [len(x) for x in g]) if g else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.start, self.times = np.unique(gram[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.slot(gram)] = True
        self.longest = int(size.max(initial=0) + self.edits.max(initial=0))

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return (gram * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)

    def __call__(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """``(item id, edits, start, end)`` of the nearest stretch per item found, in bytes of the normal form."""
        data = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        for at in range(0, max(len(data) - Q + 1, 0), _SLICE):
            part = data[at : at + _SLICE + 2 * self.longest]
            for k, (e, s, end) in self.search(part).items():
                best[k] = min(best.get(k, (e, at + s, at + end)), (e, at + s, at + end))
        out = [(self.items[k][0], *v) for k, v in sorted(best.items())]
        for i, t in self.short:
            p = data.find(t)
            if p >= 0:
                out.append((i, 0, p, p + len(t)))
        return out

    def search(self, data: bytes) -> dict[int, tuple[int, int, int]]:
        g = grams(data)
        p = np.flatnonzero(self.seen[self.slot(g)])
        if not len(p):
            return {}
        at = np.searchsorted(self.gram, g[p])
        at[at == len(self.gram)] = 0
        real = self.gram[at] == g[p]
        p, at = p[real], at[real]
        if not len(p):
            return {}
        order = np.argsort(at, kind="stable")
        p = p[order]  # places of each gram, ascending
        shared, first, times = np.unique(at[order], return_index=True, return_counts=True)
        n = self.times[shared]
        row = np.repeat(self.start[shared], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[row]
        # a place of an item counts once however often its gram comes, so this many can count at all
        able = (np.bincount(item, minlength=len(self.items)) >= self.needed)[item]
        if not able.any():
            return {}
        which = np.repeat(np.arange(len(shared)), n)[able]
        item, place = item[able], self.place[row[able]]
        order = np.argsort(item, kind="stable")
        which, item, place = which[order], item[order], place[order]
        best: dict[int, tuple[int, int, int]] = {}
        for lo, hi in _runs(item):
            k = int(item[lo])
            count = self.in_bands(k, len(data), place[lo:hi], first[which[lo:hi]], times[which[lo:hi]], p)
            found = self.nearest(k, data, count)
            if found:
                best[k] = found
        return best

    def in_bands(self, k: int, size: int, place: np.ndarray, first: np.ndarray, times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """By band, the places of item ``k`` whose gram the text has on one of the band's diagonals.

        Band b covers the 2 (k + 1) diagonals from (b - 1)(k + 1) on, less the item's own size; any k + 1
        lie in one.  ``p[first: first + times]`` are where the text has the gram of a
        ``place``.  A gram that the text has more often than there are bands is asked
        for by band, so the work on an item is bounded by its places times the
        bands, and it is done in pieces of ``_PAIRS``.
        """
        w, base = int(self.edits[k]) + 1, len(self.items[k][1]) + int(self.edits[k])
        bands = (size + base) // w + 2
        count = np.zeros(bands, np.int64)
        often = times > bands
        rows = np.flatnonzero(~often)
        ends = np.cumsum(times[rows])
        at = 0
        while at < len(rows):
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + _PAIRS, side="right")), at + 1)
            own, n = rows[at:to], times[rows[at:to]]
            pair = np.repeat(np.arange(len(own)), n)
            where = p[np.repeat(first[own], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
            key = pair * bands + (where - place[own][pair] + base) // w + 1
            key = np.unique(np.concatenate((key, key - 1)))
            count += np.bincount(key % bands, minlength=bands)
            at = to
        starts = (np.arange(bands) - 1) * w - base
        step = max(_PAIRS // bands, 1)
        rows = np.flatnonzero(often)
        for gram in np.unique(first[rows]):
            same = rows[first[rows] == gram]
            there = p[gram : gram + times[same[0]]]
            for at in range(0, len(same), step):
                lo = (starts[None, :] + place[same[at : at + step], None]).ravel()
                has = np.searchsorted(there, lo + 2 * w) > np.searchsorted(there, lo)
                count += has.reshape(-1, bands).sum(axis=0)
        return count

    def nearest(self, k: int, data: bytes, count: np.ndarray) -> tuple[int, int, int] | None:
        """``(edits, start, end)`` of the nearest stretch in the bands with enough grams.

        The grams missing in a band bound its edits from below, so bands go best
        bound first and those that cannot be better any more are passed over.
        Bands over the same bytes (text that repeats itself) are aligned once.
        """
        own, allowed = self.items[k][1], int(self.edits[k])
        w, base = allowed + 1, len(own) + allowed
        bands = np.flatnonzero(count >= self.needed[k])
        least = -((count[bands] - (len(own) - Q + 1)) // Q)
        cols = 2 * w + 2 * allowed
        best: tuple[int, int, int] | None = None
        done: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for i in np.lexsort((bands, least)):
            first = (int(bands[i]) - 1) * w - base - allowed
            start = max(first, 0)
            if start >= len(data):
                continue
            if best is not None and (int(least[i]), start) > best[:2]:
                if least[i] > best[0]:
                    break
                continue
            region = data[start : start + cols + len(own)]
            got = done.get((start - first, region))
            if got is None:
                exact = region.find(own)
                got = (0, exact, exact + len(own)) if exact >= 0 else align(own, region, cols, allowed, start - first)
                if len(done) < _REGIONS:
                    done[start - first, region] = got
            e, s, end = got
            if e <= allowed and (best is None or (e, start + s, start + end) < best):
                best = (e, start + s, start + end)
        return best


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def distinct_texts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, text)`` once for each text, and ``(key, item_id)`` of every row of ``items(item_id, text)``."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    rows = keep(rows.withColumn("key", F.sha2("text", 256)))
    return rows.groupBy("key").agg(F.first("text").alias("text")), rows.select("key", "item_id")


def blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """The number of blocks of about ``block_bytes``, and the blocks: lists of ``(key, text)``, each fetched when it is its turn."""
    size = texts.agg(F.sum(utf8_size("text") + 128)).first()[0] or 0
    n = int(size // block_bytes) + 1
    return n, ([tuple(r) for r in texts.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k).select("key", "text").collect()] for k in range(n))


def _finder(sent):
    def make() -> Finder:
        return Finder(*sent.value)

    return make


def contaminated(docs: DataFrame, items: DataFrame, *, rate: float = 0.1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, edits, start, end`` for each row of ``docs(doc_id, text)`` and item of ``items(item_id, text)`` found in it.

    An item of m bytes in normal form (lower case, single spaces) is found if a
    stretch of the document's lies within ``min(rate * m, (m - 8) / 8)`` edits of it; under 8
    bytes it must be there as it is.  ``start, end`` are bytes of the document's normal
    form.  Shared 8-grams are counted per item in overlapping diagonal bands; a
    region with as many as the q-gram lemma asks for is verified by banded alignment.

    The items are a query set that goes over all documents in blocks of bounded
    size, one after the other: a block's findings are written before the next is
    fetched.  Equal texts are looked for once and get their ids by a join.  Memory
    stays bounded on text that repeats itself (see ``Finder.in_bands``).

    Null or blank texts (on either side) match nothing; null ids are carried; repeated
    rows count each; other columns are not read; empty tables give an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts, ids = distinct_texts(items)
    found = None
    for block in blocks(texts, block_bytes)[1]:
        sent = docs.sparkSession.sparkContext.broadcast((block, rate))

        def make(finder=_finder(sent)):
            find = finder()

            def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
                hits = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for h in find(t)]
                cols = list(zip(*hits)) or [()] * 5
                types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "key", "edits", "start", "end"])

            return fn

        part = keep(arrow_map(rows, make, "doc_id long, key string, edits int, start long, end long"))
        sent.unpersist()
        found = part if found is None else found.union(part)
    return found.join(ids, "key").select("doc_id", "item_id", "edits", "start", "end")


def decontaminated(docs: DataFrame, items: DataFrame, *, rate: float = 0.1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which :func:`contaminated` finds nothing, with all their columns.

    With more than one block of items, the rows that are left are written between blocks.
    """
    at, schema = docs.columns.index("text"), docs.schema
    n, each = blocks(distinct_texts(items)[0], block_bytes)
    before = None
    for k, block in enumerate(each):
        sent = docs.sparkSession.sparkContext.broadcast((block, rate))

        def make(finder=_finder(sent)):
            find = finder()
            return lambda batch: batch.filter(pa.array([not find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = arrow_map(docs, make, schema)
        if k < n - 1:
            docs = keep(docs)
            sent.unpersist()
            if before is not None:
                drop_table(before)
            before = docs
    return docs
