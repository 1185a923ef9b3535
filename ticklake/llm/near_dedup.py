"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, drop_table, keep, mix64, random64
from .components import components

_LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
_BASE = 0x9FB21C651E98DF25  # odd, so that it has an inverse modulo 2**64
_BLOCK = 1 << 16  # words hashed at a time
_BLOCKS, _HASHES = 16, 1 << 20  # of a group of sets that goes to a task: blocks and hashes at most, about
_WIDTH = 4096  # columns of a matrix of sets


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
    A prefix sum of ``byte value * base**position`` gives the hash of any stretch
    of the text by one subtraction, so a text costs a few array passes.
    """

    def __init__(self, words: int):
        self.words = words
        self.values = random64(256, 7)
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))
        self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse, np.uint64))))

    def __call__(self, text: bytes) -> np.ndarray:
        return np.unique(self.ordered(text))

    def ordered(self, text: bytes) -> np.ndarray:
        """Hashes of the shingles as they follow each other."""
        tokens = text.translate(_LOWER).split()
        k = min(self.words, len(tokens))
        if not k:
            return np.empty(0, np.uint64)
        out = []
        for at in range(0, len(tokens) - k + 1, _BLOCK):
            part = tokens[at : at + _BLOCK + k - 1]
            data = np.frombuffer(b" ".join(part), np.uint8)
            if len(data) >= len(self.up):
                self.grow(2 * len(data))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
            length = np.fromiter(map(len, part), np.int64, len(part))
            start = np.cumsum(length + 1) - length - 1
            first, last = start[: len(part) - k + 1], (start + length)[k - 1 :]
            out.append((sums[last] - sums[first]) * self.down[first])
        return mix64(np.concatenate(out))


class Sketcher:
    """Band keys of a hash set: one permutation cut into bins, with optimal densification.

    The range of hash values is cut into ``bands * rows`` bins, and the smallest
    hash of each bin is kept.  An empty bin borrows from another by its own fixed
    random order of all bins (the first filled one), independent of all others.
    """

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.order = np.argsort(random64(self.bins * self.bins, 11).reshape(self.bins, self.bins), axis=1)
        self.weights = random64(rows, 13) | np.uint64(1)
        self.names = random64(bands, 17)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)  # rises with the hash
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), at[1:] != at[:-1])))
        least, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        least[at[first]], filled[at[first]] = hashes[first], True
        if len(first) < self.bins:
            empty = np.flatnonzero(~filled)
            order = self.order[empty]
            source = order[np.arange(len(empty)), filled[order].argmax(axis=1)]
            least[empty] = least[source]
        return mix64((mix64(least.reshape(self.bands, self.rows)) * self.weights).sum(axis=1, dtype=np.uint64) + self.names)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per row: size and digest of the shingle set, and its band keys (none for an empty set)."""

    def make():
        shingle, sketch = Shingler(words), Sketcher(bands, rows)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, digest, keys = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle(text or b"")
                n.append(len(h))
                digest.append(_digest(h) if len(h) else None)
                keys.append(sketch(h).view(np.int64) if len(h) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys"])

        return fn

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), make, "doc_id long, n_shingles long, digest binary, keys array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """Whole shingle sets of ``docs(node, text, own)``; rows whose set has another digest than ``own`` are left out."""

    def make():
        shingle = Shingler(words)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sets = [], []
            for node, text, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = shingle(text or b"")
                if _digest(h) == own:
                    nodes.append(node)
                    sets.append(h.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

        return fn

    return arrow_map(docs.select("node", F.col("text").cast("binary").alias("text"), "own"), make, "node long, hashes array<long>")


def _pairs(df: DataFrame, x: str, y: str, nx: str, ny: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col(nx).alias("na"), F.col(ny).alias("nb"))


def _rare_shared(rest: DataFrame, percent: int) -> DataFrame:
    """``h, node``: the hashes through which sets of different components can be similar enough.

    With the hashes of every set in one order, rare ones first, two sets at the
    threshold share one of their first ``n - ceil(percent n / 100) + 1``.  Hashes of one
    set alone come first and pair with nothing, so only shared ones are placed.
    """
    each = keep(rest.select("node", "component", "n", F.explode("hashes").alias("h")))
    shared = each.groupBy("h").agg(F.count("*").alias("c"), (F.min("component") < F.max("component")).alias("mixed")).where("c > 1")
    own = each.join(shared, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h", "mixed"))).alias("x"))
    first = F.greatest(F.lit(0), F.expr(f"cast(floor((100 - {percent}) * n / 100) as int) + 1 - (cast(n as int) - size(x))"))
    post = keep(own.select("node", F.explode(F.slice("x", F.lit(1), first)).alias("e")).where("e.mixed").select(F.col("e.h").alias("h"), "node"))
    drop_table(each)
    return post


class _Block:
    """A few sets of a task: their rows in the task and, by column, the entries of hashes that several rows hold."""

    def __init__(self, rows: np.ndarray, owner: np.ndarray, column: np.ndarray, n: np.ndarray, part: np.ndarray):
        lo, hi = np.searchsorted(owner, [rows[0], rows[-1] + 1])
        order = np.argsort(column[lo:hi], kind="stable")
        self.row, self.column = owner[lo:hi][order] - rows[0], column[lo:hi][order]
        self.held = np.unique(self.column)
        self.rows, self.n, self.part = rows, n[rows], part[rows]


def _common(x: _Block, y: _Block, at: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``; ``at`` is room for a number per column."""
    both = np.zeros((len(x.n), len(y.n)), np.int64)
    common = np.intersect1d(x.held, y.held, assume_unique=True)
    if not len(common):
        return both
    at[common] = np.arange(len(common))
    sides = []
    for s in (x, y):
        to = at[s.column]
        sides.append((s.row[to >= 0], to[to >= 0], len(s.n)))
    at[common] = -1
    for lo in range(0, len(common), _WIDTH):
        dense = []
        for row, to, rows in sides:
            i, j = np.searchsorted(to, [lo, lo + _WIDTH])
            m = np.zeros((rows, min(_WIDTH, len(common) - lo)), np.float32)
            m[row[i:j], to[i:j] - lo] = 1
            dense.append(m)
        both += (dense[0] @ dense[1].T).astype(np.int64)
    return both


def _compare(pdf: pd.DataFrame, percent: int, block_rows: int) -> pd.DataFrame:
    """Links between the sets of two groups (or inside one) that lie in different components."""
    pdf = pdf.assign(n=pdf["hashes"].map(len)).sort_values(["at", "n", "node"])  # blocks of like sizes
    n, part, at, node = (pdf[c].to_numpy() for c in ("n", "component", "at", "node"))
    owner = np.repeat(np.arange(len(n)), n)
    _, column, times = np.unique(np.concatenate(pdf["hashes"].to_list()), return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in no intersection
    column, owner = (np.cumsum(shared) - 1)[column][shared[column]], owner[shared[column]]
    sides = [[_Block(rows[i : i + block_rows], owner, column, n, part) for i in range(0, len(rows), block_rows)] for rows in (np.flatnonzero(at == g) for g in np.unique(at))]
    room, a, b = np.full(int(shared.sum()), -1), [], []
    for k, x in enumerate(sides[0]):
        for y in sides[-1][k if len(sides) == 1 else 0 :]:
            if 100 * x.n[-1] < percent * y.n[0] or 100 * y.n[-1] < percent * x.n[0]:
                continue  # the sizes alone are too different
            if min(x.part.min(), y.part.min()) == max(x.part.max(), y.part.max()):
                continue  # one component
            both = _common(x, y, room)
            linked = (100 * both >= percent * (x.n[:, None] + y.n[None, :] - both)) & (x.part[:, None] != y.part[None, :])
            i, j = np.nonzero(np.triu(linked, 1) if x is y else linked)
            a.append(node[x.rows[i]])
            b.append(node[y.rows[j]])
    a, b = (np.concatenate([np.empty(0, np.int64), *v]) for v in (a, b))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _blockwise(sets: DataFrame, left: DataFrame, percent: int, block_rows: int, room: int, total: Callable[[], int]) -> DataFrame:
    """Links ``(a, b)`` among ``left(node, component, n)`` across components.

    Sets that meet through rare shared hashes form families, cut into groups of
    about ``_BLOCKS * block_rows`` sets, fewer if they are long.  Two groups are
    compared, in one task and block by block, if a hash meets in both; only links
    come out.  A set goes to as many tasks as its group meets groups, so the pairs
    of groups are taken in rounds that send about ``room`` hashes each, or a
    quarter of the ``total()`` if that is more.
    """
    post = _rare_shared(sets.join(left, "node"), percent)
    least = post.groupBy("h").agg(F.min("node").alias("b"))
    family = components(post.join(least, "h").select(F.col("node").alias("a"), "b"))
    family = keep(family.withColumnRenamed("component", "family").join(left, "node"))
    size = family.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / (_BLOCKS * block_rows), F.sum("n") / _HASHES)).alias("groups"))
    group = keep(family.join(size, "family").select("node", "component", "n", F.xxhash64("family", F.pmod(F.xxhash64("node"), "groups")).alias("at")))
    at = keep(post.join(group, "node").select("h", "at").distinct())
    meet = at.select("h", F.col("at").alias("x")).join(at.select("h", F.col("at").alias("y")), "h").where("x <= y").select("x", "y").distinct()
    sides = meet.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("at"))
    sent = keep(group.join(sides, "at").select("node", "component", "n", "at", "x", "y"))  # no hashes yet
    hashes, links = sent.agg(F.sum("n")).first()[0] or 0, []
    rounds = 1 if hashes <= room else -(-hashes // max(room, total() // 4))
    for k in range(rounds):
        rows = sets.join(sent.where(F.pmod(F.xxhash64("x", "y"), F.lit(rounds)) == k), "node")
        rows = rows.select("x", "y", "at", "node", "component", "n", "hashes")
        links.append(keep(rows.groupBy("x", "y").applyInPandas(lambda pdf: _compare(pdf, percent, block_rows), "a long, b long")))
    for t in (post, family, group, at, sent):
        drop_table(t)
    return reduce(DataFrame.union, links)


@contextmanager
def _swept(spark: SparkSession):
    """Shuffle files go as soon as the table they were for is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 36, rows: int = 5, block_rows: int = 64, room: int = 1 << 24) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Two documents are linked if ``100 * intersection >= percent * union`` holds
    for their whole shingle sets; the component of a document is named by the
    smallest id that can be reached.

    1. Every text becomes a set digest and ``bands`` bucket keys.  Texts with
       equal sets are one class from here on, however many there are.
    2. In every bucket with company the class that sits in the fullest buckets is
       the centre; the others are compared with it alone (a star, not all
       pairs).  Links are confirmed on whole sets.
    3. Classes of one bucket that the stars left in different components are the
       rest.  Among these, sets of different components that share one of their
       rarest hashes (no pair at the threshold can fail to) are compared as well, in
       blocks of ``block_rows``, of which a task gets many.  The pairs of these
       are taken in rounds, so that what is shuffled at a time is bounded: by
       ``room`` hashes, or a quarter of those of all texts if that is more.
       So every similar pair that shares a bucket is in one component or
       compared: a star loses no link.

    With ``rows=5, bands=36`` a pair at 0.8 shares no bucket with a chance of
    6e-7, and less above.

    Null or blank text: an empty set, linked with nothing, its own component.
    Rows without id: component null, kept.  Rows that repeat an id count as one
    document.  Other columns are not read.  An empty table gives an empty result.
    """
    with _swept(docs.sparkSession):
        sketch = keep(sketches(docs, words, bands, rows))
        classes = keep(sketch.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")))
        bucket = classes.select("node", "n", F.explode("keys").alias("key"))
        crowded = bucket.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        members = keep(bucket.join(crowded, "key"))
        score = members.groupBy("node").agg(F.sum("size").alias("score"))
        ranked = keep(members.drop("size").join(score, "node"))
        centre = keep(ranked.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"), "n")).alias("c")))
        spokes = keep(ranked.join(centre.select("key", (-F.col("c.minus")).alias("centre"), F.col("c.n").alias("cn")), "key").where("node != centre").select("key", "node", "n", "centre", "cn"))

        close = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"  # else the sets cannot be similar enough
        stars = _pairs(spokes, "node", "centre", "n", "cn").where(close).distinct()
        crowd = keep(members.select("node").distinct().join(classes.select("node", F.col("digest").alias("own")), "node"))
        texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(crowd.hint("merge"), "node")  # the same way at every size
        sets = keep(shingle_sets(texts, words))

        def confirmed(pairs: DataFrame) -> DataFrame:
            x = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
            x = x.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
            both = F.size(F.array_intersect("ha", "hb"))
            return x.where(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b")

        links = keep(confirmed(stars))
        found = keep(components(links))

        part = members.select("key", "node", "n").join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        part = keep(part)
        open_ = part.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        left = keep(part.join(open_, "key").select("node", "component", "n").distinct())
        more = _blockwise(sets, left, percent, block_rows, room, lambda: sketch.agg(F.sum("n_shingles")).first()[0])
        if not more.isEmpty():
            found = keep(components(links.union(more)))

        named = keep(classes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component")))
        for t in (classes, members, ranked, spokes, sets, part):
            drop_table(t)
    out = sketch.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    of = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", of.alias("component_id"), F.coalesce(of == F.col("doc_id"), F.lit(True)).alias("kept"))
