"""Near duplicates by SimHash: segment popcounts as a grid, Manhattan distance as a lower bound, then the bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_table, keep
from .components import components
from .near_dedup import _LOWER

SEED = 42
MEMBERS = 512  # of a cell that are compared with each other at once
FRAME_ROWS = 50_000  # members that one call compares
_SLICE = 1 << 16  # words hashed at a time
_PAIRS = 1 << 21  # pairs looked at at a time
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64 bits; one is set if more than half of the text's shingle hashes have it."""
    tokens = (text or b"").translate(_LOWER).split()
    k = min(words, len(tokens))
    if not k:
        return 0
    ones, n = np.zeros(64, np.int64), len(tokens) - k + 1
    for at in range(0, n, _SLICE):
        part = tokens[at : min(at + _SLICE, n) + k - 1]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(part[j:] for j in range(k)))], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, print`` (a signed 64-bit number) of every row of ``docs(doc_id, text)``."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

        return fn

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, "doc_id long, print long")


def embedded(x: np.ndarray) -> np.ndarray:
    """Popcounts of the 32 segments of two bits, each as 0, 1 or 2 set bits in its segment's place.

    So the Manhattan distance of two embeddings is the number of bits in which
    these words differ, and it is never above the distance of the fingerprints.
    """
    high = x >> _ONE
    return ((x | high) & _LOW) | ((x & high & _LOW) << _ONE)


def parts(distance: int) -> list[np.uint64]:
    """Masks of the runs of segments in one of which a linked pair is at most 1 apart."""
    cuts = np.array_split(np.arange(32), max((distance + 1) // 2, 1))
    return [np.uint64(sum(3 << 2 * int(j) for j in run)) for run in cuts]


def neighbours(cell: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """``(place, cell)``: the cells at Manhattan distance 1 of each, one segment one step up or down."""
    place, out = [], []
    for j in range(32):
        if not int(mask) >> 2 * j & 1:
            continue
        low, high = _ONE << np.uint64(2 * j), _ONE << np.uint64(2 * j + 1)
        for bit, able in ((low, (cell & high) == 0), (high, (cell & low) != 0)):
            at = np.flatnonzero(able)
            place.append(at)
            out.append(cell[at] ^ bit)
    return np.concatenate(place), np.concatenate(out)


def cells(prints: DataFrame, distance: int, guests: bool) -> DataFrame:
    """``part, cell, print``: the cell in which each print lies (or, as a guest, those next to it).

    Two cells one step apart have an odd and an even number of set bits, so it
    is enough that the odd ones visit their neighbours.
    """
    masks = parts(distance)

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch.column(0).to_numpy().view(np.uint64)
            no, at, own = [], [], []
            for k, mask in enumerate(masks):
                cell, who = embedded(x) & mask, np.arange(len(x))
                if guests:
                    who = np.flatnonzero(np.bitwise_count(cell) & 1)
                    place, cell = neighbours(cell[who], mask)
                    who = who[place]
                no.append(np.full(len(who), k, np.int32))
                at.append(cell)
                own.append(x[who])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(no)), pa.array(np.concatenate(at).view(np.int64)), pa.array(np.concatenate(own).view(np.int64))], ["part", "cell", "print"])

        return fn

    return arrow_map(prints.select("print"), make, "part int, cell long, print long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star over each connected set of the links: as many links as nodes, less one a set."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for x in (i, j, label[i], label[j]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _compare(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links among the members of each ``(part, cell, x, y)``, thinned to stars."""
    pdf = pdf.sort_values(["part", "cell", "x", "y"], kind="stable")
    group = pdf[["part", "cell", "x", "y"]].to_numpy()
    x = pdf["print"].to_numpy().view(np.uint64)
    guest, block, same = pdf["guest"].to_numpy(bool), pdf["block"].to_numpy(), (pdf["x"] == pdf["y"]).to_numpy()
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1))))
    end = np.repeat(np.append(first[1:], len(x)), np.diff(np.append(first, len(x))))
    after = end - np.arange(len(x)) - 1  # members of its group that come later
    u = embedded(x)
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    total = np.concatenate(([0], np.cumsum(after)))
    at = 0
    while at < len(x):
        to = max(int(np.searchsorted(total, total[at] + _PAIRS, side="right")) - 1, at + 1)
        n = after[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = (same[i] | (block[i] != block[j])) & ~(guest[i] & guest[j])
        i, j = i[ok], j[ok]
        near = np.bitwise_count(u[i] ^ u[j]) <= distance  # the bound
        i, j = i[near], j[near]
        near = np.bitwise_count(x[i] ^ x[j]) <= distance  # the bits themselves
        a, b = np.concatenate((a, x[i[near]])), np.concatenate((b, x[j[near]]))
        if len(a) > len(x):
            a, b = forest(a, b)
        at = to
    a, b = forest(a, b)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(prints: DataFrame, distance: int = 3, *, members: int = MEMBERS, frame_rows: int = FRAME_ROWS) -> DataFrame:
    """``a, b``: stars that connect all distinct ``prints(print)`` that differ in at most ``distance`` bits.

    The popcounts of 32 two-bit segments place a print in a grid; a pair within
    ``distance`` bits is within that Manhattan distance too, so in one of
    ``parts(distance)`` its cells are the same or neighbours.  Cells with company
    are cut into blocks of about ``members`` prints, and every two blocks of a cell
    are compared: bound first, then bits.  Only stars over what is linked come
    out, so their number stays under that of the members even where all are linked.
    """
    key = ["part", "cell"]
    home = keep(cells(prints, distance, False))
    homes = home.groupBy(*key).agg(F.count("*").alias("homes"))
    visits = keep(cells(prints, distance, True).join(homes, key))
    size = homes.join(visits.groupBy(*key).agg(F.count("*").alias("visits")), key, "left")
    size = size.select(*key, (F.col("homes") + F.coalesce("visits", F.lit(0))).alias("m")).where("m > 1")
    size = keep(size.select(*key, F.ceil(F.col("m") / members).cast("int").alias("blocks")))
    both = home.select(*key, "print", F.lit(False).alias("guest")).union(visits.select(*key, "print", F.lit(True)))
    own = both.join(size, key).withColumn("block", F.pmod(F.xxhash64("print"), "blocks").cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = keep(met.select(*key, "print", "guest", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")))
    calls = met.count() // frame_rows + 1
    dealt = met.withColumn("call", F.pmod(F.xxhash64(*key, "x", "y"), F.lit(calls)).cast("int"))
    out = keep(dealt.groupBy("call").applyInPandas(lambda pdf: _compare(pdf, distance), "a long, b long").distinct())
    for t in (home, visits, size, met):
        drop_table(t)
    return out


def near_prints(docs: DataFrame, *, words: int = 3, distance: int = 3, members: int = MEMBERS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; the
    shingles of ``words`` words, repeats included, vote for the 64 bits of the
    fingerprint with their XXH64 (seed 42).  A text with fewer words is one shingle;
    null, empty and blank texts have the fingerprint zero.  Fingerprints that
    differ in at most ``distance`` bits are linked, zero like any other; a
    component is named by the smallest doc_id in it.

    Equal fingerprints are one node from the start, however many rows have
    them.  Rows without id take part; a component without any id has a null name.
    Repeated rows count each; other columns are not read; an empty table gives an
    empty result.  The work on a cell grows with the square of its *distinct*
    fingerprints, dealt over as many tasks as it has pairs of blocks.
    """
    own = keep(fingerprints(docs, words))
    classes = keep(own.groupBy("print").agg(F.min("doc_id").alias("least")))
    stars = links(classes, distance, members=members)
    root = keep(classes.join(components(stars), F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("component")))
    name = root.groupBy("component").agg(F.min("least").alias("component_id"))
    named = keep(root.join(name, "component").select("print", "component_id"))
    for t in (classes, stars, root):
        drop_table(t)
    return own.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
