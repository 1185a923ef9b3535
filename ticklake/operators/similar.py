"""Nearest earlier rows (J18): exact, with block pairs skipped by bounds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import IDX, TICKS, Order, attach, join_same, row_index
from ..session import checkpoint
from .mljobs import principal_components

c = F.col
GRID = 256  # cuts of a component
CHUNKS = 3  # blocks of a cell, one after the other in time
BEFORE = 2  # blocks before it, of those with rows that may be a neighbour, that a block meets in the first pass
GROWTH = 4  # a level reaches so many times as far as the one before
SLACK = 1e-8  # distances are compared after rounding to nine places
CELL = ["__s0", "__s1"]
BLOCK = [*CELL, "__chunk"]
LEVEL = "__level"


def _cut(rows: DataFrame, by: list[str], col: str, out: str, parts: Column) -> DataFrame:
    """Add ``out``, the part of ``col``'s range (``parts`` of about equal count within ``by``, of whose rows there are ``__n``) that a row is in, and the cuts."""
    probs = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
    cuts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(col, probs, F.lit(10 * GRID)).alias("__all"))
    cuts = cuts.withColumn("__g", F.least(F.lit(GRID), parts).cast("int"))
    inner = F.transform(F.sequence(F.lit(1), c("__g") - 1), lambda x: F.get("__all", F.floor(x * GRID / c("__g")).cast("int") - 1))
    cuts = cuts.select(*by, F.when(c("__g") > 1, inner).otherwise(F.array().cast("array<double>")).alias(f"__cuts{out}"))
    rows = attach(rows, cuts, by, ["i"])
    return rows.withColumn(out, _part(c(f"__cuts{out}"), c(col)))


def _part(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda x: x < value))


def cell_blocks(table: DataFrame, keys: list[str], names: list[str], block: int) -> DataFrame:
    """Blocks of about ``block`` rows of ``table(keys, i, names, r)`` that are near each other and follow each other in time.

    A key's rows lie in cells cut along the first two ``names``, a cell's rows in
    blocks by ``i``.  A block carries its rows as arrays (``x``: their ``i``), their range of ``i`` and of every name, and the cuts of
    the first name.  Rows with ``asks`` look for neighbours, rows with ``may`` can be one (without these columns: all).
    ``min_`` and ``max_`` are over rows that may, except ``max_i`` and the ``own_`` ranges, which are over those that ask.
    """
    for x in {"asks", "may"} - set(table.columns):
        table = table.withColumn(x, F.lit(True))
    rows = _cut(table, keys, names[0], CELL[0], F.ceil(F.sqrt(c("__n") / (CHUNKS * block))))
    rows = _cut(rows, [*keys, CELL[0]], names[min(1, len(names) - 1)], CELL[1], F.ceil(c("__n") / (CHUNKS * block))).drop(f"__cuts{CELL[1]}")
    order = Order((*keys, *CELL), ts="i", tie=("asks",), bucket_by=F.floor(c("i") / (1 << 20)).cast("long"))
    rows = row_index(rows, order).withColumn("__chunk", F.floor(c(IDX) / block).cast("long"))
    ranges = [F.min(F.when(c("may"), c("i"))).alias("min_i"), F.max(F.when(c("asks"), c("i"))).alias("max_i")]
    ranges += [f(F.when(c(side), c(x))).alias(f"{tag}{f.__name__}_{x}") for x in names for f in (F.min, F.max) for side, tag in (("may", ""), ("asks", "own_"))]
    each = F.struct("i", "asks", "may", "r", *names)
    d = rows.groupBy(*keys, *BLOCK).agg(F.array_sort(F.collect_list(each)).alias("x"), F.count_if("may").cast("int").alias("n"), F.first(f"__cuts{CELL[0]}").alias("__cuts"), *ranges)
    flat = [c(f"x.{n}").alias(n) for n in ("asks", "may", "r", *names)]
    return d.withColumns({"x": c("x.i"), "cols": F.struct(*flat)})


def _rows(x: pa.ListScalar, cols: pa.StructScalar, names: list[str]) -> tuple[np.ndarray, ...]:
    """``(i, v, r, asks, may)`` of a block's rows."""
    one = lambda n: cols[n].values
    v = np.stack([one(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
    r = one("r").cast(pa.float64()).to_numpy(zero_copy_only=False)
    return x.values.to_numpy(), v, r, one("asks").to_numpy(zero_copy_only=False), one("may").to_numpy(zero_copy_only=False)


def _best(i, a, j, b, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, neighbour, distance)``: up to ``k`` nearest earlier neighbours of each row, no further than ``within``; ``j`` ascends."""
    dist = np.round(sum((a[:, None, d] - b[None, :, d]) ** 2 for d in range(a.shape[1])), 9)
    dist[j[None, :] >= i[:, None]] = np.inf
    if within is not None:
        dist[dist > within[:, None]] = np.inf
    hit = np.isfinite(dist)
    if dist.shape[1] > k:
        hit &= dist <= np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
    row, near = np.nonzero(hit)
    d = dist[row, near]
    order = np.lexsort((near, d, row))
    row, near, d = row[order], near[order], d[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], near[first], d[first]


_NEAR = "array<struct<d:double,j:bigint,r:double>>"
_FOUND = f"found array<struct<i:bigint,near:{_NEAR}>>"


def _found(i, row, d, j, r) -> pa.Array:
    """One list: every row of ``i`` that has neighbours, with them."""
    have, count = np.unique(row, return_counts=True)
    fields = [pa.array(d, pa.float64()), pa.array(j, pa.int64()), pa.array(r, pa.float64(), from_pandas=True)]
    near = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], count.cumsum())), pa.int32()), pa.StructArray.from_arrays(fields, ["d", "j", "r"]))
    each = pa.StructArray.from_arrays([pa.array(i[have], pa.int64()), near], ["i", "near"])
    return pa.ListArray.from_arrays(pa.array([0, len(have)], pa.int32()), each)


def _counted(blocks: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    """The blocks without their rows, and ``__m``: how many blocks before it in its cell have rows that may be a neighbour."""
    before = Window.partitionBy(*keys, *CELL).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*keys, *BLOCK, "n", "max_i", *cols).withColumn("__m", F.coalesce(F.count_if(c("n") > 0).over(before), F.lit(0)))


def _names(blocks: DataFrame) -> list[str]:
    return [*blocks.schema["cols"].dataType.names[3:]]


def _lists(kind: pa.DataType, *values: np.ndarray) -> pa.Array:
    return pa.array([v.ravel() for v in values], pa.list_(kind))


def first_pass(blocks: DataFrame, keys: list[str], width: int, k: int) -> DataFrame:
    """Per block with rows that ask: these rows ``qi, qv``, the nearest rows in it and in ``BEFORE`` blocks before it of its cell, each row's k-th distance there and the greatest of them."""
    names = _names(blocks)
    asking = blocks.where("max_i is not null")
    near = _counted(blocks, keys)
    need = near.where("max_i is not null and __m > 0").select(*keys, *BLOCK, F.explode(F.sequence(F.greatest(c("__m") - BEFORE, F.lit(0)) + 1, c("__m"))).alias("__no"))
    held = near.where("n > 0").select(*keys, *CELL, c("__chunk").alias("__at"), (c("__m") + 1).alias("__no"))
    need = join_same(need, held, [*keys, *CELL, "__no"]).drop("__no")
    before = join_same(need, blocks.select(*keys, *CELL, c("__chunk").alias("__at"), "x", "cols"), [*keys, *CELL, "__at"])
    before = before.groupBy(*keys, *BLOCK).agg(F.array_sort(F.collect_list(F.struct("__at", "x", "cols"))).alias("px"))
    both = join_same(asking.select(*keys, *BLOCK, "x", "cols"), before, [*keys, *BLOCK], "left")
    own = [both.schema[n] for n in (*keys, *BLOCK)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", qi array<long>, qv array<double>, kth array<double>, bound double, {_FOUND}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                parts = [_rows(batch["x"][at], batch["cols"][at], names)]
                i, a = (z[parts[0][3]] for z in parts[0][:2])
                if batch["px"][at].is_valid:
                    parts = [*(_rows(e["x"], e["cols"], names) for e in batch["px"][at]), *parts]
                j, b, s, _, may = (np.concatenate(z) for z in zip(*parts))
                j, b, s = j[may], b[may], s[may]
                row, near, d = _best(i, a, j, b, k)
                kth = np.full(len(i), np.inf)
                full = np.bincount(row, minlength=len(i)) == k
                np.maximum.at(low := np.zeros(len(i)), row, d)
                kth[full] = low[full]
                head = [batch.column(n)[at : at + 1] for n in range(len(own))]
                more = [_lists(pa.int64(), i), _lists(pa.float64(), a), _lists(pa.float64(), kth), pa.array([kth.max()]), _found(i, row, d, j[near], s[near])]
                yield pa.RecordBatch.from_arrays([*head, *more], [*[f.name for f in own], "qi", "qv", "kth", "bound", "found"])

    return both.mapInArrow(run, ddl)


def open_pairs(blocks: DataFrame, first: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Block pairs that may still hold nearer rows: the second block, and of the first the ``rows`` (their ``i``) for which they may, with ``v`` and ``kth``.

    A pair is out if nothing in the second block is earlier than the last row of
    the first, or if the boxes of both are further apart than the first's greatest
    k-th distance; so is a row whose own k-th neighbour is nearer than the second's
    box.  A block meets only the parts of the first component's range that its bound reaches.
    """
    spans = [f"{f}_{x}" for x in names for f in ("min", "max")]
    narrow = _counted(blocks, keys, "__cuts", "min_i", *spans, *[f"own_{x}" for x in spans])
    own = join_same(narrow.where("max_i is not null").drop("min_i", "n", *spans), first.select(*keys, *BLOCK, "bound"), [*keys, *BLOCK])
    reach = F.sqrt(c("bound") + SLACK)
    low, high = (_part(c("__cuts"), v) for v in (c(f"own_min_{names[0]}") - reach, c(f"own_max_{names[0]}") + reach))
    own = own.withColumn("__meet", F.explode(F.sequence(low, high))).drop("__cuts")
    past = narrow.where("n > 0").select(*[c(x).alias(f"p_{x}") for x in (*keys, *BLOCK, "min_i", *spans, "n", "__m")])
    apart: Column = F.lit(0.0)
    for x in names:
        gap = F.greatest(F.lit(0.0), c(f"p_min_{x}") - c(f"own_max_{x}"), c(f"own_min_{x}") - c(f"p_max_{x}"))
        apart = apart + gap * gap
    same_cell = (c("p___s0") == c("__s0")) & (c("p___s1") == c("__s1"))
    seen = same_cell & c("p___m").between(c("__m") - BEFORE, c("__m"))
    meet = [own[x].eqNullSafe(past[f"p_{x}"]) for x in keys] + [c("__meet") == c("p___s0"), c("p_min_i") < c("max_i"), apart <= c("bound") + SLACK, ~seen]
    box = F.struct("p___s1", "p___chunk", "p_n", F.array(*[c(f"p_min_{x}") for x in names]).alias("low"), F.array(*[c(f"p_max_{x}") for x in names]).alias("high"), "p_min_i")
    boxes = own.join(past, meet).groupBy(*keys, *BLOCK, "p___s0").agg(F.collect_list(box).alias("boxes"))  # of one part of the range
    both = join_same(boxes, first.select(*keys, *BLOCK, "qi", "qv", "kth"), [*keys, *BLOCK]).select(*keys, "p___s0", "boxes", "qi", "qv", "kth")
    own_fields = [both.schema[n] for n in (*keys, "p___s0")]
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                i, a, kth = (batch[n][at].values.to_numpy() for n in ("qi", "qv", "kth"))
                a, boxes = a.reshape(-1, width), batch["boxes"][at].values
                low, high = (boxes.field(f).flatten().to_numpy().reshape(-1, width) for f in ("low", "high"))
                apart = sum(np.maximum(0, np.maximum(low[None, :, d] - a[:, None, d], a[:, None, d] - high[None, :, d])) ** 2 for d in range(width))
                need = (apart <= kth[:, None] + SLACK) & (boxes.field("p_min_i").to_numpy()[None, :] < i[:, None])
                some = np.flatnonzero(need.any(axis=0))
                if len(some):
                    head = [pa.array([batch.column(n)[at].as_py()] * len(some), batch.column(n).type) for n in range(len(own_fields))]
                    rest = [boxes.field(f).take(pa.array(some)) for f in ("p___s1", "p___chunk", "p_n")]
                    sent = [_lists(t, *[v[need[:, x]] for x in some]) for t, v in ((pa.int64(), i), (pa.float64(), a), (pa.float64(), kth))]
                    yield pa.RecordBatch.from_arrays([*head, *rest, *sent], [*[f.name for f in own_fields], "p___s1", "p___chunk", "p_n", "rows", "v", "kth"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own_fields)
    return both.mapInArrow(run, f"{ddl}, p___s1 int, p___chunk long, p_n int, rows array<long>, v array<double>, kth array<double>")


def second_pass(pairs: DataFrame, blocks: DataFrame, keys: list[str], width: int, k: int) -> DataFrame:
    """``found``: rows of the pairs' second blocks that are as near as a row's k-th so far.  Only the rows in question travel, each block once."""
    names = _names(blocks)
    other = blocks.select(*keys, *[c(x).alias(f"p_{x}") for x in BLOCK], c("x").alias("px"), "cols")
    both = join_same(pairs.drop("p_n"), other, [*keys, *[f"p_{x}" for x in BLOCK]]).select(*keys, "rows", "v", "kth", "px", "cols")
    own = [both.schema[n] for n in keys]
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], _FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                i, a, kth = (batch[n][at].values.to_numpy() for n in ("rows", "v", "kth"))
                j, b, s, _, may = _rows(batch["px"][at], batch["cols"][at], names)
                j, b, s = j[may], b[may], s[may]
                row, near, d = _best(i, a.reshape(-1, width), j, b, k, kth)
                if len(row):
                    head = [batch.column(n)[at : at + 1] for n in range(len(own))]
                    yield pa.RecordBatch.from_arrays([*head, _found(i, row, d, j[near], s[near])], [*[f.name for f in own], "found"])

    return both.mapInArrow(run, ddl)


def leveled(table: DataFrame, keys: list[str], names: list[str], k: int, block: int) -> DataFrame:
    """``table`` by levels: rows that ask at their own level only, rows that may be a neighbour from their own level on.

    A level asks for rows up to ``GROWTH`` times as far in time as the one before and holds all
    rows up to there, so where a row asks at least a fourth of what is there is earlier and its k-th distance is near
    the final one; all levels together hold a fixed multiple of the rows.  Of rows at the same
    place only the first ``k`` can be anyone's neighbour, since ties go by ``i``.
    """
    ends = F.array(*[F.lit(CHUNKS * block * GROWTH**n).cast("long") for n in range(24)])
    rows = table.withColumn(LEVEL, F.size(F.filter(ends, lambda x: x <= c("i"))))
    here = Window.partitionBy(*keys, *names).orderBy("i")
    may = rows.withColumn("__rn", F.row_number().over(here)).where(c("__rn") <= k).drop("__rn")
    top = rows.groupBy(*keys).agg(F.max(LEVEL).alias("__top"))
    may = attach(may, top, keys, ["i"]).withColumn(LEVEL, F.explode(F.sequence(LEVEL, "__top"))).drop("__top")
    asks = rows.withColumns({"asks": F.lit(True), "may": F.lit(False)})
    return asks.unionByName(may.withColumns({"asks": F.lit(False), "may": F.lit(True)}))


def nearest_earlier(table: DataFrame, keys: list[str], names: list[str], k: int, block: int = 512) -> DataFrame:
    """``keys, i, near``: for each row of ``table(keys, i, names, r)`` its ``k`` nearest earlier rows ``(d, j, r)``, nearest first, ties by ``j``.

    Two passes, exact at any size.  The first compares a block with itself and
    with those before it in its cell, which gives nearly every row a k-th distance; the
    second sends the rows that these bounds leave open, and only them, to the blocks in reach.
    """
    width, by = len(names), [*keys, LEVEL]
    blocks = checkpoint(cell_blocks(leveled(table, keys, names, k, block), by, names, block))
    first = checkpoint(first_pass(blocks, by, width, k))
    pairs = checkpoint(open_pairs(blocks, first, by, names))
    more = second_pass(pairs, blocks, by, width, k).select(*keys, F.inline("found"))
    more = more.groupBy(*keys, "i").agg(F.flatten(F.collect_list("near")).alias("__more"))
    found = first.select(*keys, F.inline("found"))
    seek = [found[x].eqNullSafe(more[x]) for x in (*keys, "i")]
    both = found.join(more, seek, "full")
    none = F.array().cast(_NEAR)
    near = F.concat(F.coalesce(found["near"], none), F.coalesce(c("__more"), none))
    return both.select(*[F.coalesce(found[x], more[x]).alias(x) for x in (*keys, "i")], F.slice(F.array_sort(near), 1, k).alias("near"))


def similar_days(df: DataFrame, cols: Sequence[str], ret: str, k: int = 5, components: int = 5, order: Order = TICKS, block: int = 512) -> DataFrame:
    """J18 mean and population deviation of the returns of the ``k`` nearest earlier rows, by principal components.

    Rows with fewer than ``k`` earlier rows take those there are; without any both are 0.
    """
    comps = min(components, len(cols))
    names = [f"pc_{i}" for i in range(comps)]
    scored, _ = principal_components(df, cols, comps)
    d = checkpoint(row_index(scored, order))
    keys = list(order.keys)
    found = nearest_earlier(d.select(*keys, c(IDX).alias("i"), *names, c(ret).cast("double").alias("r")), keys, names, k, block)
    size, total = F.size("near"), F.aggregate("near", F.lit(0.0), lambda acc, e: acc + e["r"])
    found = found.withColumn("m", total / size)
    spread = F.sqrt(F.aggregate("near", F.lit(0.0), lambda acc, e: acc + (e["r"] - c("m")) * (e["r"] - c("m"))) / size)
    found = found.select(*keys, c("i").alias(IDX), F.struct(c("m"), spread.alias("s")).alias("__near"))
    got = join_same(d, found, [*keys, IDX], "left")
    return got.select(*df.columns, F.coalesce("__near.m", F.lit(0.0)).alias("nn_return_mean"), F.coalesce("__near.s", F.lit(0.0)).alias("nn_vol"))
