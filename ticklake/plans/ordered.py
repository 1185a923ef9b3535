"""Ordered computation over long series without one task per key.

A plain ``Window.partitionBy("Symbol")`` sends every row of a symbol to one
task.  With a symbol that holds a third of the data that task never ends.  The
kit here cuts each series into pieces and still gives the exact result:

``row_index``   dense 0-based row number per key.  Rows are counted per
                (key, time bucket); the counts are prefix-summed on a small
                directory table and the offsets joined back, so rows are only
                ever grouped by (key, bucket).
``rolling``     bounded row frames.  Each row goes to its block of
                ``block_rows`` rows, and the rows next to a block edge are also
                copied to the neighbour block, so a frame never leaves its block.
``running``     unbounded-preceding sum / count / max / min / last.  In-block
                running value combined with the prefix over earlier blocks.
``linear_scan`` ``y[i] = a[i] * y[i-1] + b[i]``.  A (key, bucket) composes to
                one ``(A, B)`` pair; the pairs are scanned, and each bucket's rows
                follow from where it starts.

Rows with a NULL key or time stay: NULL keys are one key, NULL times come first.
``order.tie`` must make the order of rows within a key unique.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BKT = "__bkt"
IDX = "__idx"
BLK = "__blk"
PIECE = "__piece"


@dataclass(frozen=True)
class Order:
    """How a table is keyed and ordered.

    ``bucket_seconds`` is the width of the time buckets; choose it so that one
    (key, bucket) fits comfortably in a task.  ``block_rows`` is the block
    length used by ``rolling``, ``scan_rows`` the one of state machines.
    """

    keys: tuple[str, ...] = ("Symbol",)
    ts: str = "Timestamp"
    tie: tuple[str, ...] = ("seq",)
    bucket_seconds: int = 86_400
    block_rows: int = 4_096
    scan_rows: int = 65_536
    bucket_by: Column | None = None  # bucket expression, if not by time

    def bucket(self) -> Column:
        return bucket(self.ts, self.bucket_seconds) if self.bucket_by is None else self.bucket_by

    def by(self, *cols: str) -> list[Column]:
        return [F.col(c) for c in (*cols, self.ts, *self.tie)]

    def with_keys(self, *keys: str) -> Order:
        return replace(self, keys=keys)

    def sort(self, reverse: bool = False) -> list[Column]:
        return [F.col(c).desc() if reverse else F.col(c).asc() for c in (self.ts, *self.tie)]

    def plain_window(self) -> WindowSpec:
        """One window per key: only for keys known to be short."""
        return Window.partitionBy(*self.keys).orderBy(*self.sort())


TICKS = Order()


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a (zone-free) timestamp."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def bucket(ts: str | Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(int(seconds) * 1_000_000)).cast("long")


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Put the columns of a one-row table (a global aggregate) on every row."""
    key = "__one"
    return df.withColumn(key, F.lit(1)).join(F.broadcast(one.withColumn(key, F.lit(1))), key).drop(key)


def join_same(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join where the columns ``on`` are the same, null like null: rows with a null key or time stay."""
    other = small.withColumnsRenamed({k: f"__on_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in on]
    return df.join(other, same, how).drop(*[f"__on_{k}" for k in on])


SALTS = 32  # parts over which the rows of one key are dealt


def attach(df: DataFrame, small: DataFrame, keys: list[str], spread: Sequence[str | Column] = ()) -> DataFrame:
    """Per-key values on the rows of the key; without keys ``small`` has one row.

    With ``spread``, columns that differ between the rows of a key, a key's rows
    are dealt over ``SALTS`` parts by their hash and its values are copied to each, so
    no task gets a whole hot key.  Without, the optimiser splits what it finds skewed.
    """
    if not keys:
        return with_row(df, small)
    if not spread:
        return join_same(df, small, keys)
    salt = "__salt"
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_same(df.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")), copies, [*keys, salt]).drop(salt)


def in_pieces(df: DataFrame, order: Order) -> DataFrame:
    """Add the piece of a row: its keys and time bucket as one struct.

    A struct is never null, so pieces meet in plain equi joins with null keys
    alike, and the shuffle of such a join serves the window or group that follows.
    """
    return df.withColumn(PIECE, F.struct(*order.keys, order.bucket().alias(BKT)))


def by_key(order: Order) -> WindowSpec:
    """A window over the pieces of a key."""
    return Window.partitionBy(*[F.col(PIECE)[k] for k in order.keys])


def offsets(rows: DataFrame, order: Order) -> DataFrame:
    """``piece, __off``: rows of the key before each piece of ``rows``."""
    counts = rows.groupBy(PIECE).agg(F.count(F.lit(1)).alias("__n"))
    before = by_key(order).orderBy(F.col(PIECE)[BKT]).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(PIECE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))


def _tag(order: Order) -> str:
    return "|".join([*order.keys, order.ts, *order.tie])


def is_numbered(df: DataFrame, order: Order) -> bool:
    """Whether ``df`` carries ``__idx`` of this order (noted in the column's metadata)."""
    return IDX in df.columns and df.schema[IDX].metadata.get("order") == _tag(order)


def own_index(df: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` without the numbering that an operator made on its way, unless its input ``df`` had it."""
    return out if IDX in df.columns else out.drop(IDX)


def row_index(df: DataFrame, order: Order = TICKS, out: str = IDX) -> DataFrame:
    """Add the dense 0-based row number within the key; rows that carry it already are left as they are.

    The offsets read the keys and times of ``df`` a second time.  Number once
    at the start of a chain: ``rolling`` and ``linear_scan`` keep and use what is there.
    """
    if out == IDX and is_numbered(df, order):
        return df
    rows = in_pieces(df, order)
    inside = Window.partitionBy(PIECE).orderBy(*order.sort())
    numbered = rows.join(offsets(rows, order), PIECE)
    numbered = numbered.withColumn(out, F.row_number().over(inside) - F.lit(1) + F.col("__off")).drop(PIECE, "__off")
    return numbered.withMetadata(out, {"order": _tag(order)})


def halo_blocks(df: DataFrame, order: Order, back: int, ahead: int = 0) -> tuple[DataFrame, WindowSpec]:
    """Rows with their block id, edge rows copied, and the window inside a block."""
    size = max(order.block_rows, 4 * (back + ahead), 1)
    idx = F.col(IDX)
    rows = row_index(df, order).withColumn("__home", F.floor(idx / size).cast("long"))
    if back or ahead:
        low = F.greatest(F.lit(0).cast("long"), F.floor((idx - ahead) / size).cast("long"))
        high = F.floor((idx + back) / size).cast("long")
        rows = rows.withColumn(BLK, F.explode(F.sequence(low, high)))
    else:
        rows = rows.withColumn(BLK, F.col("__home"))
    return rows, Window.partitionBy(*order.keys, BLK).orderBy(IDX)


def rolling(
    df: DataFrame,
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int,
    ahead: int = 0,
    order: Order = TICKS,
    keep_index: bool = False,
) -> DataFrame:
    """Run ``fn(rows, window)`` where frames look ``back`` rows back and ``ahead`` ahead."""
    rows, window = halo_blocks(df, order, back, ahead)
    out = fn(rows, window).where(F.col(BLK) == F.col("__home")).drop(BLK, "__home")
    return out if keep_index or is_numbered(df, order) else out.drop(IDX)


def full(agg: Callable[[Column], Column], x: Column | str, n: int, w: WindowSpec) -> Column:
    """``agg`` over the last ``n`` rows; NULL until all ``n`` values are there."""
    x = F.col(x) if isinstance(x, str) else x
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


_PREFIX = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    outs: Mapping[str, tuple[str, Column]],
    order: Order = TICKS,
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Add running values; ``outs`` maps a name to ``(kind, expression)``.

    Kinds: ``sum``, ``count``, ``max``, ``min`` and ``last`` (last non-NULL
    value).  ``reverse`` runs from the newest row, ``exclusive`` leaves the
    current row out.
    """
    rows = in_pieces(df, order)
    for name, (_, expr) in outs.items():
        rows = rows.withColumn(f"__x_{name}", expr)
    place = F.struct(*[F.col(c) for c in (order.ts, *order.tie)])
    pick = F.min_by if reverse else F.max_by
    aggs, carried, values = [], [], []
    at = F.col(PIECE)[BKT]
    before = by_key(order).orderBy(at.desc() if reverse else at.asc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(PIECE).orderBy(*order.sort(reverse))
    frame = inside.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    for name, (kind, _) in outs.items():
        x, c = F.col(f"__x_{name}"), F.col(f"__c_{name}")
        if kind == "last":
            aggs.append(pick(x, F.when(x.isNotNull(), place)).alias(f"__a_{name}"))
            carried.append(F.last(f"__a_{name}", ignorenulls=True).over(before).alias(f"__c_{name}"))
            values.append(F.coalesce(F.last(x, ignorenulls=True).over(frame), c).alias(name))
            continue
        inner = F.count if kind == "count" else _PREFIX[kind]
        aggs.append(inner(x).alias(f"__a_{name}"))
        carried.append(_PREFIX[kind](f"__a_{name}").over(before).alias(f"__c_{name}"))
        here = inner(x).over(frame)
        if kind in ("sum", "count"):
            zero = F.lit(0)
            total = F.when(
                here.isNotNull() | c.isNotNull(), F.coalesce(here, zero) + F.coalesce(c, zero)
            )
            values.append((F.coalesce(total, zero) if kind == "count" else total).alias(name))
        else:
            values.append((F.greatest if kind == "max" else F.least)(here, c).alias(name))
    directory = rows.groupBy(PIECE).agg(*aggs).select(PIECE, *carried)
    kept = [c for c in df.columns if c not in outs]
    return rows.join(directory, PIECE).select(*kept, *values)


def running_within(df: DataFrame, outs, order: Order = TICKS, **kw) -> DataFrame:
    """``running`` in named steps: later mappings may use earlier outputs."""
    for step in outs:
        df = running(df, step, order, **kw)
    return df


def linear_scan(
    df: DataFrame,
    outs: Mapping[str, tuple[Column, Column]],
    order: Order = TICKS,
    keep_index: bool = False,
) -> DataFrame:
    """Add ``y[i] = a[i] * y[i-1] + b[i]`` per output; ``a`` of the first row should be 0.

    Expressions may use ``__idx``, the row number within the key.  A piece (key
    and time bucket) composes to one ``(A, B)`` pair, the pairs of a key are
    scanned, and the rows of a piece follow from its own prefix and what it starts from.
    """
    names = list(outs)
    kept = [c for c in df.columns if c not in names and c != IDX]
    rows = in_pieces(df, order)
    key_fields = [rows.schema[PIECE].dataType[k] for k in order.keys]
    numbered = is_numbered(df, order)
    if not numbered:
        rows = rows.drop(IDX)
    first = F.lit(0).cast("long").alias("__off")

    def stepped(d: DataFrame) -> DataFrame:
        if not numbered:
            inside = Window.partitionBy(PIECE).orderBy(*order.sort())
            d = d.withColumn(IDX, F.row_number().over(inside) - F.lit(1) + F.col("__off"))
        return d.withColumns({f"__{s}_{n}": x.cast("double") for n, ab in outs.items() for s, x in zip("ab", ab)})

    steps = [f"__{s}_{n}" for n in names for s in "ab"]
    placed = rows.select("*", first) if numbered else rows.join(offsets(rows, order), PIECE)
    narrow = stepped(placed).select(PIECE, "__off", IDX, *steps)
    sums = narrow.groupBy(PIECE).applyInArrow(_summary(names), T.StructType([narrow.schema[PIECE], narrow.schema["__off"], *[T.StructField(x, T.DoubleType()) for x in steps]]))
    carry_schema = T.StructType([narrow.schema[PIECE], narrow.schema["__off"], *[T.StructField(f"__c_{n}", T.DoubleType()) for n in names]])
    carries = sums.groupBy(*[F.col(PIECE)[f.name].alias(f.name) for f in key_fields]).applyInArrow(_chain(names), carry_schema)
    joined = stepped(rows.join(carries, PIECE))
    out = [*kept, *([IDX] if keep_index or numbered else [])]
    tagged = joined if numbered else joined.withMetadata(IDX, {"order": _tag(order)})
    schema = T.StructType([*[tagged.schema[c] for c in out], *[T.StructField(n, T.DoubleType()) for n in names]])
    return joined.groupBy(PIECE).applyInArrow(_replay(names, out), schema)


def _prefixes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The affine map from the start to each step, by doubling."""
    step = 1
    while step < len(a):
        b = np.concatenate((b[:step], a[step:] * b[:-step] + b[step:]))
        a = np.concatenate((a[:step], a[step:] * a[:-step]))
        step *= 2
    return a, b


def _steps(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(t[f"__{s}_{name}"].combine_chunks().to_numpy(zero_copy_only=False) for s in "ab")


def _summary(names: list[str]):
    def summarise(t: pa.Table) -> pa.Table:
        t = t.sort_by(IDX)
        out = {PIECE: t[PIECE][:1], "__off": t["__off"][:1]}
        for n in names:
            a, b = _prefixes(*_steps(t, n))
            out |= {f"__a_{n}": a[-1:], f"__b_{n}": b[-1:]}
        return pa.table(out)

    return summarise


def _chain(names: list[str]):
    def chain(t: pa.Table) -> pa.Table:
        bucket = t[PIECE].combine_chunks().field(BKT)
        t = t.take(pc.array_sort_indices(bucket, null_placement="at_start"))
        out = {PIECE: t[PIECE], "__off": t["__off"]}
        for n in names:
            _, b = _prefixes(*_steps(t, n))  # the series starts from 0
            out[f"__c_{n}"] = np.concatenate(([0.0], b[:-1]))
        return pa.table(out)

    return chain


def _replay(names: list[str], out: list[str]):
    def replay(t: pa.Table) -> pa.Table:
        t = t.sort_by(IDX)
        cols = {c: t[c] for c in out}
        for n in names:
            a, b = _prefixes(*_steps(t, n))
            y = a * t[f"__c_{n}"][0].as_py() + b
            cols[n] = pa.array(y, mask=np.isnan(y))
        return pa.table(cols)

    return replay
