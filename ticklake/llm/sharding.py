"""Shards as runs of a Hilbert curve over metadata."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, utf8_size

BITS = 4  # of each dimension: 16 ** dimensions cells at most
ROWS_PER_PIECE = 20_000  # rows that one task numbers


@lru_cache(8)
def curve_tables(dims: int) -> tuple[list[list[int]], list[list[int]]]:
    """``(digit, state)`` by ``[state][cell]`` of the Hilbert curve, where ``cell`` holds one bit of each dimension.

    A state is where the curve enters its cube (a corner ``e``) and along which axis it
    leaves (``d``).  Cells are passed in the order of the reflected Gray code,
    turned and mirrored by the state; the i-th sub-cube is entered and left as
    the curve's own rule asks.
    """
    n, full = dims, (1 << dims) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & full

    def ones(i: int) -> int:  # trailing one bits
        return ((i + 1) & -(i + 1)).bit_length() - 1

    def entry(i: int) -> int:
        j = 2 * ((i - 1) // 2)
        return 0 if i == 0 else j ^ (j >> 1)

    def axis(i: int) -> int:
        return 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % n

    states, at = [(0, 0)], 0
    digit, follow = [], []
    while at < len(states):
        e, d = states[at]
        row_digit, row_next = [0] * (full + 1), [0] * (full + 1)
        for cell in range(full + 1):
            g = turn(cell ^ e, n - (d + 1))
            w = g
            for s in (1, 2, 4):
                w ^= w >> s
            after = (e ^ turn(entry(w), d + 1), (d + axis(w) + 1) % n)
            if after not in states:
                states.append(after)
            row_digit[cell], row_next[cell] = w, states.index(after)
        digit.append(row_digit)
        follow.append(row_next)
        at += 1
    return digit, follow


def hilbert(levels: list[Column], bits: int) -> Column:
    """Index on the curve of the point ``levels`` (integers under ``2 ** bits``), as one expression."""
    n = len(levels)
    digit, follow = curve_tables(n)
    size = 1 << n
    digits = F.array(*[F.lit(x) for row in digit for x in row])
    nexts = F.array(*[F.lit(x) for row in follow for x in row])
    state, index = F.lit(0), F.lit(0).cast("long")
    point = F.array(*[x.cast("int") for x in levels])

    def step(acc: Column, k: Column) -> Column:
        cell = sum((F.getbit(point[j], k).cast("int") * (1 << (n - 1 - j)) for j in range(n)), F.lit(0))
        at = acc["state"] * size + cell
        return F.struct(F.get(nexts, at).alias("state"), (acc["index"] * size + F.get(digits, at)).alias("index"))

    start = F.struct(state.alias("state"), index.alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["index"]


def text_level(c: str, bits: int) -> Column:
    """Level of a name: the same for equal names; null is level 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("int")


def size_level(size: Column, bits: int) -> Column:
    """Level of a size by its power of two, from 16 bytes on."""
    return F.least(F.greatest(F.length(F.bin(F.greatest(size, F.lit(1)))) - 5, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, size, text_crc32``: what places a document, without its text.  Size is UTF-8 bytes plus 8."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long"), "lang", "source", (utf8_size("text") + 8).alias("size"), crc.alias("text_crc32"))


def sharded(rows: DataFrame, *, shards: int = 24, bits: int = BITS, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """``rows(doc_id, lang, source, size, text_crc32, ...)`` with ``curve, shard, slot``: runs of the Hilbert curve over language, source and size.

    The law is ``rows``: shard counts differ by at most one.  Rows are ordered by
    curve index, then by piece, id and checksum.  A shard's rows share short ranges
    of every dimension, so its files can be skipped by a filter on any of them.

    No sort of the whole table and no window over it: rows are counted per cell of
    the curve (``2 ** (3 bits)`` at most) and piece of a cell (a cell of many rows
    has as many pieces as needed, by row hash), the counts are summed up in
    order, and a row is numbered within its piece.  Only the cell table is
    broadcast, and its size is bounded by the curve.

    A null language or source is level 0, a null id sorts first; rows alike in id
    and checksum take any of their places; columns named ``curve``, ``shard`` or
    ``slot`` are replaced.  An empty table gives an empty result.
    """
    names = [c for c in rows.columns if c not in ("curve", "shard", "slot")]
    rows = rows.select(*names, hilbert([text_level("lang", bits), text_level("source", bits), size_level(F.col("size"), bits)], bits).alias("curve"))
    rows = rows.withColumn("__mix", F.xxhash64("doc_id", "text_crc32"))

    cells = keep(rows.groupBy("curve").agg(F.count("*").alias("__n")).withColumn("__pieces", F.ceil(F.col("__n") / rows_per_piece).cast("int")))
    rows = rows.join(F.broadcast(cells.select("curve", "__pieces")), "curve").withColumn("__piece", F.pmod("__mix", "__pieces").cast("int")).drop("__pieces")
    pieces = keep(rows.groupBy("curve", "__piece").agg(F.count("*").alias("__n")))
    total = max(pieces.agg(F.sum("__n")).first()[0] or 0, 1)
    over_cells = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # one row per cell
    before = cells.select("curve", F.coalesce(F.sum("__n").over(over_cells), F.lit(0)).alias("__before"))
    in_cell = Window.partitionBy("curve").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum("__n").over(in_cell), F.lit(0))
    starts = keep(pieces.join(F.broadcast(before), "curve").select("curve", "__piece", start.alias("__start")))

    own = Window.partitionBy("curve", "__piece").orderBy("doc_id", "__mix")
    placed = rows.withColumn("__no", F.row_number().over(own)).join(starts, ["curve", "__piece"])
    placed = placed.withColumn("__rank", F.col("__start") + F.col("__no") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((__rank * {shards}L) div {total}L as int)"))
    slot = F.expr(f"__rank - (shard * {total}L + {shards - 1}L) div {shards}L")  # its shard's first rank is that quotient
    return placed.select(*names, "curve", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, folder: str, *, shards: int = 24) -> None:
    """Write ``docs`` as Parquet under ``shard=N``, each shard in curve order."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = sharded(docs.withColumn("size", utf8_size("text") + 8).withColumn("text_crc32", crc), shards=shards)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
