"""Exact parallel runs of finite-state machines over long ordered series.

A machine with ``k`` states turns a block of rows into a table "state on entry
-> state on exit".  Tables compose like the affine pairs of ``linear_scan``, so
a series of any length is cut into blocks: tables per block, a scan over the
tables, then every block is replayed from its known entry state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from .ordered import BLK, IDX, TICKS, Order, join_same, row_index

# step(state, row values) -> next state; states are 0..k-1
Step = Callable[[int, tuple], int]


def finite_machine(
    df: DataFrame,
    inputs: Sequence[str],
    step: Step,
    states: int,
    start: int,
    out: str,
    order: Order = TICKS,
) -> DataFrame:
    """Add ``out``, the state after each row."""
    keys = list(order.keys)
    cols = list(inputs)
    rows = row_index(df, order).withColumn(BLK, F.floor(F.col(IDX) / order.scan_rows).cast("long"))
    table_schema = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField(BLK, T.LongType()), T.StructField("__map", T.ArrayType(T.IntegerType()))]
    )

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        now = list(range(states))
        for vals in pdf[cols].itertuples(index=False, name=None):
            now = [step(s, vals) for s in now]
        row = {k: pdf[k].iloc[0] for k in [*keys, BLK]}
        return pd.DataFrame([{**row, "__map": now}])[table_schema.names]

    tables = rows.select(*keys, BLK, IDX, *cols).groupBy(*keys, BLK).applyInPandas(tabulate, table_schema)
    entry_schema = T.StructType([*table_schema.fields[:-1], T.StructField("__in", T.IntegerType())])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLK)
        now, seen = start, []
        for table in pdf["__map"]:
            seen.append(now)
            now = int(table[now])
        return pdf.assign(__in=seen)[entry_schema.names]

    entries = tables.groupBy(*keys).applyInPandas(enter, entry_schema)
    joined = join_same(rows, entries, [*keys, BLK])
    out_schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        now, seen = int(pdf["__in"].iloc[0]), []
        for vals in pdf[cols].itertuples(index=False, name=None):
            now = step(now, vals)
            seen.append(now)
        return pdf.assign(**{out: seen})[out_schema.names]

    return joined.groupBy(*keys, BLK).applyInPandas(replay, out_schema)


# run(entry state, rows as tuples) -> (one output tuple per row, block summary)
RunBlock = Callable[[tuple, list], tuple[list, Sequence[float]]]
# merge(entry state, block summary) -> entry state of the next block
Merge = Callable[[tuple, Sequence[float]], Sequence[float]]


def settled_scan(
    df: DataFrame,
    inputs: Sequence[str],
    outs: T.StructType,
    start: Sequence[float],
    run: RunBlock,
    merge: Merge,
    order: Order = TICKS,
) -> DataFrame:
    """Exact parallel run of a sequential machine whose state is a list of numbers.

    All blocks are run at once from assumed entry states; the entry states that
    follow from their summaries are compared with the assumed ones, and blocks
    whose entry changed are run again until none does.  The first block of a
    key is right after one round, so every round settles at least one more
    block; machines that forget, or whose decisions hardly depend on small
    changes of their statistics, settle in a few rounds.  Only block summaries
    are kept between rounds.
    """
    keys, cols = list(order.keys), list(inputs)
    rows = row_index(df, order).withColumn(BLK, F.floor(F.col(IDX) / order.scan_rows).cast("long"))
    rows = checkpoint(rows)
    narrow = rows.select(*keys, BLK, IDX, *cols)
    key_fields = [df.schema[k] for k in keys]
    arr = T.ArrayType(T.DoubleType())
    block_schema = T.StructType([*key_fields, T.StructField(BLK, T.LongType()), T.StructField("__entry", arr), T.StructField("__sum", arr)])
    next_schema = T.StructType([*block_schema.fields, T.StructField("__next", arr)])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        entry = pdf["__entry"].iloc[0]
        _, summary = run(tuple(entry), list(pdf[cols].itertuples(index=False, name=None)))
        row = {k: pdf[k].iloc[0] for k in [*keys, BLK]}
        return pd.DataFrame([{**row, "__entry": entry, "__sum": list(map(float, summary))}])[block_schema.names]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLK)
        now, entries = list(map(float, start)), []
        for s in pdf["__sum"]:
            entries.append(now)
            now = list(map(float, merge(tuple(now), s)))
        return pdf.assign(__next=entries)[next_schema.names]

    def run_blocks(which: DataFrame) -> DataFrame:
        return join_same(narrow, which, [*keys, BLK]).groupBy(*keys, BLK).applyInPandas(summarise, block_schema)

    first = narrow.select(*keys, BLK).distinct().withColumn("__entry", F.array(*[F.lit(float(x)) for x in start]))
    state = checkpoint(run_blocks(first))
    while True:
        chained = checkpoint(state.groupBy(*keys).applyInPandas(chain, next_schema))
        moved = F.col("__entry") != F.col("__next")
        stale = chained.where(moved)
        if stale.limit(1).count() == 0:
            break
        again = run_blocks(stale.select(*keys, BLK, F.col("__next").alias("__entry")))
        state = checkpoint(chained.where(~moved).drop("__next").unionByName(again))

    out_schema = T.StructType([*df.schema.fields, *outs.fields])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        got, _ = run(tuple(pdf["__entry"].iloc[0]), list(pdf[cols].itertuples(index=False, name=None)))
        for i, f in enumerate(outs.fields):
            pdf[f.name] = [g[i] for g in got]
        return pdf[out_schema.names]

    entries = state.select(*keys, BLK, "__entry")
    return join_same(rows, entries, [*keys, BLK]).groupBy(*keys, BLK).applyInPandas(replay, out_schema)
