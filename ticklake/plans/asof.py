"""Point-in-time joins.

The right table is interleaved with the left one in time order and the last
right row seen is carried forward with ``running``: one shuffle by
(key, time bucket), no range join, no per-key task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import TICKS, Order, micros, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    right_ts: str,
    right_tie: Sequence[str] = (),
    order: Order = TICKS,
    forward: bool = False,
    keep_ts: str | None = None,
    max_age_seconds: float | None = None,
) -> DataFrame:
    """Add to each left row ``cols`` of the newest right row not after it.

    Equal times match.  ``right_tie`` decides among right rows of one time (the
    largest wins).  ``forward`` takes the oldest right row not before instead,
    ``keep_ts`` also returns the matched time, ``max_age_seconds`` drops
    matches further away.
    """
    keys = list(order.keys)
    payload = F.struct(F.col(right_ts).alias("__rts"), *[F.col(c) for c in cols])
    ties = [F.col(c) for c in right_tie] or [F.lit(0)]
    tie = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(ties)])
    flip = F.lit(1 if forward else 0)
    right_rows = right.where(F.col(right_ts).isNotNull()).select(
        *keys,
        F.col(right_ts).alias(order.ts),
        flip.alias("__side"),
        tie.alias("__tie"),
        payload.alias("__right"),
    )
    left_rows = left.select(
        *keys,
        F.col(order.ts),
        (F.lit(1) - flip).alias("__side"),
        F.struct(*left.columns).alias("__left"),
    )
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    seek = replace(order, tie=("__side", "__tie"))
    found = running(both, {"__hit": ("last", F.col("__right"))}, seek, reverse=forward)
    found = found.where(F.col("__left").isNotNull())
    hit: Column = F.col("__hit")
    for k in keys:  # rows without key stay, and match nothing
        hit = F.when(F.col(k).isNotNull(), hit)
    found = found.withColumn("__hit", hit)
    hit = F.col("__hit")
    if max_age_seconds is not None:
        gap = F.abs(micros(order.ts) - micros(F.col("__hit.__rts")))
        hit = F.when(gap <= F.lit(int(max_age_seconds * 1_000_000)), hit)
        found = found.withColumn("__hit", hit)
    out = [F.col(f"__left.{c}").alias(c) for c in left.columns]
    out += [F.col(f"__hit.{c}").alias(c) for c in cols]
    if keep_ts:
        out.append(F.col("__hit.__rts").alias(keep_ts))
    return found.select(*out)
