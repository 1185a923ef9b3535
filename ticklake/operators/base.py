"""Operators as values: what a row operator needs, adds and looks back."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..plans.ordered import TICKS, Order, rolling


class MissingColumns(ValueError):
    """An operator's required columns are not in its input."""


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


@dataclass(frozen=True)
class RowOp:
    """A bounded-lookback operator.  ``fn(rows, window)`` adds its columns."""

    name: str
    requires: tuple[str, ...]
    back: int
    fn: Callable[[DataFrame, WindowSpec], DataFrame]
    ahead: int = 0

    def __call__(self, df: DataFrame, order: Order = TICKS) -> DataFrame:
        require_columns(df, (*order.keys, order.ts, *order.tie, *self.requires))
        return rolling(df, self.fn, self.back, self.ahead, order)


def apply_together(df: DataFrame, ops: Iterable[RowOp], order: Order = TICKS, strict: bool = True) -> DataFrame:
    """Run several row operators in one blocked pass (one shared exchange).

    With ``strict=False`` an operator whose columns are missing is skipped.
    """
    ops = list(ops)
    if strict:
        for op in ops:
            require_columns(df, op.requires)
    else:
        ops = [op for op in ops if all(c in df.columns for c in op.requires)]

    def run(rows: DataFrame, w: WindowSpec) -> DataFrame:
        for op in ops:
            rows = op.fn(rows, w)
        return rows

    return rolling(df, run, max((o.back for o in ops), default=0), max((o.ahead for o in ops), default=0), order)


def flag(cond: Column) -> Column:
    """1 where true, 0 where false or NULL."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def nz(x: Column) -> Column:
    """NULL for zero, for use as a denominator."""
    return F.nullif(x, F.lit(0))


def safe_div(x: Column, y: Column) -> Column:
    return x / nz(y)


def price_col(df: DataFrame) -> str:
    """The price column of a table: ``Close``, then ``mid``, then ``Bid``."""
    for c in ("Close", "mid", "Bid"):
        if c in df.columns:
            return c
    raise MissingColumns("missing columns: Close, mid or Bid")


def sign_int(x: Column) -> Column:
    return F.coalesce(F.signum(x), F.lit(0.0)).cast("int")


def crossing(fast: Column, slow: Column, prev_fast: Column, prev_slow: Column) -> Column:
    """+1 on a cross from below, -1 on a cross from above, else 0."""
    return flag((fast > slow) & (prev_fast <= prev_slow)) - flag((fast < slow) & (prev_fast >= prev_slow))
