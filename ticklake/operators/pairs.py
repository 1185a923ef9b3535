"""Cross-section and pair operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import BLK, IDX, Order, attach, full, halo_blocks, rolling
from ..plans.steps import finite_machine
from .base import flag, nz, safe_div

c = F.col


def pair_order(order: Order = Order()) -> Order:
    return Order(("a", "b"), order.ts, (), order.bucket_seconds, order.block_rows, order.scan_rows)


def pair_list(df: DataFrame, whitelist=None, both_ways: bool = True, ts: str = "Timestamp") -> DataFrame:
    """(a, b) pairs of the symbols of ``df`` (or of the whitelist) that have a time in common."""
    names = df.select("Symbol", ts).where(c("Symbol").isNotNull()).distinct()
    if whitelist is not None:
        names = names.where(c("Symbol").isin(list(whitelist)))
    both = names.withColumnRenamed("Symbol", "a").join(names.withColumnRenamed("Symbol", "b"), ts)
    return both.where(c("a") != c("b") if both_ways else c("a") < c("b")).select("a", "b").distinct()


def pair_rows(df: DataFrame, pairs: DataFrame, value: str, ts: str = "Timestamp") -> DataFrame:
    """J08 one row (a, b, time, x, y) per listed pair and common time.

    Only listed pairs are made: the pair list is joined on its first symbol,
    the other side by an equi join on (time, symbol).
    """
    x = df.select(c("Symbol").alias("a"), ts, c(value).alias("x"))
    y = df.select(c("Symbol").alias("b"), ts, c(value).alias("y"))
    return x.join(pairs, "a").join(y, ["b", ts]).select("a", "b", ts, "x", "y")


def relative_strength(df: DataFrame, value: str = "return", ts: str = "Timestamp") -> DataFrame:
    """W28 distance from the cross-section mean in population deviations."""
    w = Window.partitionBy(ts)  # one row per symbol
    return df.withColumn("rel_strength", safe_div(c(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def strongest_weakest(df: DataFrame, strength: str = "rel_strength", hedge: float = 1.0, ts: str = "Timestamp") -> DataFrame:
    """W29 +1 for the strongest symbol of a time, -hedge for the weakest; ties go to the first name."""
    d = df.groupBy(ts).agg(
        F.min_by("Symbol", F.struct(-c(strength), c("Symbol"))).alias("__hi"),
        F.min_by("Symbol", F.struct(c(strength), c("Symbol"))).alias("__lo"),
        F.count(strength).alias("__n"),
    )
    live = (c("__n") >= 2) & (c("__hi") != c("__lo"))
    sig = F.when(live & (c("Symbol") == c("__hi")), 1.0).when(live & (c("Symbol") == c("__lo")), -float(hedge)).otherwise(0.0)
    return df.join(d, ts).withColumn("signal", sig).drop("__hi", "__lo", "__n")


def pair_features(pairs_long: DataFrame, n: int = 30, order: Order = pair_order()) -> DataFrame:
    """W30 rolling correlation and return ratio of each pair (long form)."""

    def fn(d, w):
        f = w.rowsBetween(-(n - 1), 0)
        ok = F.count(F.when(c("x").isNotNull() & c("y").isNotNull(), 1)).over(f) == n
        flat = (F.min("x").over(f) == F.max("x").over(f)) | (F.min("y").over(f) == F.max("y").over(f))
        d = d.withColumn("__flat", flat)
        d = d.withColumn("corr", F.when(ok & ~c("__flat"), F.corr("x", "y").over(f)))
        return d.withColumn("ratio", safe_div(c("x"), c("y"))).drop("__flat")

    return rolling(pairs_long, fn, n - 1, 0, order)


def all_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """All pairs (a < b) of symbols of ``df`` with a common time, in order: the columns of a wide table."""
    return sorted((r["a"], r["b"]) for r in pair_list(df, both_ways=False).collect())


def widen_pairs(features: DataFrame, pairs: list[tuple[str, str]], value: str = "corr") -> DataFrame:
    """Columns ``<value>_a_b`` for a named pair list, one row per time; missing values 0."""
    cols = [F.coalesce(F.max(F.when((c("a") == a) & (c("b") == b), c(value))), F.lit(0.0)).alias(f"{value}_{a}_{b}") for a, b in pairs]
    return features.groupBy("Timestamp").agg(*cols)


def pair_correlation(pairs_long: DataFrame) -> DataFrame:
    """Correlation of each pair over all rows."""
    d = pairs_long.groupBy("a", "b").agg(
        F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("__x"), F.stddev_pop("y").alias("__y")
    )
    return d.withColumn("corr", F.when((c("__x") > 0) & (c("__y") > 0), c("corr"))).drop("__x", "__y")


def top_pairs(pairs_long: DataFrame, k: int) -> DataFrame:
    """K03 the ``k`` pairs (a < b) with the largest absolute correlation; missing counts 0."""
    d = pair_correlation(pairs_long.where(c("a") < c("b"))).withColumn("corr", F.coalesce(c("corr"), F.lit(0.0)))
    return d.orderBy(F.abs(F.round("corr", 12)).desc(), "a", "b").limit(k).select("a", "b", "corr")


def confirmation(features: DataFrame, target: str | None = None, related: list[str] | None = None) -> DataFrame:
    """W31 sum over related symbols of last correlation times sign of their last move, with the parts.

    Without ``target`` every symbol is scored; without ``related`` all others count.
    """
    if target is not None:
        features = features.where(c("a") == target)
    if related is not None:
        features = features.where(c("b").isin(related))
    last = features.where(c("a") != c("b")).groupBy("a", "b").agg(F.max_by(F.struct("corr", "y"), c("Timestamp")).alias("l"))
    parts = last.select("a", "b", c("l.corr").alias("corr"), (c("l.corr") * F.signum("l.y")).alias("part")).where(c("corr").isNotNull())
    return parts.groupBy(c("a").alias("Symbol")).agg(
        F.sum("part").alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "corr")))).alias("correlations")
    )


def adjacency(features: DataFrame) -> DataFrame:
    """W32 edge list (time, src, dst, weight) of rolling correlations; unknown weights 0."""
    return features.select("Timestamp", c("a").alias("src"), c("b").alias("dst"), F.coalesce(c("corr"), F.lit(0.0)).alias("weight"))


def correlation_graph(pairs_long: DataFrame, threshold: float) -> DataFrame:
    """W32 edges between symbols whose whole-period correlation is at least ``threshold`` in size."""
    d = pair_correlation(pairs_long.where(c("a") < c("b")))
    return d.where(F.abs("corr") >= threshold).select(c("a").alias("src"), c("b").alias("dst"), c("corr").alias("weight"))


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, n)


def coherence(pairs_long: DataFrame, n: int = 64, order: Order = pair_order()) -> DataFrame:
    """W33 rolling squared coherence over the half spectrum, by blocks with a halo."""
    rows, _ = halo_blocks(pairs_long, order, n - 1)
    schema = T.StructType([*pairs_long.schema.fields, T.StructField("coherence", T.DoubleType())])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        out = np.full(len(pdf), np.nan)
        if len(pdf) >= n:
            x, y = _windows(pdf["x"].to_numpy(float), n), _windows(pdf["y"].to_numpy(float), n)
            fx = np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)
            fy = np.fft.rfft(y - y.mean(axis=1, keepdims=True), axis=1)
            cross = np.abs((fx.conj() * fy).sum(axis=1)) ** 2
            power = (np.abs(fx) ** 2).sum(axis=1) * (np.abs(fy) ** 2).sum(axis=1)
            out[n - 1 :] = np.divide(cross, power, out=np.zeros_like(cross), where=power != 0)
        pdf["coherence"] = out
        return pdf[pdf[BLK] == pdf["__home"]][schema.names]

    return rows.groupBy(*order.keys, BLK).applyInPandas(block, schema)


DTW_ROWS = 4_096  # windows whose tables are filled at once


def _dtw(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Root of the least sum of squared differences along a warping path, for every row of ``x`` and ``y``.

    The cost tables of all rows are filled together, anti-diagonal by
    anti-diagonal; a single row (1-d) gives a single distance.
    """
    if x.ndim == 1:
        return float(_dtw(x[None], y[None])[0])
    out = np.empty(len(x))
    n, m = x.shape[1], y.shape[1]
    for at in range(0, len(x), DTW_ROWS):
        a, b = x[at : at + DTW_ROWS].T, y[at : at + DTW_ROWS].T  # a row of the table is contiguous
        before, last = np.full((n + 1, a.shape[1]), np.inf), np.full((n + 1, a.shape[1]), np.inf)
        before[0] = 0.0  # diagonal 0 of the padded table
        for d in range(2, n + m + 1):
            now = np.full_like(last, np.inf)
            lo, hi = max(1, d - m), min(n, d - 1)
            cost = (a[lo - 1 : hi] - b[d - hi - 1 : d - lo][::-1]) ** 2
            now[lo : hi + 1] = cost + np.minimum(np.minimum(last[lo - 1 : hi], last[lo : hi + 1]), before[lo - 1 : hi])
            before, last = last, now
        out[at : at + DTW_ROWS] = np.sqrt(last[n])
    return out


def _rolling_dtw(x: np.ndarray, y: np.ndarray | None, motif: np.ndarray | None, home: np.ndarray, n: int) -> np.ndarray:
    """Distance of the last ``n`` values of ``x`` to those of ``y`` or to ``motif``, for the rows of ``home`` that have ``n``."""
    out, rows = np.full(len(x), np.nan), np.flatnonzero(home)
    rows = rows[rows >= n - 1]
    if len(rows):
        a = _windows(x, n)[rows - n + 1]
        out[rows] = _dtw(a, _windows(y, n)[rows - n + 1] if motif is None else np.broadcast_to(motif, (len(rows), n)))
    return out


def dtw_pairs(pairs_long: DataFrame, n: int = 30, order: Order = pair_order()) -> DataFrame:
    """W34 rolling warping distance of each pair over ``n`` rows, by blocks with a halo."""
    rows, _ = halo_blocks(pairs_long, order, n - 1)
    schema = T.StructType([*pairs_long.schema.fields, T.StructField("dtw", T.DoubleType())])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        home = (pdf[BLK] == pdf["__home"]).to_numpy()
        pdf["dtw"] = _rolling_dtw(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), None, home, n)
        return pdf[home][schema.names]

    return rows.groupBy(*order.keys, BLK).applyInPandas(block, schema)


def dtw_motifs(df: DataFrame, value: str, motifs: dict[str, list[float]], order: Order = Order()) -> DataFrame:
    """W34 warping distance of the last rows to stored motifs."""
    n = max(len(m) for m in motifs.values())
    rows, _ = halo_blocks(df, order, n - 1)
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"dtw_{k}", T.DoubleType()) for k in motifs]])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        x, home = pdf[value].to_numpy(float), (pdf[BLK] == pdf["__home"]).to_numpy()
        for k, motif in motifs.items():
            pdf[f"dtw_{k}"] = _rolling_dtw(x, None, np.asarray(motif, float), home, len(motif))
        return pdf[home][schema.names]

    return rows.groupBy(*order.keys, BLK).applyInPandas(block, schema)


def hedge_spread(pairs_long: DataFrame, n: int = 20, order: Order = pair_order()) -> DataFrame:
    """W35 hedge ratio of y-on-x regression over the whole history and rolling z-score of the spread.

    ``x`` is the first symbol of the pair, regressed on the second.
    """
    beta = pairs_long.groupBy("a", "b").agg(F.regr_slope("x", "y").alias("hedge"))
    d = attach(pairs_long, beta, ["a", "b"], [order.ts]).withColumn("spread", c("x") - c("hedge") * c("y"))

    def fn(d, w):
        d = d.withColumns({"__m": full(F.avg, "spread", n, w), "__s": full(F.stddev_samp, "spread", n, w)})
        return d.withColumn("z", safe_div(c("spread") - c("__m"), c("__s"))).drop("__m", "__s")

    return rolling(d, fn, n - 1, 0, order)


def z_crossings(d: DataFrame, low: float = -2.0, high: float = 2.0, order: Order = pair_order()) -> DataFrame:
    """W47 entries where the z-score crosses a threshold; any pair counts for a time."""

    def fn(d, w):
        p = F.lag("z").over(w)
        return d.withColumns({"__l": flag((c("z") < low) & (p >= low)), "__s": flag((c("z") > high) & (p <= high))})

    d = rolling(d, fn, 1, 0, order)
    return d.groupBy(order.ts).agg(F.max("__l").alias("pair_long"), F.max("__s").alias("pair_short"))


def pair_positions(d: DataFrame, entry: float = 2.0, exit_: float = 0.5, order: Order = pair_order()) -> DataFrame:
    """W48 position of a pair with entry and exit bands, its entries and spread result.

    Three states (flat, long, short), so blocks compose exactly.
    """
    FLAT, LONG, SHORT = 0, 1, 2

    def step(state: int, row: tuple) -> int:
        z = row[0]
        if z is None or z != z:
            return state
        if state == FLAT:
            return LONG if z < -entry else SHORT if z > entry else FLAT
        done = z > -exit_ if state == LONG else z < exit_
        return FLAT if done else state

    d = finite_machine(d, ["z"], step, 3, FLAT, "__st", order)
    d = d.withColumn("position", F.when(c("__st") == LONG, 1).when(c("__st") == SHORT, -1).otherwise(0))

    def fn(d, w):
        was = F.coalesce(F.lag("position").over(w), F.lit(0))
        move = c("spread") - F.lag("spread").over(w)
        return d.withColumns(
            {
                "pair_long": flag((c("position") == 1) & (was == 0)),
                "pair_short": flag((c("position") == -1) & (was == 0)),
                "pair_pnl": F.coalesce(F.when(c("z").isNotNull(), c("position") * move), F.lit(0.0)),
            }
        )

    return rolling(d.drop("__st"), fn, 1, 0, order)


def pair_signal_totals(d: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """W48 entries and result over all pairs by time."""
    return d.groupBy(ts).agg(F.sum("pair_long").alias("pair_long"), F.sum("pair_short").alias("pair_short"), F.sum("pair_pnl").alias("pair_pnl"))


def latest_correlations(pairs_long: DataFrame, n: int) -> DataFrame:
    """W55 correlation matrix (long) of the last ``n`` rows of each pair."""
    w = Window.partitionBy("a", "b").orderBy(c("Timestamp").desc())
    tail = pairs_long.withColumn("__rn", F.row_number().over(w)).where(c("__rn") <= n).drop("__rn")
    return pair_correlation(tail)
