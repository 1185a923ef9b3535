"""Structured Streaming forms.

Sequential per-key logic uses ``applyInPandasWithState``; operators that already
exist for batches run in ``foreachBatch`` over the new rows plus a bounded tail
of earlier rows kept as a table per batch id, so a replayed batch gives the same
rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.base import RowOp, apply_together
from ..operators.quality import _tick_filter
from ..operators.risk import last_rows
from ..plans.ordered import TICKS, Order
from ..sources.scans import path_exists, remove

c = F.col


def tick_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """T01/T12 file stream of ticks; the trigger size is the rate limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Process what is there, write Parquet, stop."""
    w = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.trigger(availableNow=True).start().awaitTermination()


def record(df: DataFrame, path: str, checkpoint: str, ts: str = "Timestamp") -> None:
    """T09/IO09 recorder: append to date partitions."""
    run_available(df.withColumn("date", F.to_date(ts)), path, checkpoint, partition_by=["date"])


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Call ``fn(batch, batch id)`` for what is there."""
    q = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_operator(
    df: DataFrame, op: RowOp | Sequence[RowOp], lookback: int, out: str, state: str, checkpoint: str, order: Order = TICKS
) -> None:
    """T02 run row operators over each micro-batch with ``lookback`` earlier rows per key; write new rows only.

    An operator that looks further back, or ahead, is an error.
    """
    ops = [op] if isinstance(op, RowOp) else list(op)
    for o in ops:
        if o.back > lookback or o.ahead:
            raise ValueError(f"{o.name} looks {o.back} rows back and {o.ahead} ahead; the stream keeps {lookback}")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__new", F.lit(True))
        before = f"{state}/{batch_id - 1}"
        if batch_id and path_exists(spark, before):
            rows = rows.unionByName(spark.read.parquet(before).withColumn("__new", F.lit(False)))
        apply_together(rows, ops, order).where("__new").drop("__new").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last_rows(rows.drop("__new"), lookback, order).write.mode("overwrite").parquet(f"{state}/{batch_id}")
        remove(spark, f"{state}/{batch_id - 2}")

    run_batches(df, step, checkpoint)


def stream_labels(
    df: DataFrame, label: Callable[[DataFrame], DataFrame], horizon: int, out: str, state: str, checkpoint: str, order: Order = TICKS
) -> None:
    """T03 labels that look ``horizon`` rows ahead: a row is written once its horizon is complete.

    The last ``horizon`` rows of each key wait in the state table; ``flush_labels``
    writes them when the stream has ended.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{state}/{batch_id - 1}"
        rows = batch
        if batch_id and path_exists(spark, before):
            rows = rows.unionByName(spark.read.parquet(before))
        waiting = last_rows(rows, horizon, order)
        waiting.write.mode("overwrite").parquet(f"{state}/{batch_id}")
        ids = [*order.keys, order.ts, *order.tie]
        done = label(rows).join(spark.read.parquet(f"{state}/{batch_id}").select(*ids), ids, "left_anti")
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        remove(spark, f"{state}/{batch_id - 2}")

    run_batches(df, step, checkpoint)


def flush_labels(spark: SparkSession, label: Callable[[DataFrame], DataFrame], last_batch: int, out: str, state: str) -> None:
    """T03 write the rows still waiting."""
    label(spark.read.parquet(f"{state}/{last_batch}")).write.mode("overwrite").parquet(f"{out}/batch={last_batch + 1}")


def filter_stream(df: DataFrame, threshold: float = 3.0, key: str = "Symbol", ts: str = "Timestamp", tie: str = "seq", order: Order = TICKS) -> DataFrame:
    """T04 sequential tick filter: accepted ticks only, statistics in the state of the key.

    A task holds a key's rows of one batch as columns and runs them ``order.scan_rows`` at a time.
    """
    start, run, merge = _tick_filter(threshold)
    out_schema = df.schema

    def step(k, batches, state: GroupState):
        # squares are taken about the first spread of the key
        now, centre = (list(state.get[:-1]), state.get[-1]) if state.exists else (list(start), None)
        pdf = pd.concat([b.drop(columns=key) for b in batches], ignore_index=True)
        place = pdf[[ts, tie]].sort_values([ts, tie]).index.to_numpy()
        for at in range(0, len(place), order.scan_rows):
            part = pdf.iloc[place[at : at + order.scan_rows]]
            spread = part["Ask"] - part["Bid"]
            centre = float(spread.iloc[0]) if centre is None else centre
            us = (part[ts] - pd.Timestamp("1970-01-01")) / pd.Timedelta(microseconds=1)
            kept, summary = run(tuple(now), zip(spread - centre, (part["Ask"] + part["Bid"]) / 2, us, part["Ask"] <= part["Bid"]))
            now = merge(tuple(now), summary)
            yield part[[x[0] for x in kept]].assign(**{key: k[0]})[out_schema.names]
        state.update((*now, centre))

    state_schema = ", ".join(f"s{i} double" for i in range(len(start) + 1))
    return df.groupBy(key).applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def _ordered(batches, cols: Sequence[str]) -> pd.DataFrame:
    """The rows of a key that came in this batch, in order of ``cols``."""
    return pd.concat(list(batches)).sort_values(list(cols), kind="stable")


def _first(hit: np.ndarray) -> int | None:
    return int(hit.argmax()) if hit.any() else None


def page_hinkley(df: DataFrame, value: str = "value", key: str = "feature", ts: str = "Timestamp", delta: float = 0.005, threshold: float = 50.0, tie: Sequence[str] = ()) -> DataFrame:
    """T06 upward mean-shift alarms per feature; the detector starts anew after each.

    Over the values since the last alarm: ``m[t] = sum(x[i] - mean(x[..i]) - delta)``
    for i up to t, and an alarm where m has risen more than ``threshold`` over its
    least value so far (0 at the start).  All are prefix sums and minima of the
    stretch, which is gone through once per alarm, not row by row; count, sum, m and
    its least value go on to the next batch.
    """
    schema = T.StructType([df.schema[key], df.schema[ts], T.StructField("level", T.DoubleType())])

    def step(k, batches, state: GroupState):
        seen = np.array(state.get if state.exists else (0.0,) * 4)  # count, sum, m, least m
        pdf = _ordered(batches, [ts, *tie])
        left, times, out = pdf[value].to_numpy(float), pdf[ts].to_numpy(), []
        while len(left):
            count = seen[0] + np.arange(1, len(left) + 1)
            sums = seen[1] + left.cumsum()
            m = seen[2] + (left - sums / count - delta).cumsum()
            least = np.minimum(np.minimum.accumulate(m), seen[3])
            alarm = _first(m - least > threshold)
            if alarm is None:
                seen = np.array((count[-1], sums[-1], m[-1], least[-1]))
                break
            out.append((k[0], times[alarm], m[alarm] - least[alarm]))
            left, times, seen = left[alarm + 1 :], times[alarm + 1 :], np.zeros(4)
        state.update(tuple(map(float, seen)))
        yield pd.DataFrame(out, columns=schema.names)

    return df.groupBy(key).applyInPandasWithState(step, schema, "n double, total double, m double, least double", "append", GroupStateTimeout.NoTimeout)


def _first_split(window: np.ndarray, delta: float, edge: int = 5) -> int | None:
    """First place with ``edge`` values on either side where the means of both sides differ by more than chance allows."""
    at = np.arange(edge, len(window) - edge)
    if len(window) <= 2 * edge or not len(at):
        return None
    sums = window.cumsum()
    gap = sums[at - 1] / at - (sums[-1] - sums[at - 1]) / (len(window) - at)
    place = _first(np.abs(gap) > np.sqrt(2 * np.log(1 / delta) / at))
    return None if place is None else int(at[place])


def adaptive_window(df: DataFrame, value: str = "value", key: str = "feature", ts: str = "Timestamp", delta: float = 0.002, limit: int = 200, tie: Sequence[str] = ()) -> DataFrame:
    """T06 window drift alarms: the window (``limit`` values at most) loses its older part where both parts' means differ too much."""
    schema = T.StructType([df.schema[key], df.schema[ts]])

    def step(k, batches, state: GroupState):
        kept = np.array(state.get[0] if state.exists else [], float)
        pdf = _ordered(batches, [ts, *tie])
        values = np.concatenate((kept, pdf[value].to_numpy(float)))
        start, alarms = 0, []  # the window is values[start:end]
        for end in range(len(kept) + 1, len(values) + 1):
            before = start
            while (place := _first_split(values[start:end], delta)) is not None:
                start += place
            if start > before:
                alarms.append(end - 1 - len(kept))
            start = max(start, end - limit)
        state.update((values[start:].tolist(),))
        yield pd.DataFrame({key: k[0], ts: pdf[ts].to_numpy()[alarms]}, columns=schema.names)

    return df.groupBy(key).applyInPandasWithState(step, schema, "window array<double>", "append", GroupStateTimeout.NoTimeout)


STEP = 8_192  # rows whose windows are held at once


def _rolled(before: Sequence[float], new: np.ndarray, n: int, ddof: int):
    """``(place, length, mean, deviation, share above 0)`` of the last ``n`` values at each of ``new``, ``STEP`` rows at a time.

    NaN counts for the length and as not above 0, and is left out of mean and deviation.
    Each window is summed by itself, so values do not depend on where a batch or a step begins.
    """
    values = np.concatenate((np.asarray(before, float), new))
    short = max(0, min(n - 1 - len(before), len(new)))  # rows whose window is not full
    if short:
        rows = [pd.Series(values[: len(before) + i + 1]) for i in range(short)]
        yield slice(0, short), np.array([len(s) for s in rows]), *(np.array([f(s) for s in rows], float) for f in (lambda s: s.mean(), lambda s: s.std(ddof=ddof), lambda s: (s > 0).mean()))
    for at in range(short, len(new), STEP):
        end = min(at + STEP, len(new))
        w = np.lib.stride_tricks.sliding_window_view(values[len(before) + at - n + 1 : len(before) + end], n)
        known = ~np.isnan(w)
        count = known.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(known, w, 0.0).sum(axis=1) / count
            spread = np.where(known, (mean[:, None] - w) ** 2, 0.0).sum(axis=1)
            sd = np.sqrt(np.where(count > ddof, spread / (count - ddof), np.nan))
        yield slice(at, end), np.full(end - at, n), mean, sd, (w > 0).mean(axis=1)


def _last(before: Sequence[float], new: np.ndarray, n: int) -> list[float]:
    return [*before, *new[-n:].tolist()][-n:]


def algorithm_health(
    df: DataFrame, pnl: str = "pnl", key: str = "algorithm", ts: str = "Timestamp", n: int = 100, min_sharpe=0.0, min_win=0.5, cooldown_seconds: float = 300.0, tie: Sequence[str] = ()
) -> DataFrame:
    """T08 enabled flag per result: disabled on poor Sharpe or win rate, looked at again after the cooldown."""
    schema = T.StructType([df.schema[key], df.schema[ts], T.StructField("sharpe", T.DoubleType()), T.StructField("win_rate", T.DoubleType()), T.StructField("enabled", T.BooleanType())])

    def step(k, batches, state: GroupState):
        recent, until = (list(state.get[0]), state.get[1]) if state.exists else ([], -1.0)
        pdf = _ordered((b[[ts, *tie, pnl]] for b in batches), [ts, *tie])
        x, times = pdf[pnl].to_numpy(float), pdf[ts]
        seconds = ((times - pd.Timestamp("1970-01-01")) / pd.Timedelta(microseconds=1)).to_numpy(float) / 1e6
        for rows, length, mean, sd, win in _rolled(recent, x, n, 1):
            sharpe = np.where(length > 1, mean / (sd + 1e-8) * np.sqrt(length), 0.0)
            enabled = []
            for now, good in zip(seconds[rows].tolist(), ((sharpe >= min_sharpe) & (win >= min_win)).tolist()):
                if until < 0 or now >= until:  # enabled, or cooldown over
                    until = -1.0 if good else now + cooldown_seconds
                enabled.append(until < 0)
            yield pd.DataFrame({key: k[0], ts: times.iloc[rows].array, "sharpe": sharpe, "win_rate": win, "enabled": enabled}, columns=schema.names)
        state.update((_last(recent, x, n), until))

    return df.groupBy(key).applyInPandasWithState(step, schema, "recent array<double>, until double", "append", GroupStateTimeout.NoTimeout)


def equity(df: DataFrame, pnl: str = "pnl", key: str = "strategy", ts: str = "Timestamp", tie: str = "seq", n: int = 50) -> DataFrame:
    """T15 running equity, drawdown and rolling Sharpe of a result stream."""
    schema = T.StructType([df.schema[key], df.schema[tie], *[T.StructField(x, T.DoubleType()) for x in ("equity", "drawdown", "sharpe")]])

    def step(k, batches, state: GroupState):
        total, peak, recent = (state.get[0], state.get[1], list(state.get[2])) if state.exists else (0.0, -math.inf, [])
        pdf = _ordered((b[[ts, tie, pnl]] for b in batches), [ts, tie])
        x = pdf[pnl].to_numpy(float)
        for rows, _, mean, sd, _ in _rolled(recent, x, n, 0):
            sums = np.concatenate(([total], x[rows])).cumsum()[1:]  # one after the other, as over batches
            peaks = np.fmax.accumulate(np.concatenate(([peak], sums)))[1:]
            total, peak = float(sums[-1]), float(peaks[-1])
            sharpe = np.divide(mean, sd, out=np.zeros(len(sd)), where=sd > 0)
            yield pd.DataFrame({key: k[0], tie: pdf[tie].iloc[rows].array, "equity": sums, "drawdown": peaks - sums, "sharpe": sharpe}, columns=schema.names)
        state.update((total, peak, _last(recent, x, n)))

    return df.groupBy(key).applyInPandasWithState(step, schema, "total double, peak double, recent array<double>", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- moments in foreachBatch


def batch_moments(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean and squared distance of every column, long by column."""
    long = df.select(*keys, *[c(x).cast("double").alias(x) for x in cols]).unpivot(list(keys), list(cols), "column", "v").where("v is not null")
    return long.groupBy(*keys, "column").agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"))


def merge_moments(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """T07 moments of both tables together."""
    both = a.unionByName(b)
    total = F.sum("n")
    mean = F.sum(c("n") * c("mean")) / total
    spread = F.sum(c("m2") + c("n") * c("mean") * c("mean")) - total * mean * mean
    return both.groupBy(*keys, "column").agg(total.alias("n"), mean.alias("mean"), F.greatest(spread, F.lit(0.0)).alias("m2"))


def scale(df: DataFrame, moments: DataFrame, cols: Sequence[str]) -> DataFrame:
    """T07 standard scores by fitted moments (population deviation, 1 where it is 0)."""
    got = {r["column"]: r for r in moments.where(c("column").isin(list(cols))).collect()}  # one row per column
    new = {}
    for x in cols:
        r = got.get(x)
        if r is not None:
            sd = math.sqrt(r["m2"] / r["n"]) or 1.0
            new[x] = (c(x) - r["mean"]) / sd
    return df.withColumns(new)


def robust_scale(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """T07 full-history form: values clipped at exact percentiles, then (x - median) / interquartile range."""
    from ..plans.values import quantile_arrays

    long = df.unpivot([], list(cols), "column", "v").where("v is not null")
    q = {r["column"]: r["q"] for r in quantile_arrays(long, ["column"], "v", [low, 0.25, 0.5, 0.75, high], "q").collect()}
    new = {}
    for x, (lo, a, m, b, hi) in q.items():
        new[x] = (F.greatest(F.least(c(x), F.lit(hi)), F.lit(lo)) - m) / ((b - a) or 1.0)
    return df.withColumns(new)


def checked_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with the columns that T05 derives: ``spread`` of a quote, ``residual`` of a prediction; each only if its inputs are there."""
    new = {}
    if {"Bid", "Ask"} <= set(df.columns):
        new["spread"] = c("Ask").cast("double") - c("Bid").cast("double")
    if {"prediction", "target"} <= set(df.columns):
        new["residual"] = c("target").cast("double") - c("prediction").cast("double")
    taken = set(df.columns) & set(new) | set(cols) & {"prediction", "target", "Bid", "Ask", *new}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are derived or enter by what is derived from them")
    return df.withColumns(new)


def check_batches(df: DataFrame, cols: Sequence[str], out: str, quarantine: str, state: str, checkpoint: str, z: float = 3.0, max_rate: float = 0.2) -> None:
    """T05 batch check: statistics take the batch in first, then its values are scored.

    Checked are ``cols``, the spread of ``Bid`` and ``Ask`` and the residual of
    ``prediction`` and ``target``.  ``anomalies`` counts a row's values further than
    ``z`` deviations from the mean of all batches so far.  A batch goes to quarantine
    while anomalies per row, over all batches so far, are above ``max_rate``.  A NULL
    is never an anomaly.  Everything kept is a few rows per batch id, so a replayed
    batch gives the same result.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        d = checked_columns(batch, cols)
        checked = [*cols, *[x for x in ("spread", "residual") if x in d.columns]]
        now, before = batch_moments(d, checked), f"{state}/{batch_id - 1}"
        known = batch_id > 0 and path_exists(spark, before)
        if known:
            now = merge_moments(now, spark.read.parquet(before))
        now.write.mode("overwrite").parquet(f"{state}/{batch_id}")
        flags = []
        for r in spark.read.parquet(f"{state}/{batch_id}").collect():  # one row per column
            sd = math.sqrt(r["m2"] / (r["n"] - 1)) if r["n"] > 1 else 0.0
            if r["n"] > 10 and sd > 0:
                flags.append(F.coalesce(F.abs((c(r["column"]) - r["mean"]) / sd) > z, F.lit(False)).cast("int"))
        count = sum(flags[1:], flags[0]) if flags else F.lit(0)
        d = d.withColumn("anomalies", count).select(*batch.columns, "anomalies")
        rate = d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("anomalies"), F.lit(0)).alias("a"))
        if known:
            rate = rate.unionByName(spark.read.parquet(f"{before}.rate")).agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
        rate.coalesce(1).write.mode("overwrite").parquet(f"{state}/{batch_id}.rate")
        s = spark.read.parquet(f"{state}/{batch_id}.rate").first()
        target = quarantine if s["n"] and s["a"] / s["n"] > max_rate else out
        d.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        for old in (f"{state}/{batch_id - 2}", f"{state}/{batch_id - 2}.rate"):
            remove(spark, old)

    run_batches(df, step, checkpoint)


# ---------------------------------------------------------------- event-time forms


def zoned(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Event time as a zoned time, which watermarks need."""
    return df.withColumn(ts, c(ts).cast("timestamp"))


def bars(df: DataFrame, length: str, lateness: str, slide: str | None = None, ts: str = "Timestamp", key: str = "Symbol", value: str = "mid") -> DataFrame:
    """T13 open-ended bars by event-time window; rows later than ``lateness`` are dropped."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    agg = zoned(df, ts).withWatermark(ts, lateness).groupBy(key, w.alias("w")).agg(
        F.avg(value).alias("mean"), F.max(value).alias("high"), F.min(value).alias("low"), F.count(F.lit(1)).alias("n")
    )
    return agg.select(key, c("w.start").alias("start"), "mean", "high", "low", "n")


def sessions(df: DataFrame, gap: str, lateness: str, ts: str = "Timestamp", key: str = "Symbol") -> DataFrame:
    """T13 activity sessions that end after ``gap`` without rows."""
    agg = zoned(df, ts).withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(key, c("w.start").alias("start"), c("w.end").alias("end"), "n")


def dedupe(df: DataFrame, keys: Sequence[str], lateness: str, ts: str = "Timestamp") -> DataFrame:
    """T14 first row per key within the watermark."""
    return zoned(df, ts).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def feed_gaps(a: DataFrame, b: DataFrame, lateness: str, threshold: float, ts: str = "Timestamp", key: str = "Symbol") -> DataFrame:
    """T10 rows of two feeds at equal times with their difference and an alert flag."""
    x = zoned(a, ts).withWatermark(ts, lateness).select(key, ts, c("mid").alias("mid_a"))
    y = zoned(b, ts).withWatermark(ts, lateness).select(c(key).alias("__k"), c(ts).alias("__ts"), c("mid").alias("mid_b"))
    d = x.join(y, (c(key) == c("__k")) & (c(ts) == c("__ts")))
    gap = F.abs(c("mid_a") - c("mid_b"))
    return d.select(key, ts, gap.alias("gap"), (gap > threshold).alias("alert"))


def live_feed(first: DataFrame, second: DataFrame, lateness: str, ts: str = "Timestamp", key: str = "Symbol") -> DataFrame:
    """T10 one feed out of two: all rows of ``first``, and those of ``second`` at times that ``first`` lacks.

    Rows of ``first`` pass at once.  A row of ``second`` waits until the watermark says that
    ``first`` has nothing more for its time (an outer join of two streams); rows later than
    ``lateness`` are dropped.  Times that ``first`` repeats are held once, so a much-repeated
    time makes no product.  A NULL key or time meets nothing: such rows of ``second`` pass.
    """
    cols = first.columns
    x, y = zoned(first, ts), zoned(second.select(*cols), ts)
    known = c(key).isNotNull() & c(ts).isNotNull()
    seen = x.where(known).withWatermark(ts, lateness).select(c(key).alias("__k"), c(ts).alias("__ts")).dropDuplicatesWithinWatermark(["__k", "__ts"])
    waits = y.where(known).withWatermark(ts, lateness)
    rest = waits.join(seen, (c(key) == c("__k")) & (c(ts) == c("__ts")), "left_outer").where("__k is null").select(*cols)
    return x.select(*cols).unionByName(rest).unionByName(y.where(~known))


def feed_windows(a: DataFrame, b: DataFrame, lateness: str, length: str, ts: str = "Timestamp", key: str = "Symbol") -> DataFrame:
    """T10 per event-time window with rows of both feeds at equal times: mean and largest difference, and where it was largest (first such time)."""
    d = feed_gaps(a, b, lateness, 0.0, ts, key)
    agg = d.groupBy(key, F.window(ts, length).alias("w")).agg(F.avg("gap").alias("divergence"), F.max("gap").alias("largest"), F.max(F.struct("gap", (-c(ts).cast("double")).alias("m"), ts)).alias("__at"))
    return agg.select(key, c("w.start").alias("start"), "divergence", "largest", c(f"__at.{ts}").alias("at"))


def divergence_alarms(windows: DataFrame, threshold: float, out: str, state: str, checkpoint: str, key: str = "Symbol", order: str = "start") -> None:
    """T10 alarms from ``feed_windows``: ``resolved`` false for each window above ``threshold``, true for the first one below after such.

    The watermark emits windows in time order over batches, so one flag per key is
    carried from batch to batch, as a table per batch id: a replayed batch gives the
    same rows.  The windows of a key, not its ticks, meet in one task.
    """
    w = Window.partitionBy(key).orderBy(order)  # the carried flag has no time and comes first

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, f"{state}/{batch_id - 1}"
        now = batch.where("largest is not null").select(key, order, "at", "largest", (c("largest") > threshold).alias("high")).persist()
        d = now
        if batch_id and path_exists(spark, before):
            d = now.unionByName(spark.read.parquet(before), allowMissingColumns=True)
        last = d.groupBy(key).agg(F.max(F.struct(order, "high")).alias("l"))
        last.select(key, c("l.high").alias("high")).write.mode("overwrite").parquet(f"{state}/{batch_id}")
        was = F.coalesce(F.lag("high").over(w), F.lit(False))
        hit = d.withColumn("was", was).where(c(order).isNotNull() & (c("high") | c("was")))
        hit = hit.select(key, "at", F.when(c("high"), c("largest")).otherwise(0.0).alias("divergence"), (~c("high")).alias("resolved"))
        hit.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        remove(spark, f"{state}/{batch_id - 2}")
        now.unpersist()

    run_batches(windows, step, checkpoint)
