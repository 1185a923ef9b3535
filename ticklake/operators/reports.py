"""Roll-ups and trade reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import IDX, TICKS, Order, attach, full, join_same, micros, rolling, row_index, running, with_row
from .base import nz, safe_div
from .indicators import rsi, sma

c = F.col


def time_bucket(ts: str, seconds: int) -> Column:
    us = seconds * 1_000_000
    return F.timestamp_micros((F.floor(micros(ts) / us) * us).cast("long")).cast("timestamp_ntz")


def aggregate_timeframes(df: DataFrame, cols: Sequence[str], frames: Mapping[str, int], order: Order = TICKS, closed_only: bool = False) -> DataFrame:
    """A01 mean and deviation of each column per time bucket, on every row of the bucket.

    A row sees its whole bucket, later rows included; ``closed_only`` gives it
    the bucket before instead.
    """
    keys = list(order.keys)
    for label, seconds in frames.items():
        here = time_bucket(order.ts, seconds)
        aggs = [f(x).alias(f"{x}_{label}_{n}") for x in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
        bars = df.groupBy(*keys, here.alias("__b")).agg(*aggs)
        if closed_only:
            bars = bars.withColumn("__b", (c("__b") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)).cast("decimal(18,6)"))))
        df = df.withColumn("__b", here).join(bars, [*keys, "__b"], "left").drop("__b")
    return df


def timeframe_indicators(df: DataFrame, frames: Mapping[str, int], ma: int = 20, rsi_n: int = 14, col: str = "mid", order: Order = TICKS) -> DataFrame:
    """A02 last price per bucket, its moving average and RSI over buckets, back on the rows.

    Buckets without rows are kept as NULL between the first and the last one.
    """
    keys = list(order.keys)
    for label, seconds in frames.items():
        us = seconds * 1_000_000
        slot = F.floor(micros(order.ts) / us).cast("long")
        bars = df.groupBy(*keys, slot.alias("__b")).agg(F.max_by(col, F.struct(*order.by())).alias("__px"))
        ends = bars.groupBy(*keys).agg(F.min("__b").alias("__lo"), F.max("__b").alias("__hi"))
        # expand the calendar in two hops so one key never explodes in one row
        per = 4_096
        hops = ends.select(*keys, "__lo", "__hi", F.explode(F.sequence(F.floor(c("__lo") / per), F.floor(c("__hi") / per))).alias("__h"))
        cal = hops.repartition(*keys, "__h").select(
            *keys, F.explode(F.sequence(F.greatest(c("__lo"), c("__h") * per), F.least(c("__hi"), c("__h") * per + per - 1))).alias("__b")
        )
        bars = cal.join(bars, [*keys, "__b"], "left").withColumn("__ts", F.timestamp_micros(c("__b") * us).cast("timestamp_ntz"))
        o = Order(tuple(keys), "__ts", (), max(order.bucket_seconds, seconds * 1024), order.block_rows)

        def fn(d, w):
            d = sma("__px", ma, f"ma_{label}").fn(d, w)
            return rsi("__px", rsi_n, f"rsi_{label}").fn(d, w)

        bars = rolling(bars, fn, max(ma, rsi_n + 1), 0, o).select(*keys, "__b", f"ma_{label}", f"rsi_{label}")
        df = df.withColumn("__b", slot).join(bars, [*keys, "__b"], "left").drop("__b")
    return df


def prediction_market_rollup(df: DataFrame, mapping: DataFrame, symbols: DataFrame) -> DataFrame:
    """A03 (Date, ticker) sums to date totals and per-symbol totals.

    ``mapping`` is (Symbol, report_ticker), ``symbols`` the short list of
    symbols every date total is repeated for.
    """
    sums = ("open_interest", "daily_volume", "block_volume")
    g = df.groupBy("Date", "report_ticker").agg(*[F.sum(x).alias(x) for x in sums], F.max("high").alias("high"), F.min("low").alias("low"))

    def block(d, prefix):
        zero = F.lit(0.0)
        return [
            *[F.coalesce(F.sum(x), zero).alias(f"{prefix}_{x}") for x in sums],
            F.coalesce(F.max("high"), zero).alias(f"{prefix}_high"),
            F.coalesce(F.min("low"), zero).alias(f"{prefix}_low"),
        ]

    totals = g.groupBy("Date").agg(*block(g, "total"), F.count(F.lit(1)).alias("market_count"))
    own = g.join(mapping, "report_ticker").groupBy("Date", "Symbol").agg(*block(g, "symbol"))
    names = symbols.select("Symbol").distinct().agg(F.array_sort(F.collect_set("Symbol")).alias("__s"))  # a named list
    each = with_row(totals, names).withColumn("Symbol", F.explode("__s")).drop("__s")
    out = each.join(own, ["Date", "Symbol"], "left")
    return out.fillna(0.0, [x for x in out.columns if x.startswith("symbol_")])


def confidence(weight: Column, n: Column) -> Column:
    """X21 confidence from total weight and event count, within [0, 1]."""
    value = (F.log1p(F.greatest(weight, F.lit(0.0))) + 0.25 * n) / 10.0
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def oracle_summary(df: DataFrame, keys: Sequence[str] = ("symbol", "oracle")) -> DataFrame:
    """A04 mean, weighted mean, median and deviation of probabilities per (symbol, oracle)."""
    from ..plans.values import exact_quantiles

    keys = list(keys)
    w = F.when(c("weight") > 0, c("weight")).otherwise(1.0)
    out = df.groupBy(*keys).agg(
        F.avg("probability").alias("prob_mean"),
        (F.sum(c("probability") * w) / F.sum(w)).alias("prob_weighted"),
        F.stddev_pop("probability").alias("prob_std"),
        F.count(F.lit(1)).alias("event_count"),
        confidence(F.sum(w), F.count(F.lit(1))).alias("confidence"),
        F.max("closing_time").alias("latest_close"),
        F.max("collected_at").alias("latest_update"),
    )
    med = exact_quantiles(df, keys, "probability", [0.5]).select(*keys, c("value").alias("prob_median"))
    return out.join(med, keys)


def oracle_features(summary: DataFrame, oracles: Sequence[str]) -> DataFrame:
    """A05 one row per symbol: columns per oracle and overall means."""
    cols = ("prob_mean", "prob_weighted", "prob_median", "prob_std", "event_count", "confidence")
    per = [F.max(F.when(c("oracle") == o, c(x))).alias(f"{o}_{x}") for o in oracles for x in cols]
    return summary.groupBy("symbol").agg(
        *per,
        F.avg("prob_weighted").alias("oracle_prob_mean"),
        F.avg("prob_weighted").alias("oracle_prob_weighted"),
        F.avg("prob_median").alias("oracle_prob_median"),
        F.avg("prob_std").alias("oracle_prob_std"),
        F.sum("event_count").cast("double").alias("oracle_event_count"),
        F.avg("confidence").alias("oracle_confidence"),
    )


def seconds_between(a: str, b: str) -> Column:
    return (micros(b) - micros(a)) / 1e6


def trade_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A06 average hold time and turnover."""
    return df.groupBy(*keys).agg(
        F.avg(seconds_between("entry_time", "exit_time")).alias("avg_hold_seconds"),
        F.sum(F.abs(c("entry_price") * c("volume")) + F.abs(c("exit_price") * c("volume"))).alias("turnover"),
    )


def pnl_by_duration(df: DataFrame, seconds: int = 60) -> DataFrame:
    """A06 result by whole minutes held."""
    d = F.floor(seconds_between("entry_time", "exit_time") / seconds).cast("long")
    return df.groupBy(d.alias("duration")).agg(F.sum("pnl").alias("pnl"))


def trade_pnl(side: Column, entry: Column, exit_: Column, volume: Column) -> Column:
    """A07 result of a trade with the sign of its side."""
    return (exit_ - entry) * volume * F.when(F.lower(side) == "sell", -1.0).otherwise(1.0)


def broker_costs(df: DataFrame, keys: Sequence[str] = ("broker",)) -> DataFrame:
    """A08 fill latency and slippage per broker, with the 95th percentile of the latency."""
    from ..plans.values import exact_quantiles

    d = df.withColumn("latency_ms", (micros("fill_ts") - micros("order_ts")) / 1000.0)
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fills"), F.avg("latency_ms").alias("latency_ms"), F.avg("slippage_bps").alias("slippage_bps")
    )
    return out.join(exact_quantiles(d, keys, "latency_ms", [0.95]).select(*keys, c("value").alias("latency_p95")), list(keys))


def fill_quality(df: DataFrame, keys: Sequence[str], min_ratio=0.5, max_slippage=0.01, max_cancel=0.5) -> DataFrame:
    """A09 fill ratio, cancel rate and slippage against their budgets."""
    d = df.groupBy(*keys).agg(
        F.coalesce(safe_div(F.sum("filled"), F.sum("placed")), F.lit(0.0)).alias("fill_ratio"),
        F.coalesce(safe_div(F.sum("cancelled"), F.sum("placed")), F.lit(0.0)).alias("cancel_rate"),
        F.avg("slippage").alias("slippage"),
    )
    return d.withColumns(
        {
            "low_fill": c("fill_ratio") < min_ratio,
            "high_cancel": c("cancel_rate") > max_cancel,
            "high_slippage": c("slippage") > max_slippage,
        }
    )


def week_start(day: Column) -> Column:
    """Start of the week that ends on Monday (weeks run Tuesday to Monday)."""
    return F.date_add(F.date_trunc("week", F.date_sub(day, 1)).cast("date"), 1)


def regime_pnl(df: DataFrame, time: str = "exit_time", keys: Sequence[str] = ("model", "regime")) -> DataFrame:
    """A10/J22 daily result and the total of its week by model and regime."""
    keys = list(keys)
    daily = df.groupBy(F.to_date(time).alias("date"), *keys).agg(F.sum("pnl").alias("pnl_daily"))
    w = Window.partitionBy(*keys, week_start(c("date")))  # seven rows at most
    return daily.withColumn("pnl_weekly", F.sum("pnl_daily").over(w))


def monthly_report(df: DataFrame, date: str = "date") -> DataFrame:
    """A11 monthly sum of returns, mean Sharpe and worst drawdown."""
    return df.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(
        F.sum("return").alias("return"), F.avg("sharpe").alias("sharpe"), F.min("drawdown").alias("drawdown")
    )


def open_positions(fills: DataFrame, order: Order) -> DataFrame:
    """A12 open volume and average price per symbol; a flat position starts anew.

    Only the fills after the last flat place are summed.
    """
    v = F.when(F.lower("side") == "sell", -c("volume")).otherwise(c("volume"))
    d = running(fills.withColumn("__v", v), {"__cv": ("sum", c("__v"))}, order)
    place = F.struct(*order.by())
    flat = d.groupBy(*order.keys).agg(F.max(F.when(F.abs(c("__cv")) < 1e-9, place)).alias("__flat"))
    open_ = join_same(d, flat, list(order.keys)).where(c("__flat").isNull() | (place > c("__flat")))
    out = open_.groupBy(*order.keys).agg(F.sum("__v").alias("volume"), F.sum(c("__v") * c("price")).alias("__cost"))
    return out.select(*order.keys, "volume", safe_div(c("__cost"), c("volume")).alias("avg_price"))


def win_rates(df: DataFrame, key: str, out: str, overall: bool = True) -> DataFrame:
    """A13 share of winning rows per key, with an ``__overall__`` row."""
    win = (c("pnl") > 0).cast("double")
    d = df.groupBy(c(key).alias("name")).agg(F.avg(win).alias(out))
    if overall:
        d = d.unionByName(df.agg(F.avg(win).alias(out)).withColumn("name", F.lit("__overall__")))
    return d


def mean_importance(df: DataFrame, col: str = "feature_importance") -> DataFrame:
    """A13 mean of each entry of a map column over the rows that have it."""
    return df.select(F.explode(col).alias("feature", "v")).groupBy("feature").agg(F.avg("v").alias("importance"))


def walk_forward_windows(df: DataFrame, train: int, val: int, step: int, order: Order, part: str = "val") -> DataFrame:
    """W36 rows with the ids of the windows they belong to as training or validation rows."""
    keys = list(order.keys)
    d = row_index(df, order)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    i = c(IDX)
    last = F.floor((c("__n") - train - val) / step)  # highest window id
    off, size = (0, train) if part == "train" else (train, val)
    lo = F.greatest(F.ceil((i - off - size + 1) / step), F.lit(0).cast("long"))
    hi = F.least(F.floor((i - off) / step), last)
    d = attach(d, n, keys, [IDX]).where(lo <= hi)
    return d.withColumn("window", F.explode(F.sequence(lo, hi))).drop("__n", IDX)


def walk_forward_metrics(df: DataFrame, ret: str, train: int, val: int, step: int, order: Order) -> DataFrame:
    """A15 mean Sharpe and worst drawdown of the validation windows per key."""
    from .risk import performance

    keys = list(order.keys)
    p = performance(walk_forward_windows(df, train, val, step, order), ret, order.with_keys(*keys, "window"))
    return p.groupBy(*keys).agg(
        F.avg("sharpe_raw").alias("avg_sharpe"), F.min("dd_pct").alias("worst_drawdown"), F.count(F.lit(1)).alias("windows")
    )


def walk_forward_rmse(df: DataFrame, y: str, train: int, val: int, step: int, order: Order) -> DataFrame:
    """A15 error of predicting a window's validation values by its training mean."""
    keys = list(order.keys)
    tr = walk_forward_windows(df, train, val, step, order, "train").groupBy(*keys, "window").agg(F.avg(y).alias("__mu"))
    va = walk_forward_windows(df, train, val, step, order)
    d = join_same(va, tr, [*keys, "window"]).groupBy(*keys, "window").agg(F.sqrt(F.avg(F.pow(c(y) - c("__mu"), 2))).alias("rmse"))
    return d


def feed_divergence(a: DataFrame, b: DataFrame, threshold: float, keys: Sequence[str] = ("Symbol",)) -> DataFrame:
    """A41/J09 mean and largest mid difference of two feeds at equal times, and when it was largest."""
    keys = list(keys)
    x = a.select(*keys, "Timestamp", c("mid").alias("__p")).join(b.select(*keys, "Timestamp", c("mid").alias("__s")), [*keys, "Timestamp"])
    gap = F.abs(c("__p") - c("__s"))
    d = x.groupBy(*keys).agg(
        F.avg(gap).alias("mean_diff"),
        F.max(gap).alias("max_diff"),
        F.max_by("Timestamp", F.struct(gap, -micros("Timestamp"))).alias("max_at"),
        F.count(F.lit(1)).alias("overlap"),
    )
    return d.withColumn("alert", c("max_diff") > threshold)


def divergence_events(df: DataFrame, gap: Column, threshold: float, order: Order = TICKS) -> DataFrame:
    """A41 rows where the divergence alert starts (``raised``) or ends (``resolved``)."""

    def fn(d, w):
        d = d.withColumn("__on", gap > threshold)
        was = F.coalesce(F.lag("__on").over(w), F.lit(False))
        event = F.when(c("__on") & ~was, "raised").when(~c("__on") & was, "resolved")
        return d.withColumn("event", event).drop("__on")

    return rolling(df, fn, 1, 0, order).where(c("event").isNotNull())


def event_impact(df: DataFrame, key: str, sentiment: str, severity: str) -> DataFrame:
    """A43 severity-weighted mean sentiment per event."""
    return df.groupBy(key).agg(
        F.coalesce(safe_div(F.sum(c(sentiment) * c(severity)), F.sum(severity)), F.lit(0.0)).alias("impact")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """W42 newest row per key: a max with map-side combine, no sort."""
    rest = [x for x in df.columns if x not in keys]
    d = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__r"))
    return d.select(*keys, *[c(f"__r.{x}").alias(x) for x in rest]).select(df.columns)


def rolling_health(df: DataFrame, pnl: str, n: int, order: Order, min_sharpe=0.0, min_win=0.5) -> DataFrame:
    """W52 Sharpe and win rate of the last (up to) ``n`` results, and whether both are good enough."""

    def fn(d, w):
        f = w.rowsBetween(-(n - 1), 0)
        d = d.withColumns({"__m": F.avg(pnl).over(f), "__s": F.stddev_samp(pnl).over(f), "__n": F.count(pnl).over(f)})
        sharpe = F.when(c("__n") > 1, c("__m") / (c("__s") + 1e-8) * F.sqrt("__n")).otherwise(0.0)
        d = d.withColumns({"sharpe": sharpe, "win_rate": F.avg((c(pnl) > 0).cast("double")).over(f)})
        return d.withColumn("healthy", (c("sharpe") >= min_sharpe) & (c("win_rate") >= min_win)).drop("__m", "__s", "__n")

    return rolling(df, fn, n - 1, 0, order)


def prediction_drift(df: DataFrame, pred: str, n: int, threshold: float, order: Order) -> DataFrame:
    """W53 distance of a prediction from the mean of the up to ``n`` before it."""

    def fn(d, w):
        base = F.avg(pred).over(w.rowsBetween(-n, -1))
        d = d.withColumn("drift", F.abs(c(pred) - base))
        return d.withColumn("drifted", F.coalesce(c("drift") > threshold, F.lit(False)))

    return rolling(df, fn, n, 0, order)


def mean_latency(df: DataFrame, col: str, n: int, order: Order) -> DataFrame:
    """W54 moving average of a latency over the last (up to) ``n`` rows."""
    return rolling(df, lambda d, w: d.withColumn("latency_avg", F.avg(col).over(w.rowsBetween(-(n - 1), 0))), n - 1, 0, order)
