"""Entry signals, position machines and trades."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.asof import asof_join
from ..plans.ordered import TICKS, Order, attach, micros, rolling, running
from ..plans.steps import settled_scan
from .base import nz, safe_div

c = F.col

# fixed values: cross columns that must agree with the signal where they are known
AGREEING = ("vwap_cross", "supertrend_break", "kama_cross", "kma_cross", "macd_cross", "squeeze_break", "div_rsi", "div_macd")


def entry_signal(
    df: DataFrame,
    price: str = "Close",
    ram_long: float = 0.0,
    ram_short: float = 0.0,
    hurst_trend_min: float = 0.5,
    hurst_revert_max: float = 0.5,
    order: Order = TICKS,
) -> DataFrame:
    """W49 moving-average cross with RSI and band, then every confirmation the table has.

    Reads ``short_ma, long_ma, rsi, atr_val, boll_upper, boll_lower``; optional
    columns only veto a signal where they are not NULL.
    """
    have = set(df.columns)
    trend = [x for x in ("obv", "cvd") if x in have]
    if trend:
        df = running(df, {f"__p_{x}": ("last", c(x)) for x in trend}, order, exclusive=True)

    def fn(d, w):
        ps, pl = F.lag("short_ma").over(w), F.lag("long_ma").over(w)
        # a missing previous average counts as 0
        ps = F.when(pl.isNotNull(), F.coalesce(ps, F.lit(0.0))).otherwise(0.0)
        d = d.withColumns({"__ps": ps, "__pl": F.coalesce(pl, F.lit(0.0))})
        return d

    d = rolling(df, fn, 1, 0, order)
    rsi_ = F.coalesce(c("rsi"), F.lit(50.0))
    up = (c("short_ma") > c("long_ma")) & (c("__ps") <= c("__pl")) & (rsi_ < 70) & (c(price) < c("boll_upper"))
    down = (c("short_ma") < c("long_ma")) & (c("__ps") >= c("__pl")) & (rsi_ > 30) & (c(price) > c("boll_lower"))
    valid = c("short_ma").isNotNull() & c("long_ma").isNotNull() & c("atr_val").isNotNull()
    raw = F.when(valid & up, 1).when(valid & down, -1).otherwise(0)
    d = d.withColumn("__raw", raw)
    s = c("__raw")

    def against(value: str, long_bad: Column, short_bad: Column) -> Column:
        """Veto where the optional column is known and speaks against the side."""
        return c(value).isNotNull() & (((s == 1) & long_bad) | ((s == -1) & short_bad))

    vetoes: list[Column] = []
    if "htf_ma" in have:
        vetoes.append(against("htf_ma", c(price) <= c("htf_ma"), c(price) >= c("htf_ma")))
    if "htf_rsi" in have:
        vetoes.append(against("htf_rsi", c("htf_rsi") <= 50, c("htf_rsi") >= 50))
    unknown = lambda x: c(f"__p_{x}").isNull()
    if {"obv", "mfi"} <= have:
        rising, falling = unknown("obv") | (c("obv") > c("__p_obv")), unknown("obv") | (c("obv") < c("__p_obv"))
        both = c("mfi").isNotNull()
        vetoes.append(both & against("obv", ~((c("mfi") > 50) & rising), ~((c("mfi") < 50) & falling)))
    if "cvd" in have:
        rising, falling = unknown("cvd") | (c("cvd") > c("__p_cvd")), unknown("cvd") | (c("cvd") < c("__p_cvd"))
        vetoes.append(against("cvd", ~((c("cvd") > 0) & rising), ~((c("cvd") < 0) & falling)))
    if "microprice_delta" in have:
        vetoes.append(against("microprice_delta", c("microprice_delta") <= 0, c("microprice_delta") >= 0))
    if "ram" in have:
        vetoes.append(against("ram", F.lit(ram_long != 0) & (c("ram") < ram_long), F.lit(ram_short != 0) & (c("ram") > ram_short)))
    if "hurst" in have:
        vetoes.append(against("hurst", c("hurst") < hurst_trend_min, c("hurst") > hurst_revert_max))
    for x in ("liq_exhaustion", *AGREEING):
        if x in have:
            vetoes.append(c(x).isNotNull() & (c(x) != s))
    bad = F.lit(False)
    for v in vetoes:
        bad = bad | F.coalesce(v, F.lit(False))
    d = d.withColumn("signal", F.when(bad, 0).otherwise(s))
    conf = F.coalesce(safe_div(c("short_ma") - c("long_ma"), c("atr_val")), F.lit(0.0))
    d = d.withColumn("confidence", F.when(c("signal") != 0, conf).otherwise(0.0))
    return d.select(*[x for x in df.columns if not x.startswith("__p_")], "signal", "confidence")


def allowed(regime: str, regimes: Sequence[int] | None) -> Column:
    """F19 regime in the allow-list; an unknown regime or no list allows."""
    if regimes is None:
        return F.lit(True)
    return c(regime).isNull() | c(regime).isin(list(regimes))


def _position_machine(k_long: float, k_short: float, trail: float, take_trail: float, max_loss: float):
    """Machine over (price, atr, signal, long allowed, short allowed).

    Prices are multiplied by the side (+1 or -1), so one set of rules serves
    both: the best price is a maximum, stops lie below it.  State: side, entry,
    entry range, best price, armed flag.
    """

    def below(x: float, share: float, side: float) -> float:
        return x * (1 - side * share)

    def stop_level(side, entry, reach, best):
        levels = [side * entry - reach, below(best, trail, side)]
        if max_loss > 0:
            levels.append(below(side * entry, max_loss, side))
        return max(levels)

    def run(state, rows):
        side, entry, rng, best, armed = state
        out = []
        for price, atr, signal, long_ok, short_ok in rows:
            if side == 0:
                want = 0 if signal is None or signal != signal else int(signal)
                ok = (want == 1 and long_ok) or (want == -1 and short_ok)
                if not ok or atr is None or not math.isfinite(atr):
                    out.append((0.0, None, None))
                    continue
                side, entry, rng, best, armed = float(want), price, atr, want * price, 0.0
                stop = stop_level(side, entry, rng * (k_long if want > 0 else k_short), best)
                out.append((float(want),) + ((stop, None) if want > 0 else (None, -stop)))
                continue
            now = side * price
            best = max(best, now)
            reach = rng * (k_long if side > 0 else k_short)
            stop = stop_level(side, entry, reach, best)
            if not armed and now >= side * entry + reach:
                armed, best = 1.0, now
            leave = now <= stop or (armed and now <= below(best, take_trail, side))
            if leave:
                out.append((-side, None, None))
                side, entry, rng, best, armed = 0.0, 0.0, 0.0, 0.0, 0.0
            else:
                out.append((0.0,) + ((stop, None) if side > 0 else (None, -stop)))
        return out, [side, entry, rng, best, armed]

    return [0.0] * 5, run, lambda entry_state, exit_state: exit_state


def run_positions(
    df: DataFrame,
    price: str = "Close",
    atr: str = "atr_val",
    k_long: float = 3.0,
    k_short: float = 3.0,
    trail: float = 0.01,
    take_trail: float = 0.02,
    max_loss: float = 0.0,
    long_regimes: Sequence[int] | None = None,
    short_regimes: Sequence[int] | None = None,
    regime: str = "market_regime",
    order: Order = TICKS,
) -> DataFrame:
    """W50 entries and exits (``action``) with the stops of the open position.

    A closed position forgets the past, so blocks settle in a few rounds.
    """
    d = df.withColumns({"__lo": allowed(regime, long_regimes), "__so": allowed(regime, short_regimes)})
    outs = T.StructType([T.StructField(n, T.DoubleType()) for n in ("action", "long_stop", "short_stop")])
    start, run, merge = _position_machine(k_long, k_short, trail, take_trail, max_loss)
    d = d.withColumns({"__px": c(price).cast("double"), "__atr": c(atr).cast("double"), "__sig": c("signal").cast("double")})
    d = settled_scan(d, ["__px", "__atr", "__sig", "__lo", "__so"], outs, start, run, merge, order)
    return d.drop("__lo", "__so", "__px", "__atr", "__sig")


def delayed_quotes(df: DataFrame, latency_ms: int, cols: Sequence[str] = ("mid", "Bid", "Ask"), order: Order = TICKS) -> DataFrame:
    """W51 quote of the first tick not before the row's time plus the latency (the last tick if none)."""
    one = order.with_keys("__key")  # a struct, so that a null key is a key like any other
    d = df.withColumns({"__key": F.struct(*order.keys), "__orig": c(order.ts)})
    quotes = d.select("__key", c(order.ts).alias("__qts"), *order.tie, *[c(x).alias(f"fill_{x}") for x in cols])
    d = d.withColumn(order.ts, F.timestamp_micros(micros(order.ts) + latency_ms * 1000).cast("timestamp_ntz"))
    fill = [f"fill_{x}" for x in cols]
    d = asof_join(d, quotes, fill, "__qts", order.tie, one, forward=True)
    d = d.withColumn(order.ts, c("__orig")).drop("__orig")
    ends = quotes.groupBy("__key").agg(F.max_by(F.struct(*fill), F.struct("__qts", *order.tie)).alias("__end"))
    d = attach(d, ends, ["__key"], [order.ts, *order.tie])
    return d.withColumns({x: F.coalesce(c(x), c(f"__end.{x}")) for x in fill}).drop("__end", "__key")


def extract_trades(
    df: DataFrame, prob: str, threshold: Column, distance: float, latency_ms: int = 0, half_spread: bool = True, order: Order = TICKS
) -> DataFrame:
    """W51 long trades: enter above the probability threshold, leave at a trailing stop.

    Fills are at the ask and bid of the latency-shifted quote (its mid without
    ``half_spread``).  Gives one row per closed trade with its return.
    """
    d = delayed_quotes(df, latency_ms, order=order)
    buy, sell = ("fill_Ask", "fill_Bid") if half_spread else ("fill_mid", "fill_mid")
    d = d.withColumns({"__go": (c(prob) > threshold), "__buy": c(buy), "__sell": c(sell)})

    def run(state, rows):
        held, entry, stop = state
        out = []
        for mid, go, buy_px, sell_px in rows:
            gain = None
            if not held:
                if go:
                    held, entry, stop = 1.0, buy_px, buy_px - distance
            else:
                stop = max(stop, mid - distance)
                if mid <= stop:
                    gain = (sell_px - entry) / entry if entry else None
                    held, entry, stop = 0.0, 0.0, 0.0
            out.append((gain,))
        return out, [held, entry, stop]

    outs = T.StructType([T.StructField("trade_return", T.DoubleType())])
    d = settled_scan(d, ["mid", "__go", "__buy", "__sell"], outs, [0.0] * 3, run, lambda a, b: b, order)
    return d.where(c("trade_return").isNotNull()).select(*order.keys, order.ts, *order.tie, "trade_return")


def adjust_order_size(
    df: DataFrame, size: str = "size", direction: str = "direction", impact_limit=0.5, boost=1.2, uncertainty_limit=0.5, downscale=0.5
) -> DataFrame:
    """F18 order size after interval width, quiet windows and news impact.

    Reads ``quiet`` (J05), ``impact`` and ``uncertainty`` (J02) and, if there,
    ``ci_lower`` / ``ci_upper``.
    """
    s = c(size)
    if {"ci_lower", "ci_upper"} <= set(df.columns):
        s = s * F.greatest(1 - F.abs(c("ci_upper") - c("ci_lower")), F.lit(0.0))
    s = F.when(F.coalesce(c("uncertainty") > uncertainty_limit, F.lit(False)), s * downscale).otherwise(s)
    strong = F.coalesce(F.abs("impact") > impact_limit, F.lit(False))
    against = c("impact") * c(direction) < 0
    s = F.when(strong & against, 0.0).when(strong, s * boost).otherwise(s)
    reason = F.when(c("quiet"), "quiet_window").when(strong & against, "news_impact")
    return df.withColumn("adjusted", F.when(c("quiet"), 0.0).otherwise(s)).withColumn("skip_reason", reason)


def vwap_slices(orders: DataFrame, volumes: DataFrame, key: str, order_id: str = "order_id", qty: str = "qty") -> DataFrame:
    """W57 order quantity spread over the volume buckets of its key in proportion to volume."""
    v = volumes.where(c("volume") > 0)
    total = v.groupBy(key).agg(F.sum("volume").alias("__total"))
    d = orders.join(total, key, "left")
    sliced = d.join(v, key, "left")
    share = F.coalesce(c(qty) * c("volume") / nz(c("__total")), c(qty))
    return sliced.select(order_id, key, "bucket", share.alias("slice_qty"))


def twap_slices(orders: DataFrame, intervals: int, order_id: str = "order_id", qty: str = "qty") -> DataFrame:
    """W57 equal slices."""
    n = max(int(intervals), 1)
    return orders.select(order_id, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"), (c(qty) / n).alias("slice_qty"))


def fixed_slices(orders: DataFrame, slice_size: float, order_id: str = "order_id", qty: str = "qty") -> DataFrame:
    """W57 slices of a fixed size, the rest last."""
    if slice_size <= 0:
        return orders.select(order_id, F.lit(0).cast("long").alias("slice"), c(qty).alias("slice_qty"))
    n = F.greatest(F.ceil(c(qty) / slice_size), F.lit(1).cast("long"))
    d = orders.where(c(qty) > 0).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return d.select(order_id, "slice", F.least(F.lit(float(slice_size)), c(qty) - c("slice") * slice_size).alias("slice_qty"))
