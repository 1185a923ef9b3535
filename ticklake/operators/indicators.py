"""Technical indicators."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..plans.ordered import IDX, TICKS, Order, attach, full, linear_scan, own_index, rolling, running
from .base import RowOp, crossing, flag, nz, price_col, safe_div, sign_int

c = F.col


def prev(x: str | Column, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(x, n).over(w)


# ---------------------------------------------------------------- moving averages


def sma(col: str, n: int, out: str | None = None) -> RowOp:
    """W01 simple moving average."""
    out = out or f"ma_{n}"
    return RowOp("sma", (col,), n - 1, lambda d, w: d.withColumn(out, full(F.avg, col, n, w)))


def bollinger(col: str = "mid", n: int = 20, k: float = 2.0) -> RowOp:
    """W02 bands, break flag and relative width."""

    def fn(d, w):
        d = d.withColumn("boll_ma", full(F.avg, col, n, w)).withColumn("__sd", full(F.stddev_samp, col, n, w))
        up, low = c("boll_ma") + k * c("__sd"), c("boll_ma") - k * c("__sd")
        return d.withColumns(
            {
                "boll_upper": up,
                "boll_lower": low,
                "boll_break": flag(c(col) > up) - flag(c(col) < low),
                "boll_width": safe_div(up - low, c("boll_ma")),
            }
        ).drop("__sd")

    return RowOp("bollinger", (col,), n - 1, fn)


def true_range(high: Column, low: Column, prev_close: Column) -> Column:
    # greatest() skips NULL, so the first row falls back to high - low
    return F.greatest(high - low, F.abs(high - prev_close), F.abs(low - prev_close))


def atr(n: int = 14, high: str = "High", low: str = "Low", close: str = "mid", stop: float = 3.0) -> RowOp:
    """W03 average true range with stops at ``stop`` ranges."""

    def fn(d, w):
        d = d.withColumn("__tr", true_range(c(high), c(low), prev(close, w)))
        d = d.withColumn(f"atr_{n}", full(F.avg, "__tr", n, w)).drop("__tr")
        return d.withColumns(
            {
                "atr_stop_long": c(close) - stop * c(f"atr_{n}"),
                "atr_stop_short": c(close) + stop * c(f"atr_{n}"),
            }
        )

    return RowOp("atr", (high, low, close), n, fn)


def atr_mid(n: int = 14, col: str = "mid") -> RowOp:
    """W03, form on mid prices only; needs ``n`` changes, so starts at row n."""

    def fn(d, w):
        d = d.withColumn("__tr", F.abs(c(col) - prev(col, w)))
        return d.withColumn("atr_mid", full(F.avg, "__tr", n, w)).drop("__tr")

    return RowOp("atr_mid", (col,), n, fn)


def rsi(col: str = "mid", n: int = 14, out: str | None = None, zero_loss: str = "null") -> RowOp:
    """W04 relative strength index; ``zero_loss='100'`` gives 100 where losses are 0."""
    out = out or f"rsi_{n}"

    def fn(d, w):
        delta = c(col) - prev(col, w)
        d = d.withColumn("__d", delta)
        up = full(F.avg, F.when(c("__d") > 0, c("__d")).when(c("__d").isNotNull(), 0.0), n, w)
        down = full(F.avg, F.when(c("__d") < 0, -c("__d")).when(c("__d").isNotNull(), 0.0), n, w)
        d = d.withColumns({"__up": up, "__down": down})
        value = 100 - 100 / (1 + safe_div(c("__up"), c("__down")))
        if zero_loss == "100":
            value = F.when(c("__down") == 0, 100.0).otherwise(value)
        return d.withColumn(out, value).drop("__d", "__up", "__down")

    return RowOp("rsi", (col,), n, fn)


def ema(df: DataFrame, spans: Mapping[str, tuple[str, int]], order: Order = TICKS, start: int = 0, keep_index: bool = False) -> DataFrame:
    """W05 exponential averages: ``{out: (column, span)}``, first value seeds."""
    steps = {}
    for out, (col, span) in spans.items():
        alpha = 2.0 / (span + 1.0)
        steps[out] = ewm_step(c(col), alpha, start)
    return linear_scan(df, steps, order, keep_index)


def ewm_step(x: Column, alpha: float, start: int = 0) -> tuple[Column, Column]:
    seed = c(IDX) <= start
    hold = x.isNull()
    a = F.when(seed, 0.0).when(hold, 1.0).otherwise(1.0 - alpha)
    b = F.when(seed, F.coalesce(x, F.lit(0.0))).when(hold, 0.0).otherwise(alpha * x)
    return a, b


def macd(df: DataFrame, col: str | None = None, fast=12, slow=26, signal=9, order: Order = TICKS) -> DataFrame:
    """W06 MACD line, signal line, histogram and its sign."""
    col = col or price_col(df)
    d = ema(df, {"__fast": (col, fast), "__slow": (col, slow)}, order, keep_index=True)
    d = d.withColumn("macd", c("__fast") - c("__slow")).drop("__fast", "__slow")
    d = ema(d, {"macd_signal": ("macd", signal)}, order)
    return own_index(df, d.withColumn("macd_hist", c("macd") - c("macd_signal")).withColumn("macd_cross", sign_int(c("macd_hist"))))


def stochastic(k: int = 14, d_n: int = 3, high="High", low="Low", close="mid") -> RowOp:
    """W07 stochastic oscillator."""

    def fn(d, w):
        d = d.withColumns({"__lo": full(F.min, low, k, w), "__hi": full(F.max, high, k, w)})
        d = d.withColumn("stoch_k", 100 * safe_div(c(close) - c("__lo"), c("__hi") - c("__lo")))
        return d.withColumn("stoch_d", full(F.avg, "stoch_k", d_n, w)).drop("__lo", "__hi")

    return RowOp("stochastic", (high, low, close), k + d_n - 2, fn)


def vwap(df: DataFrame, out: str, price: str = "mid", volume: str = "Volume", anchors: Sequence[str] = (), order: Order = TICKS) -> DataFrame:
    """W08 running volume-weighted price, restarted for each value of ``anchors``."""
    keyed = order.with_keys(*order.keys, *anchors)
    d = running(df, {"__pv": ("sum", c(price) * c(volume)), "__v": ("sum", c(volume))}, keyed)
    return d.withColumn(out, safe_div(c("__pv"), c("__v"))).drop("__pv", "__v")


def anchored_vwaps(df: DataFrame, price: str = "mid", volume: str = "Volume", ts: str = "Timestamp", order: Order = TICKS) -> DataFrame:
    """W08 by day and by session of the day, with the sign of their difference."""
    from ..functions.market import session

    d = df.withColumn("__day", F.to_date(ts)).withColumn("__ses", F.coalesce(session(ts), F.lit("other")))
    d = vwap(d, "vwap_day", price, volume, ("__day",), order)
    d = vwap(d, "vwap_session", price, volume, ("__day", "__ses"), order)
    return d.withColumn("vwap_cross", sign_int(F.round(c("vwap_session") - c("vwap_day"), 9))).drop("__day", "__ses")


def donchian(col: str = "mid", n: int = 20) -> RowOp:
    """W10 channel and break against the channel of the row before."""

    def fn(d, w):
        d = d.withColumns({"donchian_high": full(F.max, col, n, w), "donchian_low": full(F.min, col, n, w)})
        brk = flag(c(col) > prev("donchian_high", w)) - flag(c(col) < prev("donchian_low", w))
        return d.withColumn("donchian_break", brk)

    return RowOp("donchian", (col,), n, fn)


def keltner(col: str = "mid", n: int = 20, mult: float = 2.0) -> RowOp:
    """W11 Keltner channel on mid-price moves."""

    def fn(d, w):
        d = d.withColumn("__m", F.abs(c(col) - prev(col, w)))
        d = d.withColumns({"__ma": full(F.avg, col, n, w), "__atr": full(F.avg, "__m", n, w)})
        d = d.withColumns({"keltner_high": c("__ma") + mult * c("__atr"), "keltner_low": c("__ma") - mult * c("__atr")})
        brk = flag(c(col) > prev("keltner_high", w)) - flag(c(col) < prev("keltner_low", w))
        return d.withColumn("keltner_break", brk).drop("__m", "__ma", "__atr")

    return RowOp("keltner", (col,), n + 1, fn)


def squeeze(df: DataFrame, n=20, bb=2.0, kc=1.5, high="High", low="Low", close="Close", order: Order = TICKS) -> DataFrame:
    """W12 Bollinger-inside-Keltner squeeze and the break out of it."""
    d = ema(df, {"__ema": (close, n)}, order, keep_index=True)

    def fn(d, w):
        d = d.withColumn("__tr", true_range(c(high), c(low), prev(close, w)))
        d = d.withColumns(
            {"__ma": full(F.avg, close, n, w), "__sd": full(F.stddev_samp, close, n, w), "__atr": full(F.avg, "__tr", n, w)}
        )
        up, dn = c("__ma") + bb * c("__sd"), c("__ma") - bb * c("__sd")
        d = d.withColumns(
            {
                "bb_width": safe_div(up - dn, c("__ma")),
                "kc_upper": c("__ema") + kc * c("__atr"),
                "kc_lower": c("__ema") - kc * c("__atr"),
                "__up": up,
                "__dn": dn,
            }
        )
        d = d.withColumn("__on", F.coalesce((c("__up") < c("kc_upper")) & (c("__dn") > c("kc_lower")), F.lit(False)))
        left = F.coalesce(prev("__on", w), F.lit(False)) & ~c("__on")
        brk = flag(left & (c(close) > c("__up"))) - flag(left & (c(close) < c("__dn")))
        return d.withColumn("squeeze_break", brk)

    out = rolling(d, fn, n + 1, 0, order)
    return own_index(df, out.drop("__tr", "__ma", "__sd", "__atr", "__ema", "__up", "__dn", "__on"))


def _price_cross(df: DataFrame, price: str, line: str, out: str, order: Order) -> DataFrame:
    def fn(d, w):
        return d.withColumn(out, crossing(c(price), c(line), prev(price, w), prev(line, w)))

    return rolling(df, fn, 1, 0, order)


def kama(df: DataFrame, close="Close", n=10, fast=2, slow=30, order: Order = TICKS) -> DataFrame:
    """W13 efficiency-adaptive moving average and price crosses."""
    hi, lo = 2.0 / (fast + 1), 2.0 / (slow + 1)

    def efficiency(d, w):
        d = d.withColumn("__m", F.abs(c(close) - prev(close, w)))
        d = d.withColumn("__vol", full(F.sum, "__m", n, w))
        er = safe_div(F.abs(c(close) - prev(close, w, n)), c("__vol"))
        return d.withColumn("__sc", F.pow(er * (hi - lo) + lo, 2)).drop("__m", "__vol")

    d = rolling(df, efficiency, n, 0, order, keep_index=True)
    seed = c(IDX) < n
    a = F.when(seed, 0.0).otherwise(1 - c("__sc"))
    b = F.when(seed, c(close)).otherwise(c("__sc") * c(close))
    d = linear_scan(d, {"kama": (a, b)}, order, keep_index=True).drop("__sc")
    return own_index(df, _price_cross(d, close, "kama", "kama_cross", order))


def kalman_variance(i: Column, q: Column, r: Column) -> Column:
    """Variance of the scalar filter after ``i`` updates from 1, in closed form.

    An update maps p to ``r (p + q) / (p + q + r)``.  With the fixed points u > v
    of that map, ``(p - u) / (p - v)`` shrinks by the same factor at every update.
    """
    root = F.sqrt(q * q + 4 * q * r)
    u, v = (root - q) / 2, (-root - q) / 2
    z = F.pow((r - u) / (r - v), i) * (1 - u) / (1 - v)
    settled = (u - v * z) / (1 - z)
    return F.when(r <= 0, F.when(i > 0, 0.0).otherwise(1.0)).when(q <= 0, r / (r + i)).otherwise(settled)


def kalman_gain(idx: Column, q: Column, r: Column) -> Column:
    """Gain at row ``idx`` of a key: 1 at the first, then from the variance before it."""
    lead = kalman_variance(F.greatest(idx - 1, F.lit(0)).cast("double"), q, r) + q
    return F.when(idx < 1, 1.0).otherwise(F.when(lead + r > 0, lead / (lead + r)).otherwise(1.0))


def kalman_ma(df: DataFrame, close="Close", q=1e-5, r=1e-2, order: Order = TICKS) -> DataFrame:
    """W14 constant-noise Kalman average: the gain depends on the row number alone."""
    k = kalman_gain(c(IDX), F.lit(float(q)), F.lit(float(r)))
    d = linear_scan(df, {"kma": (1 - k, k * c(close))}, order, keep_index=True)
    return own_index(df, _price_cross(d, close, "kma", "kma_cross", order))


def kalman_smooth(df: DataFrame, col: str = "mid", q: float = 1e-2, r: float | None = None, order: Order = TICKS) -> DataFrame:
    """W14 Kalman price and volatility; the noise defaults to the variance of the changes of the key."""
    keys = list(order.keys)
    d = rolling(df, lambda d, w: d.withColumn("__ch", c(col) - prev(col, w)), 1, 0, order, keep_index=True)
    noise = F.var_samp("__ch") if not r else F.lit(float(r))
    per_key = d.groupBy(*keys).agg(F.coalesce(nz(noise), F.lit(1.0)).alias("__r"))
    d = attach(d.drop("__ch"), per_key, keys, [IDX])
    d = d.withColumn("__g", kalman_gain(c(IDX), F.lit(float(q)), c("__r")))
    d = d.withColumn("kalman_volatility", F.sqrt(kalman_variance(c(IDX).cast("double"), F.lit(float(q)), c("__r")))).drop("__r")
    return own_index(df, linear_scan(d, {"kalman_price": (1 - c("__g"), c("__g") * c(col))}, order).drop("__g"))


def supertrend(df: DataFrame, n=10, mult=3.0, high="High", low="Low", close="Close", order: Order = TICKS) -> DataFrame:
    """W15 SuperTrend.  The side is the last band break seen, so no loop is needed."""

    def bands(d, w):
        d = d.withColumn("__tr", true_range(c(high), c(low), prev(close, w)))
        d = d.withColumn("__atr", full(F.avg, "__tr", n, w))
        mid = (c(high) + c(low)) / 2
        d = d.withColumns({"__ub": mid + mult * c("__atr"), "__lb": mid - mult * c("__atr")})
        hit = F.when(c(close) > prev("__ub", w), 1).when(c(close) < prev("__lb", w), -1)
        return d.withColumn("__hit", F.when(c(IDX) >= n, hit)).withColumn("__live", c(IDX) >= n)

    d = rolling(df, bands, n + 1, 0, order, keep_index=True)
    d = running(d, {"__dir": ("last", c("__hit"))}, order)
    line = F.when(c("__live"), F.when(c("__dir") == 1, c("__lb")).otherwise(c("__ub")))
    d = d.withColumn("supertrend", line).drop("__tr", "__atr", "__ub", "__lb", "__hit", "__live", "__dir")
    return own_index(df, _price_cross(d, close, "supertrend", "supertrend_break", order))


def obv_mfi(df: DataFrame, n=14, price="mid", high="High", low="Low", volume="Volume", order: Order = TICKS) -> DataFrame:
    """W16 on-balance volume and money-flow index."""

    def flows(d, w):
        d = d.withColumn("__typ", (c(high) + c(low) + c(price)) / 3)
        d = d.withColumn("__pt", prev("__typ", w))
        flow = c("__typ") * c(volume)
        d = d.withColumns(
            {
                "__pos": F.when(c("__typ") > c("__pt"), flow).otherwise(0.0),
                "__neg": F.when(c("__typ") < c("__pt"), flow).otherwise(0.0),
                "__dir": F.coalesce(F.signum(c(price) - prev(price, w)), F.lit(0.0)),
            }
        )
        d = d.withColumns({"__ps": full(F.sum, "__pos", n, w), "__ns": full(F.sum, "__neg", n, w)})
        return d.withColumn("mfi", 100 - 100 / (1 + safe_div(c("__ps"), c("__ns"))))

    d = rolling(df, flows, n, 0, order)
    d = running(d, {"obv": ("sum", c("__dir") * c(volume))}, order)
    return d.drop("__typ", "__pt", "__pos", "__neg", "__dir", "__ps", "__ns")


def ram(col: str = "mid", n: int = 20) -> RowOp:
    """W17 mean return over its volatility."""

    def fn(d, w):
        d = d.withColumn("__r", safe_div(c(col), prev(col, w)) - 1)
        d = d.withColumns({"__m": full(F.avg, "__r", n, w), "__s": full(F.stddev_samp, "__r", n, w)})
        return d.withColumn("ram", F.coalesce(safe_div(c("__m"), c("__s")), F.lit(0.0))).drop("__r", "__m", "__s")

    return RowOp("ram", (col,), n, fn)


def ram_decay(df: DataFrame, decay: float, col: str = "mid", order: Order = TICKS) -> DataFrame:
    """W17, exponentially weighted form (debiased weighted deviation)."""
    d = rolling(df, lambda d, w: d.withColumn("__r", safe_div(c(col), prev(col, w)) - 1), 1, 0, order, keep_index=True)
    d = d.withColumn("__pos", c(IDX)).drop(IDX)
    d = linear_scan(
        d, {"__m": ewm_step(c("__r"), decay, 1), "__q": ewm_step(c("__r") * c("__r"), decay, 1)}, order
    )
    keep = 1.0 - decay
    # squared weights after k steps: keep^2k + decay^2 (1 - keep^2k) / (1 - keep^2)
    left = F.pow(F.lit(keep * keep), c("__pos") - 1)
    w2 = left + decay * decay * (1 - left) / (1 - keep * keep)
    var = (c("__q") - c("__m") * c("__m")) / nz(1 - w2)
    vol = F.when(c("__pos") >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))
    value = F.coalesce(safe_div(c("__m"), vol), F.lit(0.0))
    return d.withColumn("ram", value).drop("__r", "__m", "__q", "__pos")


def order_flow(df: DataFrame, n=10, bid="BidVolume", ask="AskVolume", order: Order = TICKS) -> DataFrame:
    """W18 imbalance, cumulative volume delta and their rolling mean and deviation."""
    delta = c(bid) - c(ask)
    d = df.withColumn("imbalance", F.coalesce(safe_div(delta, c(bid) + c(ask)), F.lit(0.0)))
    d = running(d, {"cvd": ("sum", delta)}, order)

    def fn(d, w):
        return d.withColumns(
            {
                f"{x}_roll_{name}": full(agg, x, n, w)
                for x in ("imbalance", "cvd")
                for name, agg in (("mean", F.avg), ("std", F.stddev_samp))
            }
        )

    return rolling(d, fn, n - 1, 0, order)


def divergence(indicator: str, price: str = "mid", out: str | None = None) -> RowOp:
    """W19 price and indicator moving apart."""
    out = out or f"div_{indicator}"

    def fn(d, w):
        dp, di = c(price) - prev(price, w), c(indicator) - prev(indicator, w)
        return d.withColumn(out, flag((dp < 0) & (di > 0)) - flag((dp > 0) & (di < 0)))

    return RowOp("divergence", (price, indicator), 1, fn)


def cross_signal(short: str, long: str, out: str = "ma_cross_signal") -> RowOp:
    """W20 crosses of two columns."""

    def fn(d, w):
        return d.withColumn(out, crossing(c(short), c(long), prev(short, w), prev(long, w)))

    return RowOp("cross_signal", (short, long), 1, fn)


def lags_and_stats(
    cols: Sequence[str],
    lags: Sequence[int] = (1, 2, 3),
    windows: Sequence[int] = (5, 10),
    custom: Mapping[str, Callable[[Column, WindowSpec], Column]] | None = None,
    custom_back: int = 0,
) -> RowOp:
    """W21 lags, rolling means and deviations; ``custom`` adds own column functions."""

    def fn(d, w):
        new = {}
        for x in cols:
            new.update({f"{x}_lag{k}": prev(x, w, k) for k in lags})
            for n in windows:
                new[f"{x}_mean{n}"] = full(F.avg, x, n, w)
                new[f"{x}_std{n}"] = full(F.stddev_samp, x, n, w)
            for name, f in (custom or {}).items():
                new[f"{x}_{name}"] = f(c(x), w)
        return d.withColumns(new)

    back = max([custom_back, *lags, *[n - 1 for n in windows]])
    return RowOp("lags_and_stats", tuple(cols), back, fn)


def learned_lags(col: str, descriptors: Sequence[Mapping[str, int]]) -> RowOp:
    """W21, stored (lag, window) descriptors of one column."""

    def fn(d, w):
        new = {}
        for item in descriptors:
            lag, n = int(item.get("lag", 1)), int(item.get("window", 1))
            new[f"{col}_lag{lag}"] = prev(col, w, lag)
            new[f"{col}_mean{n}"] = full(F.avg, col, n, w)
        return d.withColumns(new)

    back = max([1, *[max(int(i.get("lag", 1)), int(i.get("window", 1)) - 1) for i in descriptors]])
    return RowOp("learned_lags", (col,), back, fn)


def volatility(col: str = "return", n: int = 30, out: str | None = None) -> RowOp:
    """W22 rolling deviation."""
    out = out or f"volatility_{n}"
    return RowOp("volatility", (col,), n - 1, lambda d, w: d.withColumn(out, full(F.stddev_samp, col, n, w)))


def fractal(col: str = "mid", n: int = 128) -> RowOp:
    """W23 Katz fractal dimension and its reciprocal over ``n`` rows."""

    def fn(d, w):
        frame, steps = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(n - 2), 0)
        d = d.withColumn("__m", F.abs(c(col) - prev(col, w)))
        d = d.withColumns(
            {
                "__n": F.count(col).over(frame),
                "__len": F.sum("__m").over(steps),
                "__far": F.greatest(
                    F.max(col).over(frame) - F.first(col).over(frame),
                    F.first(col).over(frame) - F.min(col).over(frame),
                ),
            }
        )
        ln = math.log10(n)
        fd = ln / (ln + F.log10(c("__far") / c("__len")))
        fd = F.when((c("__len") == 0) | (c("__far") == 0), 1.0).otherwise(fd)
        d = d.withColumn("fractal_dim", F.when(c("__n") == n, fd))
        return d.withColumn("hurst", safe_div(F.lit(1.0), c("fractal_dim"))).drop("__m", "__n", "__len", "__far")

    return RowOp("fractal", (col,), n, fn)


def spectral_energy(col: str = "mid", n: int = 128) -> RowOp:
    """W24 energy of the half spectrum, by Parseval: no transform is computed."""
    if n % 2:
        raise ValueError("the window must be even")

    def fn(d, w):
        frame = w.rowsBetween(-(n - 1), 0)
        alt = F.when(c(IDX) % 2 == 0, c(col)).otherwise(-c(col))
        energy = (n * F.sum(c(col) * c(col)).over(frame) + F.pow(F.sum(col).over(frame), 2) + F.pow(F.sum(alt).over(frame), 2)) / 2
        return d.withColumn("spec_energy", F.when(F.count(col).over(frame) == n, energy))

    return RowOp("spectral_energy", (col,), n - 1, fn)


def fft_magnitude(freqs: Sequence[float] = (0.01,), col: str = "mid", n: int = 128) -> RowOp:
    """W25 spectrum magnitude at the bin nearest each frequency."""

    def fn(d, w):
        frame = w.rowsBetween(-(n - 1), 0)
        new = {}
        for f in freqs:
            k = min(range(n // 2 + 1), key=lambda b: abs(b / n - f))
            angle = (c(IDX) % n) * (2 * math.pi * k / n)
            re, im = F.sum(c(col) * F.cos(angle)).over(frame), F.sum(c(col) * F.sin(angle)).over(frame)
            new[f"fft_mag_{k}_{n}"] = F.when(F.count(col).over(frame) == n, F.hypot(re, im))
        return d.withColumns(new)

    return RowOp("fft_magnitude", (col,), n - 1, fn)


# fixed values: db4 high-pass decomposition filter
DB4_HIGH = (
    -0.23037781330885523, 0.7148465705525415, -0.6308807679295904, -0.02798376941698385,
    0.18703481171888114, 0.030841381835986965, -0.032883011666982945, -0.010597401784997278,
)


def wavelet(col: str = "mid", n: int = 128) -> RowOp:
    """W26 energy and mean size of the finest db4 detail of the last ``n`` rows.

    The transform keeps every second filter output of the window, mirrored at
    its ends.  Outputs that touch no end are one value per row shared by all
    windows, so a frame sum over rows of the window's parity gives them; the
    three at each end are written out from the window's first and last rows.
    """
    taps = len(DB4_HIGH)
    if n % 2 or n < 2 * taps:
        raise ValueError("the window must be even and longer than two filters")

    def at(w: WindowSpec, p: int) -> Column:  # value at window position p
        return F.lag(col, n - 1 - p).over(w)

    def edge(w: WindowSpec, k: int) -> Column:
        total = None
        for j, h in enumerate(DB4_HIGH):
            p = 2 * k + 1 - j
            p = -1 - p if p < 0 else 2 * n - 1 - p if p >= n else p
            term = at(w, p) * h
            total = term if total is None else total + term
        return total

    half = (taps - 2) // 2
    edges = [*range(half), *range(n // 2, n // 2 + half)]

    def fn(d, w):
        d = d.withColumn("__d", sum((F.lag(col, j).over(w) * h for j, h in enumerate(DB4_HIGH[1:], 1)), c(col) * DB4_HIGH[0]))
        own = lambda par: F.when(c(IDX) % 2 == par, c("__d"))
        d = d.withColumns({"__d0": own(0), "__d1": own(1)})
        f = w.rowsBetween(-(n - taps), 0)
        new = {}
        for name, g in (("sq", lambda x: x * x), ("ab", F.abs)):
            mid = F.when(c(IDX) % 2 == 0, F.sum(g(c("__d0"))).over(f)).otherwise(F.sum(g(c("__d1"))).over(f))
            new[name] = sum((g(edge(w, k)) for k in edges), mid)
        ok = F.count(col).over(w.rowsBetween(-(n - 1), 0)) == n
        count = n // 2 + half
        return d.withColumns(
            {"wavelet_energy": F.when(ok, new["sq"]), "wavelet_abs": F.when(ok, new["ab"] / count)}
        ).drop("__d", "__d0", "__d1")

    return RowOp("wavelet", (col,), n - 1, fn)


def trend_seasonal(df: DataFrame, col: str = "mid", period: int = 24, order: Order = TICKS) -> DataFrame:
    """W27 centred-mean trend and mean detrended value per phase."""
    lo, hi = (-(period // 2), period // 2 - 1) if period % 2 == 0 else (-(period // 2), period // 2)

    def fn(d, w):
        return d.withColumn("trend", F.avg(col).over(w.rowsBetween(lo, hi)))

    d = rolling(df, fn, -lo, hi, order, keep_index=True).withColumn("__ph", c(IDX) % period).drop(IDX)
    keys = list(order.keys)
    phases = d.groupBy(*keys, "__ph").agg(F.avg(c(col) - c("trend")).alias("seasonal"))
    return d.join(phases, [*keys, "__ph"], "left").drop("__ph")


def window_stats(col: str = "mid", n: int = 30) -> RowOp:
    """W56 absolute change, lag-1 autocorrelation, complexity, kurtosis and skewness."""

    def fn(d, w):
        frame, steps = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(n - 2), 0)
        d = d.withColumns({"__p": prev(col, w), "__d": c(col) - prev(col, w)})
        d = d.withColumns(
            {
                "__n": F.count(col).over(frame),
                "__mu": F.avg(col).over(frame),
                "__sd": F.stddev_pop(col).over(frame),
                "__abs": F.sum(F.abs("__d")).over(steps),
                "__dd": F.sum(c("__d") * c("__d")).over(steps),
                "__xy": F.sum(c(col) * c("__p")).over(steps),
                "__sx": F.sum(col).over(steps),
                "__sy": F.sum("__p").over(steps),
                "__g1": F.skewness(col).over(frame),
                "__g2": F.kurtosis(col).over(frame),
            }
        )
        cov = (c("__xy") - c("__mu") * (c("__sx") + c("__sy")) + (n - 1) * c("__mu") * c("__mu")) / (n - 1)
        ok = c("__n") == n
        new = {
            "abs_change": c("__abs"),
            "autocorr_1": safe_div(cov, c("__sd") * c("__sd")),
            "complexity": F.sqrt(safe_div(c("__dd"), c("__sd") * c("__sd"))),
            "kurtosis": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * c("__g2") + 6),
            "skewness": math.sqrt(n * (n - 1)) / (n - 2) * c("__g1"),
        }
        d = d.withColumns({k: F.when(ok, v) for k, v in new.items()})
        return d.drop("__p", "__d", "__n", "__mu", "__sd", "__abs", "__dd", "__xy", "__sx", "__sy", "__g1", "__g2")

    return RowOp("window_stats", (col,), n, fn)


def variance_recursion(df: DataFrame, col: str = "return", omega=0.1, alpha=0.1, beta=0.8, order: Order = TICKS) -> DataFrame:
    """W58 fixed-parameter conditional volatility: root of a variance that starts at 0."""
    d = rolling(df, lambda d, w: d.withColumn("__p", prev(col, w)), 1, 0, order, keep_index=True)
    first = c(IDX) == 0
    a = F.when(first, 0.0).otherwise(beta)
    b = F.when(first, 0.0).otherwise(omega + alpha * c("__p") * c("__p"))
    d = linear_scan(d, {"__var": (a, b)}, order)
    return own_index(df, d.withColumn("garch_vol", F.sqrt("__var")).drop("__p", "__var"))


def exit_levels(df: DataFrame, price: str, vol: str, regime: str, n=14, mult=3.0, threshold=0.02, order: Order = TICKS) -> DataFrame:
    """W59 stop and target at ``mult`` ranges from the price.

    The adaptive pair is widened by the volatility band and by a change of the
    last known regime.
    """
    d = running(df, {"__before": ("last", c(regime))}, order, exclusive=True)
    d = atr_mid(n, price)(d, order)
    scale = F.when(c(vol) > threshold, 1.5).when(c(vol) < threshold / 2, 0.8).otherwise(1.0)
    scale = scale * F.when(F.coalesce(c(regime) != c("__before"), F.lit(False)), 1.2).otherwise(1.0)
    reach = c("atr_mid") * mult
    return d.withColumns(
        {
            "base_sl": c(price) - reach,
            "base_tp": c(price) + reach,
            "adaptive_sl": c(price) - reach * scale,
            "adaptive_tp": c(price) + reach * scale,
        }
    ).drop("__before", "atr_mid")


def index_features(df: DataFrame, name: str, close: str = "Close", n: int = 21, order: Order = TICKS) -> DataFrame:
    """W60 daily return of an index and its rolling volatility."""

    def fn(d, w):
        d = d.withColumn(f"{name}_ret", safe_div(c(close), prev(close, w)) - 1)
        return d.withColumn(f"{name}_vol", full(F.stddev_samp, f"{name}_ret", n, w))

    return rolling(df, fn, n, 0, order)


def price_block(high: str | None = None, low: str | None = None) -> RowOp:
    """W09 the standard price features from Bid, Ask and Timestamp in one pass."""

    def fn(d, w):
        d = d.withColumns({"spread": c("Ask") - c("Bid"), "mid": (c("Ask") + c("Bid")) / 2})
        p = prev("mid", w)
        d = d.withColumns(
            {
                "return": F.coalesce(safe_div(c("mid"), p) - 1, F.lit(0.0)),
                "mid_change": F.coalesce(c("mid") - p, F.lit(0.0)),
                "spread_change": F.coalesce(c("spread") - prev("spread", w), F.lit(0.0)),
            }
        )
        for op in (*[sma("mid", n) for n in (5, 10, 30, 60)], sma("mid", 240, "ma_h4"), bollinger("mid", 20)):
            d = op.fn(d, w)
        d = atr(14, high or "mid", low or "mid", "mid").fn(d, w)
        d = donchian("mid", 20).fn(d, w)
        d = volatility("return", 30).fn(d, w)
        d = rsi("mid", 14).fn(d, w)
        hour = F.hour("Timestamp")
        return d.withColumns(
            {
                "hour": hour,
                "hour_sin": F.sin(2 * math.pi * hour / 24),
                "hour_cos": F.cos(2 * math.pi * hour / 24),
                "ma_cross": flag(c("ma_5") > c("ma_10")),
                "trade_rate": F.lit(0.0),
                "quote_revision": F.lit(0.0),
                "market_regime": F.lit(0),
            }
        ).drop("boll_ma", "boll_width")

    return RowOp("price_block", ("Bid", "Ask"), 239, fn)
