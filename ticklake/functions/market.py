"""Column expressions over quotes, books, times and probabilities."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.base import MissingColumns, nz, safe_div
from ..plans.ordered import micros

c = F.col


def time_features(ts: str = "Timestamp") -> dict[str, Column]:
    """X01 hour of day and day of week (Monday 0) on the circle."""
    h = (F.hour(ts) + F.minute(ts) / 60.0) * (2 * math.pi / 24)
    d = F.weekday(ts) * (2 * math.pi / 7)
    return {
        "hour_of_day_sin": F.sin(h),
        "hour_of_day_cos": F.cos(h),
        "day_of_week_sin": F.sin(d),
        "day_of_week_cos": F.cos(d),
    }


# fixed values: session, zone, local start and end in seconds of the day
SESSIONS = (
    ("london", "Europe/London", 8 * 3600, 16 * 3600),
    ("new_york", "America/New_York", 8 * 3600, 17 * 3600),
    ("tokyo", "Asia/Tokyo", 9 * 3600, 17 * 3600),
)


def _local_second(ts: str | Column, zone: str) -> Column:
    local = F.from_utc_timestamp((c(ts) if isinstance(ts, str) else ts).cast("timestamp"), zone)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def session(ts: str = "Timestamp") -> Column:
    """X02 first open session of a UTC time, NULL outside all."""
    out = None
    for name, zone, start, end in SESSIONS:
        s = _local_second(ts, zone)
        cond = (s >= start) & (s < end)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def session_onehot(ts: str = "Timestamp") -> dict[str, Column]:
    """X03 one flag per session."""
    now = session(ts)
    return {f"session_{n}": F.coalesce(now == n, F.lit(False)).cast("int") for n, *_ in SESSIONS}


def session_cycle(ts: str = "Timestamp") -> dict[str, Column]:
    """X03 elapsed share of each session on the circle, 0 outside it."""
    out = {}
    for name, zone, start, end in SESSIONS:
        s = _local_second(ts, zone)
        micro = (micros(ts) % 1_000_000) / 1e6
        angle = (s + micro - start) * (2 * math.pi / (end - start))
        inside = (s >= start) & (s < end)
        out[f"{name}_sin"] = F.when(inside, F.sin(angle)).otherwise(0.0)
        out[f"{name}_cos"] = F.when(inside, F.cos(angle)).otherwise(0.0)
    return out


def market_open(ts: str = "Timestamp") -> Column:
    """X04 weekday test; join an exchange calendar for holidays."""
    return F.weekday(ts) < 5


def with_calendar(df: DataFrame, calendar: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """X04 open flag from a calendar table (date, open_ts, close_ts); days not listed are closed."""
    cal = calendar.select(c("date").alias("__d"), "open_ts", "close_ts")
    d = df.withColumn("__d", F.to_date(ts)).join(cal, "__d", "left")
    is_open = F.coalesce((c(ts) >= c("open_ts")) & (c(ts) < c("close_ts")), F.lit(False))
    return d.withColumn("is_open", is_open).drop("__d", "open_ts", "close_ts")


def mid(bid: str = "Bid", ask: str = "Ask") -> Column:
    """X05 mid price."""
    return (c(bid) + c(ask)) / 2


def find_col(df: DataFrame, names: Sequence[str]) -> str:
    for n in names:
        if n in df.columns:
            return n
    raise MissingColumns("missing columns: one of " + ", ".join(names))


# fixed values: accepted names of top-of-book columns
BID_PX = ("bid_px_0", "BidPrice0", "BidPrice1", "Bid")
ASK_PX = ("ask_px_0", "AskPrice0", "AskPrice1", "Ask")
BID_SZ = ("bid_sz_0", "BidVolume0", "BidVolume1", "bid_size", "bid_volume", "BidVolume")
ASK_SZ = ("ask_sz_0", "AskVolume0", "AskVolume1", "ask_size", "ask_volume", "AskVolume")


def microprice(df: DataFrame) -> DataFrame:
    """X06 size-weighted price of the top of the book and its distance from the mid."""
    bp, ap, bs, az = (c(find_col(df, x)) for x in (BID_PX, ASK_PX, BID_SZ, ASK_SZ))
    m = (bp + ap) / 2
    d = df.withColumn("microprice", F.coalesce(safe_div(ap * bs + bp * az, bs + az), m))
    return d.withColumn("microprice_delta", c("microprice") - m)


def fold_levels(df: DataFrame) -> DataFrame:
    """IO13 wide level columns to arrays ``bids`` and ``asks`` of (px, sz), best level first."""
    styles = [("BidPrice{}", "BidVolume{}", "AskPrice{}", "AskVolume{}"), ("bid_px_{}", "bid_sz_{}", "ask_px_{}", "ask_sz_{}")]
    have = set(df.columns)
    for style in styles:
        pattern = re.compile(style[0].replace("{}", r"(\d+)") + "$")
        levels = sorted(int(m.group(1)) for x in have if (m := pattern.match(x)))
        levels = [i for i in levels if all(s.format(i) in have for s in style)]
        if levels:
            bp, bs, ap, az = style
            side = lambda px, sz: F.array(
                *[F.struct(c(px.format(i)).cast("double").alias("px"), c(sz.format(i)).cast("double").alias("sz")) for i in levels]
            )
            used = {s.format(i) for s in style for i in levels}
            return df.select(*[x for x in df.columns if x not in used], side(bp, bs).alias("bids"), side(ap, az).alias("asks"))
    raise MissingColumns("missing columns: order-book levels")


def _total(levels: Column, f) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + F.coalesce(f(x), F.lit(0.0)))


def book_features() -> dict[str, Column]:
    """X07 imbalance, volume-weighted spread, impact, depth and slippage of ``bids`` / ``asks``."""
    bid, ask = _total(c("bids"), lambda x: x["sz"]), _total(c("asks"), lambda x: x["sz"])
    pairs = F.arrays_zip(c("bids").alias("bids"), c("asks").alias("asks"))
    vol = lambda x: x["bids"]["sz"] + x["asks"]["sz"]
    spread = safe_div(_total(pairs, lambda x: (x["asks"]["px"] - x["bids"]["px"]) * vol(x)), _total(pairs, vol))
    imb = F.coalesce(safe_div(bid - ask, bid + ask), F.lit(0.0))
    impact = F.coalesce(spread * imb, F.lit(0.0))
    return {
        "depth_imbalance": imb,
        "vw_spread": spread,
        "market_impact": impact,
        "total_depth": bid + ask,
        "slippage": F.abs(spread) + F.abs(impact),
    }


def liquidity_exhaustion(df: DataFrame, ticks: int = 3, upper: float = 2.0, lower: float = 0.5) -> DataFrame:
    """X08 depth ratio within ``ticks`` spreads of the mid and the side that is exhausted."""
    b0, a0 = c("bids")[0]["px"], c("asks")[0]["px"]
    m, reach = (b0 + a0) / 2, ticks * nz(a0 - b0)
    near = lambda levels, dist: _total(F.filter(levels, lambda x: F.coalesce(dist(x) <= reach, F.lit(False))), lambda x: x["sz"])
    bid, ask = near(c("bids"), lambda x: m - x["px"]), near(c("asks"), lambda x: x["px"] - m)
    d = df.withColumn("liq_ratio", F.coalesce(safe_div(bid, ask), F.lit(0.0)))
    return d.withColumn("liq_exhaustion", F.when(c("liq_ratio") > upper, 1).when(c("liq_ratio") < lower, -1).otherwise(0))


def walk_slippage(size: Column, side: Column) -> Column:
    """X09 cost in basis points of taking ``size`` from the book, against the mid.

    NULL where the book is too thin.
    """
    m = (c("bids")[0]["px"] + c("asks")[0]["px"]) / 2
    levels = F.when(F.lower(side) == "buy", c("asks")).otherwise(c("bids"))
    start = F.struct(size.cast("double").alias("left"), F.lit(0.0).alias("cost"))

    def take(acc, x):
        q = F.least(acc["left"], x["sz"])
        return F.struct((acc["left"] - q).alias("left"), (acc["cost"] + q * x["px"]).alias("cost"))

    end = F.aggregate(levels, start, take)
    px = safe_div(end["cost"], size.cast("double"))
    sign = F.when(F.lower(side) == "buy", 1.0).otherwise(-1.0)
    return F.when(end["left"] <= 1e-12, sign * (px - m) / nz(m) * 1e4)


def simulated_fills() -> dict[str, Column]:
    """X10 buy and sell fills half a spread and the impact away from the mid."""
    half = c("vw_spread") / 2 + c("market_impact")
    return {"buy_fill": c("mid") + half, "sell_fill": c("mid") - half}


def entry_value(imbalance: Column, volatility: Column, regime: Column | None = None, depth_w=0.5, vol_w=0.3, cost=0.0) -> Column:
    """X11 expected value of entering now; ``regime`` is an embedding array."""
    base = depth_w * imbalance - vol_w * volatility - cost
    if regime is None:
        return base
    n = F.size(regime)
    mean = F.aggregate(regime, F.lit(0.0), lambda a, x: a + F.tanh(x)) / nz(n)
    return base + F.when(n > 0, mean).otherwise(0.0)


def position_size(
    capital: Column,
    method: str = "kelly",
    prob: Column | None = None,
    risk: Column | None = None,
    confidence: Column | None = None,
    slippage: Column | None = None,
    liquidity: Column | None = None,
    target_vol: float = 0.01,
    odds: float = 1.0,
    predicted_vol: Column | None = None,
) -> Column:
    """X12 size by Kelly fraction, VaR, expected shortfall or volatility target, then scaled and capped."""
    if method == "kelly":
        frac = F.greatest(F.least((odds * prob - (1 - prob)) / odds, F.lit(1.0)), F.lit(0.0))
        size = capital * frac
        if predicted_vol is not None:
            size = size * F.when(predicted_vol > 0, target_vol / F.greatest(predicted_vol, F.lit(1e-12))).otherwise(1.0)
    elif method in ("var", "es"):
        size = capital * target_vol / F.greatest(risk, F.lit(1e-12))
    elif method == "vol":
        size = F.when(risk > 0, capital * target_vol / nz(risk)).otherwise(0.0)
    else:
        raise ValueError(f"unknown sizing method {method!r}")
    if confidence is not None:
        size = size * F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0))
    if slippage is not None:
        size = F.when(slippage > 0, size / (1 + F.greatest(slippage, F.lit(0.0)))).otherwise(size)
    if liquidity is not None:
        size = F.least(size, liquidity)
    return size


def odds(p: Column) -> Column:
    """X21 odds of a probability strictly between 0 and 1."""
    return F.when((p > 0) & (p < 1), p / nz(1 - p))


def expected_score(a: Column, b: Column) -> Column:
    """X25 logistic expectation of rating ``a`` against ``b``."""
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def minutes_between(a: str | Column, b: str | Column) -> Column:
    """X26 minutes from ``a`` to ``b``."""
    return (micros(b) - micros(a)) / 60e6


# fixed values: what a stored formula may contain
FORMULA_FUNCTIONS = {"abs", "coalesce", "exp", "greatest", "least", "ln", "log", "nullif", "pow", "power", "sign", "sqrt", "tanh"}
_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|([-+*/%(),<>=!]))")


def check_formula(text: str, columns: Sequence[str]) -> str:
    """Let through arithmetic over known columns and allowed functions only."""
    pos, words = 0, re.compile(r"^(and|or|not|case|when|then|else|end)$", re.I)
    while pos < len(text.rstrip()):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"formula not allowed at {text[pos:pos + 10]!r}")
        name = m.group(1)
        if name and name not in columns and name.lower() not in FORMULA_FUNCTIONS and not words.match(name):
            raise ValueError(f"formula uses unknown name {name!r}")
        pos = m.end()
    return text


def apply_formulas(df: DataFrame, formulas: Sequence[Mapping[str, str]]) -> DataFrame:
    """X27/P05 named stored SQL expressions in order; later ones may use earlier ones."""
    for f in formulas:
        df = df.withColumn(f["name"], F.expr(check_formula(f["formula"], df.columns)))
    return df


COMPARISONS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def compare(df: DataFrame, lhs: str | float, op: str, rhs: str | float) -> Column:
    """X28 predicate of two columns or numbers; NULL counts as false."""
    side = lambda v: c(v) if isinstance(v, str) and v in df.columns else F.lit(float(v))
    return F.coalesce(COMPARISONS[op](side(lhs), side(rhs)), F.lit(False))


def credible_interval(mean: Column, variance: Column, z: float = 1.96) -> dict[str, Column]:
    """X29 mean +- z standard deviations."""
    half = z * F.sqrt(variance)
    return {"ci_lower": mean - half, "ci_upper": mean + half}


def shrink_by_width(size: Column, lower: Column, upper: Column) -> Column:
    """X29 size reduced by the width of its interval."""
    return size * F.greatest(1 - F.abs(upper - lower), F.lit(0.0))


def min_max(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), low: float = 0.0, high: float = 1.0) -> DataFrame:
    """X30 columns scaled to [low, high] per key; constant columns go to ``low``."""
    from ..plans.ordered import attach

    stats = df.groupBy(*keys).agg(*[f(x).alias(f"__{n}_{x}") for x in cols for n, f in (("lo", F.min), ("hi", F.max))])
    d = attach(df, stats, list(keys))
    new = {x: low + (high - low) * F.coalesce(safe_div(c(x) - c(f"__lo_{x}"), c(f"__hi_{x}") - c(f"__lo_{x}")), F.lit(0.0)) for x in cols}
    return d.withColumns(new).select(df.columns)
