"""Return statistics, tail risk, budgets and exposures."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import IDX, Order, attach, row_index, running
from ..plans.values import average_ranks, cumulative_by_value, exact_quantiles
from .base import nz, safe_div

c = F.col


def growth(df: DataFrame, ret: str, order: Order, out: str = "growth") -> DataFrame:
    """Running product of 1 + return, exact in sign also where a return is -100 % or below."""
    g = 1 + c(ret)
    d = running(
        df,
        {
            "__ln": ("sum", F.ln(F.abs(nz(g)))),
            "__neg": ("count", F.when(g < 0, 1)),
            "__zero": ("count", F.when(g == 0, 1)),
        },
        order,
    )
    sign = F.when(c("__neg") % 2 == 0, 1.0).otherwise(-1.0)
    value = F.when(c("__zero") > 0, 0.0).otherwise(sign * F.exp(F.coalesce(c("__ln"), F.lit(0.0))))
    return d.withColumn(out, value).drop("__ln", "__neg", "__zero")


def performance(df: DataFrame, ret: str, order: Order, periods: int = 252) -> DataFrame:
    """A20/A21 the drawdown and Sharpe forms in use, one row per key.

    ``sharpe`` is annualised over the population deviation, ``sharpe_raw`` not
    annualised, ``sharpe_eps`` with 1e-9 added to the deviation, ``sharpe_n``
    scaled by the root of the count over the sample deviation.
    """
    keys = list(order.keys)
    d = growth(df, ret, order)
    d = running(d, {"__cum": ("sum", c(ret)), "__peak": ("max", c("growth"))}, order)
    d = running(d, {"__cpeak": ("max", c("__cum"))}, order)
    place = F.struct(*order.by())
    out = d.groupBy(*keys).agg(
        F.count(ret).alias("n"),
        F.avg(ret).alias("mean"),
        F.stddev_pop(ret).alias("__sp"),
        F.stddev_samp(ret).alias("__ss"),
        F.sum(ret).alias("pnl"),
        F.avg((c(ret) > 0).cast("double")).alias("win_rate"),
        (F.max_by("growth", place) - 1).alias("total_return"),
        F.min(safe_div(c("growth"), c("__peak")) - 1).alias("dd_pct"),
        F.max(c("__peak") - c("growth")).alias("dd_abs"),
        F.max(c("__cpeak") - c("__cum")).alias("dd_sum"),
        F.max((c("__cpeak") - c("__cum")) / F.greatest(c("__cpeak"), F.lit(1e-8))).alias("dd_sum_ratio"),
        F.coalesce(-F.min(F.least(c(ret), F.lit(0.0))), F.lit(0.0)).alias("worst_loss"),
    )
    flat = c("__sp") < 1e-12
    return out.withColumns(
        {
            "volatility": c("__ss"),
            "sharpe": F.when(flat, 0.0).otherwise(math.sqrt(periods) * safe_div(c("mean"), c("__sp"))),
            "sharpe_raw": F.when(flat, 0.0).otherwise(safe_div(c("mean"), c("__sp"))),
            "sharpe_eps": c("mean") / (c("__sp") + 1e-9),
            "sharpe_n": F.when(c("n") > 1, c("mean") / (c("__ss") + 1e-8) * F.sqrt("n")).otherwise(0.0),
        }
    ).drop("__sp", "__ss")


def cvar(df: DataFrame, keys: Sequence[str], ret: str, level: float = 0.05) -> DataFrame:
    """Value at risk (the ``level`` quantile) and the mean of the returns at or below it."""
    q = exact_quantiles(df, keys, ret, [level]).select(*keys, c("value").alias("var"))
    d = attach(df, q, list(keys))
    return d.groupBy(*keys).agg(F.first("var").alias("var"), F.avg(F.when(c(ret) <= c("var"), c(ret))).alias("cvar"))


def turnover(df: DataFrame, position: str, order: Order) -> DataFrame:
    """Sum of absolute position changes per key."""
    before = running(df, {"__prev": ("last", c(position))}, order, exclusive=True)
    return before.groupBy(*order.keys).agg(F.coalesce(F.sum(F.abs(c(position) - c("__prev"))), F.lit(0.0)).alias("turnover"))


def benchmark(df: DataFrame, ret: str, position: str, order: Order) -> DataFrame:
    """A16 Sharpe, CVaR at 95 % and turnover per (dataset, risk profile)."""
    keys = list(order.keys)
    stats = df.groupBy(*keys).agg(F.avg(ret).alias("__m"), F.stddev_pop(ret).alias("__s"))
    stats = stats.select(*keys, F.coalesce(math.sqrt(252) * safe_div(c("__m"), c("__s")), F.lit(0.0)).alias("sharpe"))
    return stats.join(cvar(df, keys, ret).drop("var"), keys).join(turnover(df, position, order), keys)


def last_rows(df: DataFrame, n: int, order: Order) -> DataFrame:
    """K06 the last ``n`` rows of each key (a grouped limit, cut before the shuffle)."""
    w = Window.partitionBy(*order.keys).orderBy(*order.sort(reverse=True))
    return df.withColumn("__rn", F.row_number().over(w)).where(c("__rn") <= n).drop("__rn")


def scoreboard(df: DataFrame, actions: Mapping[str, Column], ret: str, n: int, order: Order, daily_limit=math.inf, total_limit=math.inf) -> DataFrame:
    """A14/P08 pnl, Sharpe, drawdown and limit flags per group and algorithm on the last ``n`` rows.

    ``actions`` are the strategies: a name and a position expression each.
    """
    tail = last_rows(df, n, order)
    arms = F.array(*[F.struct(F.lit(k).alias("algorithm"), (a * c(ret)).alias("r")) for k, a in actions.items()])
    long = tail.withColumn("__arm", F.explode(arms)).select(*tail.columns, "__arm.algorithm", c("__arm.r").alias("__r"))
    p = performance(long, "__r", order.with_keys(*order.keys, "algorithm"))
    return p.select(
        *order.keys,
        "algorithm",
        "pnl",
        c("sharpe_eps").alias("sharpe"),
        c("dd_abs").alias("drawdown"),
        c("worst_loss").alias("daily_loss"),
        (c("worst_loss") > daily_limit).alias("daily_limit_violation"),
        (c("dd_abs") > total_limit).alias("total_limit_violation"),
    )


def classification_risk(df: DataFrame, y: str, pred: str, order: Order, weights: Mapping[str, float] | None = None) -> DataFrame:
    """A22 +-1 outcomes of taken trades: Sharpe, Calmar, F1, drawdown, weighted objective."""
    keys = list(order.keys)
    r = F.when(c(pred) == 1, F.when(c(y) == 1, 1.0).otherwise(-1.0)).otherwise(0.0)
    d = running(df.withColumn("__r", r), {"__cum": ("sum", c("__r"))}, order)
    d = running(d, {"__peak": ("max", c("__cum"))}, order)
    out = d.groupBy(*keys).agg(
        F.avg("__r").alias("expected_return"),
        F.stddev_pop("__r").alias("__s"),
        F.max(c("__peak") - c("__cum")).alias("drawdown"),
        F.count_if((c(y) == 1) & (c(pred) == 1)).alias("__tp"),
        F.count_if(c(pred) == 1).alias("__pp"),
        F.count_if(c(y) == 1).alias("__ap"),
    )
    w = weights or {"f1": 1.0, "return": 1.0, "drawdown": 1.0}
    out = out.withColumns(
        {
            "sharpe": c("expected_return") / (c("__s") + 1e-9),
            "calmar": c("expected_return") / (c("drawdown") + 1e-9),
            "f1": F.coalesce(safe_div(2.0 * c("__tp"), c("__pp") + c("__ap")), F.lit(0.0)),
        }
    )
    objective = w.get("f1", 0.0) * c("f1") + w.get("return", 0.0) * c("expected_return") - w.get("drawdown", 0.0) * c("drawdown")
    return out.withColumn("objective", objective).drop("__s", "__tp", "__pp", "__ap")


def poisson_weight(*parts: Column, limit: int = 18) -> Column:
    """Poisson(1) draw from a hash: the same row and replicate always draw the same weight.

    The draw has 53 bits; from 18 on the distribution function is 1 at that precision.
    """
    u = (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double")) / float(1 << 53)
    draw, cum, p = F.lit(limit), [], math.exp(-1)
    total = 0.0
    for k in range(limit):
        total += p
        cum.append(total)
        p /= k + 1
    for k in reversed(range(limit)):
        draw = F.when(u < cum[k], k).otherwise(draw)
    return draw


def bootstrap_sharpe(df: DataFrame, ret: str, row_id: str, replicates: int = 200, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """A23 Poisson bootstrap of the Sharpe ratio: observed value, mean, deviation, p-value of <= 0.

    Each row enters replicate b with a Poisson(1) weight, so replicates are
    plain weighted sums with map-side combine.  Close to the resampling form,
    not equal to it.
    """
    keys = list(keys)
    reps = df.select(*keys, row_id, c(ret).alias("__r")).withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    reps = reps.withColumn("__w", poisson_weight(c(row_id), c("__b"), F.lit(seed)))
    sums = reps.groupBy(*keys, "__b").agg(
        F.sum("__w").alias("n"), F.sum(c("__w") * c("__r")).alias("s"), F.sum(c("__w") * c("__r") * c("__r")).alias("q")
    )
    m = safe_div(c("s"), c("n"))
    sd = F.sqrt(F.greatest(safe_div(c("q"), c("n")) - m * m, F.lit(0.0)))
    sums = sums.withColumn("sharpe", F.coalesce(safe_div(m, sd), F.lit(0.0)))
    boot = sums.groupBy(*keys).agg(
        F.avg("sharpe").alias("sharpe_mean"),
        F.stddev_pop("sharpe").alias("sharpe_std"),
        F.avg((c("sharpe") <= 0).cast("double")).alias("p_value"),
    )
    seen = df.groupBy(*keys).agg(F.coalesce(safe_div(F.avg(ret), F.stddev_pop(ret)), F.lit(0.0)).alias("sharpe"))
    return attach(seen, boot, keys)


def bootstrap_classification(df: DataFrame, y: str, pred: str, row_id: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """A23 Poisson bootstrap of precision, recall and F1 with 95 % bounds."""
    reps = df.select(row_id, y, pred).withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    reps = reps.withColumn("__w", poisson_weight(c(row_id), c("__b"), F.lit(seed)))
    hit = lambda cond: F.sum(F.when(cond, c("__w")).otherwise(0)).cast("double")
    s = reps.groupBy("__b").agg(
        hit((c(y) == 1) & (c(pred) == 1)).alias("tp"), hit(c(pred) == 1).alias("pp"), hit(c(y) == 1).alias("ap")
    )
    zero = F.lit(0.0)
    s = s.select(
        F.coalesce(safe_div(c("tp"), c("pp")), zero).alias("precision"),
        F.coalesce(safe_div(c("tp"), c("ap")), zero).alias("recall"),
        F.coalesce(safe_div(2 * c("tp"), c("pp") + c("ap")), zero).alias("f1"),
    )
    # at most ``replicates`` rows from here on
    return s.unpivot([], ["precision", "recall", "f1"], "metric", "v").groupBy("metric").agg(
        F.avg("v").alias("mean"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high")
    )


def decayed_var(df: DataFrame, pnl: str, order: Order, window: int = 500, alpha: float = 0.06, pct: float = 0.01) -> DataFrame:
    """A24 value at risk of the last ``window`` values, each shrunk by (1 - alpha)^age."""
    w = Window.partitionBy(*order.keys).orderBy(*order.sort(reverse=True))
    d = df.withColumn("__age", F.row_number().over(w) - 1).where(c("__age") < window)
    shrunk = c(pnl) * F.pow(F.lit(1.0 - alpha), c("__age"))
    return d.groupBy(*order.keys).agg((-F.percentile(shrunk, pct)).alias("var"))  # at most ``window`` rows per key


def tail_exceedances(df: DataFrame, keys: Sequence[str], ret: str, threshold: float, level: float | None = None, breach_prob: float = 0.05) -> DataFrame:
    """A24 losses beyond ``threshold``: count, mean excess, tail probability and breach.

    The tail shape is fitted by the method of moments (an approximation).
    """
    u = abs(threshold)
    x = max(abs(level) if level is not None else u, u)
    excess = F.when((c(ret) < 0) & (-c(ret) > u), -c(ret) - u)
    d = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count(excess).alias("n_exceed"), F.avg(excess).alias("mean_excess"), F.var_samp(excess).alias("__v")
    )
    ratio = safe_div(c("mean_excess") * c("mean_excess"), c("__v"))
    d = d.withColumn("shape", 0.5 * (1 - ratio)).withColumn("scale", 0.5 * c("mean_excess") * (ratio + 1))
    base = F.greatest(1 + c("shape") * (x - u) / nz(c("scale")), F.lit(0.0))
    sf = F.when(F.abs(c("shape")) < 1e-9, F.exp(-(x - u) / nz(c("scale")))).otherwise(F.pow(base, -1 / nz(c("shape"))))
    if x == u:
        sf = F.lit(1.0)
    enough = c("n_exceed") >= 3
    d = d.withColumn("tail_prob", F.when(enough, c("n_exceed") / c("total") * sf).otherwise(0.0))
    return d.withColumn("breach", c("tail_prob") > breach_prob).drop("__v")


# fixed values: crisis periods
CRISES = {"2008": ("2007-10-01", "2009-03-31"), "covid": ("2020-02-01", "2020-05-31")}


def stress(
    df: DataFrame,
    pnl: str,
    order: Order,
    crises: Mapping[str, tuple[str, str]] = CRISES,
    shock: float = 0.1,
    multipliers: Mapping[str, float] | None = None,
    max_drawdown: float = 1.0,
    max_liquidity: float = math.inf,
) -> DataFrame:
    """A25 baseline, crisis windows, first-row shock and multiplied scenarios per strategy."""
    keys, ts = list(order.keys), order.ts
    d = row_index(df, order)
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    arms = [F.struct(F.lit("baseline").alias("scenario"), c(pnl).alias("p"))]
    for name, (start, end) in crises.items():
        inside = (c(ts) >= day(start)) & (c(ts) < day(end) + F.expr("INTERVAL 1 DAY"))
        arms.append(F.when(inside, F.struct(F.lit(name).alias("scenario"), c(pnl).alias("p"))))
    first = F.when(c(IDX) == 0, c(pnl) - shock).otherwise(c(pnl))
    arms.append(F.struct(F.lit("synthetic").alias("scenario"), first.alias("p")))
    for name, size in (multipliers or {}).items():
        arms.append(F.struct(F.lit(name).alias("scenario"), (c(pnl) * (1 + size)).alias("p")))
    long = d.withColumn("__arm", F.explode(F.filter(F.array(*arms), lambda a: a.isNotNull())))
    long = long.select(*keys, ts, *order.tie, c("__arm.scenario").alias("scenario"), c("__arm.p").alias("__p"))
    o = order.with_keys(*keys, "scenario")
    long = running(long, {"__cum": ("sum", c("__p")), "__n": ("count", c("__p"))}, o)
    long = running(long, {"__peak": ("max", c("__cum"))}, o)
    gap = c("__cum") - c("__peak")
    out = long.groupBy(*keys, "scenario").agg(
        F.sum("__p").alias("pnl"),
        (-F.min(gap)).alias("max_drawdown"),
        F.coalesce(F.max(F.when(gap == 0, c("__n") - 1)), F.count(F.lit(1))).alias("recovery"),
        F.sum(F.abs("__p")).alias("liquidity"),
    )
    base = out.where(c("scenario") == "baseline").select(*keys, c("max_drawdown").alias("__base"))
    out = out.join(base, keys)
    hedge = F.when((c("scenario") == "baseline") | (c("__base") == 0), 1.0).otherwise(1 - c("max_drawdown") / nz(c("__base")))
    action = (
        F.when((c("max_drawdown") > max_drawdown) | (c("liquidity") > max_liquidity), "disable")
        .when(c("max_drawdown") > 0.5 * max_drawdown, "adjust")
        .otherwise("ok")
    )
    return out.withColumn("hedge", hedge).withColumn("action", action).drop("__base")


def conformal_quantiles(df: DataFrame, residual: Column, alpha: float = 0.1, keys: Sequence[str] = ("regime",)) -> DataFrame:
    """A30 (1 - alpha) quantile of the absolute residual by regime."""
    d = df.withColumn("__abs", F.abs(residual))
    return exact_quantiles(d, keys, "__abs", [1 - alpha]).select(*keys, c("value").alias("q"))


def conformal_intervals(df: DataFrame, pred: str, q: DataFrame, keys: Sequence[str] = ("regime",)) -> DataFrame:
    """A30 prediction +- the quantile of the row's regime."""
    d = attach(df, q, list(keys))
    return d.withColumn("lower", c(pred) - c("q")).withColumn("upper", c(pred) + c("q"))


def coverage(df: DataFrame, y: str, keys: Sequence[str] = ("regime",)) -> DataFrame:
    """A30 share of outcomes inside their interval by regime."""
    return df.groupBy(*keys).agg(F.avg(((c(y) >= c("lower")) & (c(y) <= c("upper"))).cast("double")).alias("coverage"))


def f1_thresholds(df: DataFrame, y: str, prob: str, keys: Sequence[str] = ("regime",)) -> DataFrame:
    """A31 probability threshold with the best F1 per regime (the lowest one on a tie)."""
    cum = cumulative_by_value(df, keys, prob, {"tp": c(y), "pp": F.lit(1)}, reverse=True)
    totals = df.where(c(prob).isNotNull()).groupBy(*keys).agg(F.sum(y).alias("__pos"))
    d = cum.join(totals, list(keys))
    precision = c("cum_tp") / c("cum_pp")
    recall = F.when(c("__pos") == 0, 1.0).otherwise(safe_div(c("cum_tp"), c("__pos")))
    d = d.withColumn("f1", 2 * precision * recall / (precision + recall + 1e-12))
    best = F.max_by(F.struct(c(prob).alias("threshold"), c("f1").alias("f1")), F.struct(F.round("f1", 12), -c(prob)))
    return d.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.threshold", "b.f1")


def reliability(df: DataFrame, y: str, prob: str, bins: int = 10) -> DataFrame:
    """A32 mean probability and outcome rate per bin; ``brier`` gives the score."""
    b = F.least(F.floor(c(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"), F.avg(c(y).cast("double")).alias("rate")
    )


def brier(df: DataFrame, y: str, prob: str, keys: Sequence[str] = ()) -> DataFrame:
    """A32 mean squared distance of probability and outcome."""
    return df.groupBy(*keys).agg(F.avg(F.pow(c(prob) - c(y), 2)).alias("brier"))


def bayesian_weights(df: DataFrame, algorithm: str, pnl: str, safety: float = 10.0, mu0=0.0, lam0=1.0, a0=1.0, b0=1.0) -> DataFrame:
    """A33 Normal-Inverse-Gamma posterior and shrunk Sharpe weights per algorithm."""
    d = df.groupBy(algorithm).agg(F.count(pnl).alias("n"), F.avg(pnl).alias("__m"), F.var_pop(pnl).alias("__v"))
    n, m = c("n"), c("__m")
    d = d.withColumns(
        {
            "mu": (lam0 * mu0 + n * m) / (lam0 + n),
            "lambda": lam0 + n,
            "alpha": a0 + n / 2,
            "beta": b0 + 0.5 * c("__v") * n + lam0 * n * F.pow(m - mu0, 2) / (2 * (lam0 + n)),
        }
    )
    variance = safe_div(c("beta"), c("alpha") - 1)
    score = F.greatest(c("mu") / F.sqrt(variance + 1e-9) * n / (n + safety), F.lit(0.0))
    d = d.withColumn("__s", F.when(c("alpha") > 1, score).otherwise(0.0))
    everything = Window.partitionBy()  # one row per algorithm
    total = F.sum("__s").over(everything)
    weight = F.when(total > 0, c("__s") / nz(total)).otherwise(1 / F.count(F.lit(1)).over(everything))
    return d.withColumn("weight", weight).drop("__m", "__v", "__s")


def budget(df: DataFrame, ret: str, order: Order, capital: float) -> DataFrame:
    """A34 capital in inverse proportion to drawdown times volatility."""
    p = performance(df, ret, order)
    inv = 1 / ((F.abs("dd_pct") + 1e-6) * (c("volatility") + 1e-6) + 1e-12)
    p = p.withColumn("__inv", F.coalesce(inv, F.lit(0.0)))
    share = safe_div(c("__inv"), F.sum("__inv").over(Window.partitionBy()))  # one row per strategy
    return p.select(*order.keys, (capital * F.coalesce(share, F.lit(0.0))).alias("budget"))


def softmax_weights(df: DataFrame, pnl: str, risk: str, alpha=1.0, beta=1.0) -> DataFrame:
    """A34 softmax of alpha * pnl - beta * risk over the strategies."""
    everything = Window.partitionBy()  # one row per strategy
    s = df.withColumn("__s", alpha * c(pnl) - beta * c(risk))
    s = s.withColumn("__e", F.exp(c("__s") - F.max("__s").over(everything)))
    return s.withColumn("weight", c("__e") / F.sum("__e").over(everything)).drop("__s", "__e")


def netted_exposure(positions: DataFrame, corr: DataFrame, symbol: str = "symbol", notional: str = "notional") -> DataFrame:
    """A35 correlation-netted totals of the long and the short book.

    ``corr`` holds ``a, b, corr`` for ordered pairs; missing pairs count 0.
    """
    p = positions.groupBy(symbol).agg(F.sum(notional).alias("v")).where(c("v") != 0)
    p = p.select(c(symbol).alias("s"), F.when(c("v") > 0, "long").otherwise("short").alias("book"), F.abs("v").alias("v"))
    own = p.select("book", (c("v") * c("v")).alias("t"))
    a, b = p.alias("a"), p.alias("b")
    cross = (
        corr.alias("r")
        .join(a, c("r.a") == c("a.s"))
        .join(b, (c("r.b") == c("b.s")) & (c("a.book") == c("b.book")))
        .where(c("r.a") != c("r.b"))
        .select(c("a.book").alias("book"), (c("a.v") * c("b.v") * F.coalesce(c("r.corr"), F.lit(0.0))).alias("t"))
    )
    return own.unionByName(cross).groupBy("book").agg(F.sqrt(F.greatest(F.sum("t"), F.lit(0.0))).alias("exposure"))


def weighted_exposures(positions: DataFrame, corr: DataFrame, symbol: str = "symbol", notional: str = "notional") -> DataFrame:
    """A35 pair table of v_a * v_b * corr, the diagonal with correlation 1."""
    p = positions.groupBy(symbol).agg(F.sum(notional).alias("v")).select(c(symbol).alias("s"), "v")
    pairs = corr.where(c("a") != c("b")).select("a", "b", "corr").unionByName(
        p.select(c("s").alias("a"), c("s").alias("b"), F.lit(1.0).alias("corr"))
    )
    x = pairs.join(p.select(c("s").alias("a"), c("v").alias("va")), "a").join(p.select(c("s").alias("b"), c("v").alias("vb")), "b")
    return x.select("a", "b", (c("va") * c("vb") * c("corr")).alias("exposure"))


def convert_currency(df: DataFrame, rates: DataFrame, currency: str, amount: str, out: str = "converted") -> DataFrame:
    """A35 amounts at the rate of their currency, 1 where none is known."""
    r = rates.select(c("currency").alias(currency), c("rate").alias("__rate"))
    return df.join(r, currency, "left").withColumn(out, c(amount) * F.coalesce(c("__rate"), F.lit(1.0))).drop("__rate")


def consensus(df: DataFrame, keys: Sequence[str], signal: str, weight: Column) -> DataFrame:
    """A36 1 - weighted mean absolute deviation of the clipped signals of a group."""
    keys = list(keys)
    v = F.greatest(F.least(c(signal), F.lit(1.0)), F.lit(-1.0))
    d = df.withColumn("__v", v).withColumn("__w", weight)
    mean = d.groupBy(*keys).agg(safe_div(F.sum(c("__v") * c("__w")), F.sum("__w")).alias("mean"))
    out = d.join(mean, keys).groupBy(*keys).agg(
        F.first("mean").alias("mean"), safe_div(F.sum(F.abs(c("__v") - c("mean")) * c("__w")), F.sum("__w")).alias("__dev")
    )
    return out.withColumn("consensus", F.greatest(F.least(1 - c("__dev"), F.lit(1.0)), F.lit(0.0))).drop("__dev")


def logit_average(probs: Sequence[Column]) -> Column:
    """A37 mean of the logits, back as a probability."""
    logits = [F.ln(p / (1 - p + 1e-12)) for p in probs]
    return 1 / (1 + F.exp(-sum(logits[1:], logits[0]) / len(logits)))


def factor_exposures(df: DataFrame, y: str, factors: Sequence[str], keys: Sequence[str] = ("Symbol",)) -> DataFrame:
    """A38 least-squares exposures without intercept: cross-products in one aggregate, a k x k solve per key."""
    import numpy as np
    import pandas as pd

    k, keys = len(factors), list(keys)
    names = [f"xx_{i}_{j}" for i in range(k) for j in range(i, k)] + [f"xy_{i}" for i in range(k)]
    prods = [c(factors[i]) * c(factors[j]) for i in range(k) for j in range(i, k)] + [c(f) * c(y) for f in factors]
    sums = df.groupBy(*keys).agg(*[F.sum(p).alias(n) for p, n in zip(prods, names)])

    def solve_rows(x):
        out = []
        for row in x:
            xx, it = np.zeros((k, k)), iter(row)
            for i in range(k):
                for j in range(i, k):
                    xx[i, j] = xx[j, i] = next(it)
            out.append(np.linalg.lstsq(xx, np.array(list(it)), rcond=None)[0])
        return pd.Series(out)

    solve_rows.__annotations__ = {"x": pd.Series, "return": pd.Series}
    solve = F.pandas_udf(solve_rows, "array<double>")
    beta = solve(F.array(*[c(n) for n in names]))
    solved = sums.select(*keys, beta.alias("__b"))
    return solved.select(*keys, *[c("__b")[i].alias(f"beta_{f}") for i, f in enumerate(factors)])


def treatment_effect(df: DataFrame, treatment: str, outcome: str, features: Sequence[str], fold: Column) -> float | None:
    """A39 double-residual treatment effect: two folds, linear models fitted on the other fold."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    d = df.select(*[c(x).cast("double").alias(x) for x in (treatment, outcome, *features)], fold.alias("__fold")).dropna()
    d = VectorAssembler(inputCols=list(features), outputCol="__x").transform(d)
    num = den = 0.0
    for k in (0, 1):
        train, test = d.where(c("__fold") != k), d.where(c("__fold") == k)
        for target, out in ((treatment, "__th"), (outcome, "__yh")):
            m = LinearRegression(featuresCol="__x", labelCol=target, predictionCol=out, solver="normal").fit(train)
            test = m.transform(test)
        rt, ry = c(treatment) - c("__th"), c(outcome) - c("__yh")
        row = test.agg(F.sum(rt * ry).alias("n"), F.sum(rt * rt).alias("d")).first()
        num, den = num + (row["n"] or 0.0), den + (row["d"] or 0.0)
    return num / den if den else None


def quantile_coverage(df: DataFrame, realised: str, var: str, alpha: str = "alpha") -> DataFrame:
    """A40 share of realised values at or above the forecast quantile, by alpha."""
    d = df.where(c(realised).isNotNull() & c(var).isNotNull())
    return d.groupBy(alpha).agg(F.avg((c(realised) >= c(var)).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """A17 rank correlation per group; NULL where either side is constant."""
    d = df.where(c(a).isNotNull() & c(b).isNotNull()).select(*keys, a, b)
    d = average_ranks(d, keys, a, "__ra")
    d = average_ranks(d, keys, b, "__rb")
    flat = (F.stddev_pop("__ra") == 0) | (F.stddev_pop("__rb") == 0)
    out = d.groupBy(*keys).agg(F.when(~flat, F.corr("__ra", "__rb")).alias("ic"), F.count(F.lit(1)).alias("n"))
    return out


def feature_pnl_correlation(df: DataFrame, features: Sequence[str], pnl: str) -> DataFrame:
    """A18 Pearson and Spearman of each feature with the result."""
    long = df.select(c(pnl).cast("double").alias("__pnl"), *[c(f).cast("double").alias(f) for f in features])
    long = long.unpivot(["__pnl"], list(features), "feature", "v").where(c("v").isNotNull() & c("__pnl").isNotNull())
    p = long.groupBy("feature").agg(F.corr("v", "__pnl").alias("pearson"))
    return p.join(spearman(long, "v", "__pnl", ["feature"]).select("feature", c("ic").alias("spearman")), "feature")


def error_correlations(df: DataFrame, models: Sequence[str], y: str) -> DataFrame:
    """A19 correlation of the models' errors, one row per ordered pair: one aggregate."""
    err = lambda m: c(m) - c(y)
    pairs = [(a, b) for a in models for b in models if a != b]
    row = df.agg(*[F.corr(err(a), err(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def diversity_weights(corr: DataFrame, base: Mapping[str, float] | None = None) -> DataFrame:
    """A19 base weights times 1 - mean absolute error correlation, normalised."""
    d = corr.groupBy("a").agg(F.avg(F.abs("corr")).alias("__m"))
    w = F.lit(1.0)
    for name, value in (base or {}).items():
        w = F.when(c("a") == name, float(value)).otherwise(w)
    d = d.withColumn("__b", w).withColumn("__w", c("__b") * F.greatest(1 - c("__m"), F.lit(0.0)))
    everything = Window.partitionBy()  # one row per model
    tw, tb = F.sum("__w").over(everything), F.sum("__b").over(everything)
    weight = F.when(F.abs(tw) < 1e-8, c("__b") / tb).otherwise(c("__w") / nz(tw))
    return d.select(c("a").alias("model"), weight.alias("weight"))


def covariance_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A44 population covariance of every column pair from one pass of sums and cross-products."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)], *[F.avg(x).alias(f"m_{x}") for x in cols])
    parts = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(f"m_{a}").alias("mean_a"), c(f"c{i}").alias("cov"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
