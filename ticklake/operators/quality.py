"""Cleaning, validation and gates."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import IDX, TICKS, Order, attach, micros, rolling, running
from ..plans.values import exact_quantiles
from ..plans.steps import settled_scan
from .base import nz, safe_div

c = F.col


def tick_flags(df: DataFrame, jump: float = 0.01, max_spread: float = 0.05, order: Order = TICKS) -> DataFrame:
    """F01 the three reasons a tick can be dropped for, as columns."""

    def fn(d, w):
        mid = (c("Ask") + c("Bid")) / 2
        d = d.withColumns({"__mid": mid, "__sp": c("Ask") - c("Bid")})
        first = c(IDX) == 0
        change = F.abs(safe_div(c("__mid"), F.lag("__mid").over(w)) - 1)
        ok_time = first | (micros(order.ts) > micros(F.lag(order.ts).over(w)))
        return d.withColumns(
            {
                "bad_time": ~F.coalesce(ok_time, F.lit(False)),
                "bad_spread": ~F.coalesce((c("__sp") >= 0) & (c("__sp") <= max_spread), F.lit(False)),
                "bad_jump": ~F.coalesce(first | (change <= jump), F.lit(False)),
            }
        ).drop("__mid", "__sp")

    return rolling(df, fn, 1, 0, order)


def sanitize_ticks(df: DataFrame, jump: float = 0.01, max_spread: float = 0.05, order: Order = TICKS) -> DataFrame:
    """F01 ticks with rising time, sane spread and no jump."""
    d = tick_flags(df, jump, max_spread, order)
    return d.where(~(c("bad_time") | c("bad_spread") | c("bad_jump"))).drop("bad_time", "bad_spread", "bad_jump")


def removal_counts(flagged: DataFrame, keys: Sequence[str] = ("Symbol",)) -> DataFrame:
    """F01 removals by reason."""
    return flagged.groupBy(*keys).agg(
        *[F.count_if(b).alias(f"n_{b}") for b in ("bad_time", "bad_spread", "bad_jump")],
        F.count_if(~(c("bad_time") | c("bad_spread") | c("bad_jump"))).alias("n_kept"),
    )


def zscore_filter(df: DataFrame, cols: Sequence[str], threshold: float = 3.0, keys: Sequence[str] = ("Symbol",)) -> DataFrame:
    """F02 values further than ``threshold`` population deviations become NULL."""
    aggs = [f(x).alias(f"__{n}_{x}") for x in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    d = attach(df, df.groupBy(*keys).agg(*aggs), list(keys), cols)
    for x in cols:
        z = F.abs(safe_div(c(x) - c(f"__m_{x}"), c(f"__s_{x}")))
        d = d.withColumn(x, F.when(~F.coalesce(z > threshold, F.lit(False)), c(x)))
    return d.select(df.columns)


def median_filter(df: DataFrame, cols: Sequence[str], n: int = 5, threshold: float = 5.0, order: Order = TICKS) -> DataFrame:
    """F03 values far from the centred rolling median, in median absolute deviations, become NULL."""
    h = n // 2

    def fn(d, w):
        f = w.rowsBetween(-h, h)
        d = d.withColumns({f"__md_{x}": F.percentile(c(x), 0.5).over(f) for x in cols})
        d = d.withColumns({f"__df_{x}": F.abs(c(x) - c(f"__md_{x}")) for x in cols})
        d = d.withColumns({f"__mad_{x}": F.percentile(c(f"__df_{x}"), 0.5).over(f) for x in cols})
        for x in cols:
            out = F.coalesce(c(f"__df_{x}") > threshold * nz(c(f"__mad_{x}")), F.lit(False))
            d = d.withColumn(x, F.when(~out, c(x)))
        return d

    return rolling(df, fn, 2 * h, 2 * h, order).select(df.columns)


def _tick_filter(threshold: float):
    """Block run and merge of the sequential filter.

    State and summary: n, sum and sum of squares of spreads, the same of jumps,
    last accepted mid and time (NaN before the first).
    """
    nan = float("nan")

    def far(x, n, s, q):
        if n <= 10:
            return False
        mean = s / n
        var = (q - n * mean * mean) / (n - 1)
        # a variance at the size of rounding noise counts as zero
        return var > 1e-12 * q / n and abs(x - mean) > threshold * math.sqrt(var)

    def run(entry, rows):
        n, s1, s2, j1, j2, last_mid, last_ts = entry
        own = [0.0] * 5
        out = []
        for spread, mid, ts, crossed in rows:
            first = math.isnan(last_mid)
            jump = 0.0 if first else mid - last_mid
            bad = crossed or (not math.isnan(last_ts) and ts <= last_ts) or far(spread, n, s1, s2)
            bad = bad or (not first and far(jump, n, j1, j2))
            out.append((not bad,))
            if bad:
                continue
            last_mid, last_ts = mid, ts
            for i, v in enumerate((1.0, spread, spread * spread, jump, jump * jump)):
                own[i] += v
            n, s1, s2, j1, j2 = (e + o for e, o in zip(entry[:5], own))
        return out, [*own, last_mid, last_ts]

    def merge(entry, summary):
        return [*(e + s for e, s in zip(entry[:5], summary[:5])), summary[5], summary[6]]

    return [0.0] * 5 + [nan, nan], run, merge


def online_filter(df: DataFrame, threshold: float = 3.0, order: Order = TICKS) -> DataFrame:
    """F04 sequential tick filter: add ``accepted``.

    A tick is judged against the running mean and deviation of the spread and
    of the jump of the ticks accepted before it; rejected ticks leave the
    statistics alone.
    """
    keys = list(order.keys)
    sp, mid = c("Ask") - c("Bid"), (c("Ask") + c("Bid")) / 2
    # spreads are taken about their mean, so that squares keep their digits
    centre = df.groupBy(*keys).agg(F.avg(sp).alias("__c"), F.min(micros(order.ts)).alias("__t0"))
    d = attach(df, centre, keys, [order.ts, *order.tie]).withColumns(
        {
            "__s": sp - c("__c"),
            "__mid": mid,
            "__us": (micros(order.ts) - c("__t0")).cast("double"),
            "__x": c("Ask") <= c("Bid"),
        }
    ).drop("__c", "__t0")
    start, run, merge = _tick_filter(threshold)
    outs = T.StructType([T.StructField("accepted", T.BooleanType())])
    return settled_scan(d, ["__s", "__mid", "__us", "__x"], outs, start, run, merge, order).drop("__s", "__mid", "__us", "__x")


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of whole columns: one row fetched."""
    row = df.agg(*[f(x).alias(f"{n}_{x}") for x in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {x: (row[f"m_{x}"], row[f"s_{x}"]) for x in cols}


def anomaly_mask(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> Column:
    """F05 true where any column, NULL read as 0, is beyond ``threshold`` deviations."""
    filled = df.select(*[F.coalesce(c(x), F.lit(0)).alias(x) for x in cols])
    stats = moments(filled, cols)
    mask = F.lit(False)
    for x, (m, s) in stats.items():
        if s:
            mask = mask | (F.abs((F.coalesce(c(x), F.lit(0)) - m) / s) > threshold)
    return mask


def split_anomalies(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """F05 (clean rows, anomalous rows)."""
    mask = anomaly_mask(df, cols, threshold)
    return df.where(~mask), df.where(mask)


def robust_preprocess(df: DataFrame, cols: Sequence[str], n: int = 5, trim: float = 0.1, z: float = 3.0, order: Order = TICKS) -> DataFrame:
    """F06 rolling median, then trimmed mean, then clamp at ``z`` deviations of the key."""
    h, keys = n // 2, list(order.keys)

    def fn(d, w):
        f = w.rowsBetween(-h, h)
        d = d.withColumns({x: F.percentile(c(x), 0.5).over(f) for x in cols})
        for x in cols:
            vals = F.array_sort(F.collect_list(x).over(f))
            d = d.withColumn("__v", vals).withColumn("__k", F.floor(F.size("__v") * F.lit(trim)).cast("int"))
            kept = F.expr("slice(__v, __k + 1, greatest(size(__v) - 2 * __k, 1))")
            total = F.aggregate(kept, F.lit(0.0), lambda a, b: a + b)
            d = d.withColumn(x, total / F.size(kept)).drop("__v", "__k")
        return d

    d = rolling(df, fn, 2 * h, 2 * h, order)
    aggs = [f(x).alias(f"__{m}_{x}") for x in cols for m, f in (("m", F.avg), ("s", F.stddev_pop))]
    d = attach(d, d.groupBy(*keys).agg(*aggs), keys, [order.ts, *order.tie])
    for x in cols:
        m, s = c(f"__m_{x}"), c(f"__s_{x}")
        d = d.withColumn(x, F.when(s > 0, F.greatest(F.least(c(x), m + z * s), m - z * s)).otherwise(c(x)))
    return d.select(df.columns)


def recency(df: DataFrame, now: Column, max_age_seconds: float, ts: str = "Timestamp", keys: Sequence[str] = ("Symbol",)) -> DataFrame:
    """F07 newest time per key, its age and whether it is recent enough."""
    d = df.groupBy(*keys).agg(F.max(ts).alias("latest"))
    age = (micros(now) - micros("latest")) / 1e6
    return d.withColumn("age_seconds", age).withColumn("fresh", c("age_seconds") <= max_age_seconds)


def quality_weight(df: DataFrame, cols: Sequence[str], out: str = "quality") -> DataFrame:
    """F08 1 / (1 + mean absolute z-score) over the non-NULL columns of a row."""
    stats = moments(df, cols)
    zs = [F.abs((c(x) - m) / (s or 1.0)) for x, (m, s) in stats.items()]
    total = sum((F.coalesce(z, F.lit(0.0)) for z in zs), F.lit(0.0))
    known = sum((F.when(z.isNotNull(), 1).otherwise(0) for z in zs), F.lit(0))
    return df.withColumn(out, F.coalesce(1 / (1 + safe_div(total, known)), F.lit(0.0)))


def coerce(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """F09 cast to ``schema``; second result: values per column that could not be cast or must not be NULL."""
    have = [f for f in schema.fields if f.name in df.columns]
    cast = df.select(*[c(f.name).try_cast(f.dataType).alias(f.name) for f in have], *[x for x in df.columns if x not in schema.names])
    both = df.select(*[c(f.name).alias(f"__raw_{f.name}") for f in have], *[c(f.name).try_cast(f.dataType).alias(f.name) for f in have])
    counts = both.agg(
        *[F.count_if(c(f"__raw_{f.name}").isNotNull() & c(f.name).isNull()).alias(f"c_{f.name}") for f in have],
        *[F.count_if(c(f.name).isNull()).alias(f"n_{f.name}") for f in have],
    )
    parts = [
        F.struct(
            F.lit(f.name).alias("column"),
            c(f"c_{f.name}").alias("uncastable"),
            (F.lit(0).cast("long") if f.nullable else c(f"n_{f.name}")).alias("nulls"),
        )
        for f in have
    ]
    return cast, counts.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def _suite(suite: Mapping | str) -> list[tuple[str, Mapping]]:
    suite = json.loads(suite) if isinstance(suite, str) else suite
    return [(e["expectation_type"], e["kwargs"]) for e in suite["expectations"]]


def row_expectations(df: DataFrame, suite: Mapping | str) -> dict[str, Column]:
    """F10 per expectation on single rows, whether a row breaks it; named by its place in the suite."""
    out = {}
    for i, (kind, kw) in enumerate(_suite(suite)):
        if kind == "expect_column_values_to_not_be_null" and kw["column"] in df.columns:
            out[f"__u{i}"] = c(kw["column"]).isNull()
    return out


def expectation_counts(df: DataFrame, suite: Mapping | str) -> list[Column]:
    """F10 the aggregates that :func:`expectation_report` needs."""
    return [F.count(F.lit(1)).alias("__rows"), *[F.count_if(bad).alias(n) for n, bad in row_expectations(df, suite).items()]]


def expectation_report(counts: DataFrame, columns: Sequence[str], suite: Mapping | str) -> DataFrame:
    """F10 one row per expectation with its unexpected count and outcome, from a row of counts."""
    out = []
    for i, (kind, kw) in enumerate(_suite(suite)):
        bad: Column = F.lit(0)
        if kind == "expect_column_values_to_not_be_null":
            bad = c(f"__u{i}") if kw["column"] in columns else c("__rows")
        elif kind == "expect_column_to_exist":
            bad = F.lit(int(kw["column"] not in columns))
        elif kind == "expect_table_columns_to_match_set":
            missing = set(kw["column_set"]) - set(columns)
            extra = set(columns) - set(kw["column_set"]) if kw.get("exact_match", True) else set()
            bad = F.lit(len(missing) + len(extra))
        elif kind == "expect_table_column_count_to_be_between":
            n = len(columns)
            bad = F.lit(int(not (kw.get("min_value") or 0) <= n <= (kw.get("max_value") or n)))
        elif kind == "expect_table_row_count_to_be_between":
            low, high = kw.get("min_value"), kw.get("max_value")
            good = F.lit(True)
            if low is not None:
                good = good & (c("__rows") >= low)
            if high is not None:
                good = good & (c("__rows") <= high)
            bad = F.when(good, 0).otherwise(1)
        else:
            raise ValueError(f"unknown expectation {kind}")
        fields = (F.lit(kind).alias("expectation"), F.lit(kw.get("column", "")).alias("column"), bad.cast("long").alias("unexpected"), (bad == 0).alias("success"))
        out.append(F.struct(*fields))
    return counts.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def expectations(df: DataFrame, suite: Mapping | str) -> DataFrame:
    """F10 one row per expectation with its unexpected count and outcome; one aggregate in all."""
    return expectation_report(df.agg(*expectation_counts(df, suite)), df.columns, suite)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """F11 NULLs per column; ``assert_no_null`` raises on any."""
    cols = list(cols or df.columns)
    parts = [F.struct(F.lit(x).alias("column"), c(f"n_{x}").alias("nulls")) for x in cols]
    counts = df.agg(*[F.count_if(c(x).isNull()).alias(f"n_{x}") for x in cols])
    return counts.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def assert_no_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    bad = null_counts(df, cols).where("nulls > 0").collect()  # one row per column at most
    if bad:
        raise ValueError("NULL values in: " + ", ".join(r["column"] for r in bad))
    return df


class Sanitizer:
    """F14 numeric coercion, infinities to NULL, fill values learnt at ``fit``."""

    def __init__(self, method: str = "median", value: float = 0.0):
        if method not in ("median", "mean", "zero", "constant"):
            raise ValueError(f"unknown fill method {method!r}")
        self.method, self.value, self.fill = method, value, {}

    @staticmethod
    def _numeric(x: str) -> Column:
        v = c(x).try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    def fit(self, df: DataFrame, cols: Sequence[str]) -> Sanitizer:
        d = df.select(*[self._numeric(x).alias(x) for x in cols])
        if self.method == "zero":
            self.fill = {x: 0.0 for x in cols}
        elif self.method == "constant":
            self.fill = {x: float(self.value) for x in cols}
        elif self.method == "mean":
            row = d.agg(*[F.avg(x).alias(x) for x in cols]).first()
            self.fill = {x: row[x] if row[x] is not None else self.value for x in cols}
        else:
            long = d.unpivot([], list(cols), "column", "v")
            got = {r["column"]: r["value"] for r in exact_quantiles(long, ["column"], "v", [0.5]).collect()}
            self.fill = {x: got.get(x, self.value) for x in cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for x, v in self.fill.items():
            have = self._numeric(x) if x in df.columns else F.lit(None).cast("double")
            new[x] = F.coalesce(have, F.lit(float(v)))
        return df.withColumns(new)


def downcast(df: DataFrame) -> DataFrame:
    """F20 doubles to floats and longs to ints, for sinks."""
    to = {"double": "float", "bigint": "int"}
    return df.select(*[c(n).cast(to[t]).alias(n) if t in to else c(n) for n, t in df.dtypes])


def family(name: str, families: Sequence[tuple[str, str, str]]) -> str:
    """F13 first family whose rule fits a column name; rules are (family, kind, text)."""
    for fam, kind, text in families:
        if (kind == "prefix" and name.startswith(text)) or (kind == "exact" and name == text) or (kind == "contains" and text in name):
            return fam
    return "other"


def select_families(df: DataFrame, keep: Sequence[str], families, always: Sequence[str] = ()) -> DataFrame:
    """F12/F13 columns of the kept families plus the ``always`` ones."""
    return df.select(*[x for x in df.columns if x in always or family(x, families) in keep])


# ---------------------------------------------------------------- gaps and fills


def gaps(max_gap_seconds: float = 1.0, order: Order = TICKS):
    """W44 rows further than ``max_gap_seconds`` after the row before."""

    def fn(d, w):
        step = micros(order.ts) - micros(F.lag(order.ts).over(w))
        return d.withColumn("gap", F.coalesce(step > int(max_gap_seconds * 1_000_000), F.lit(False)))

    return lambda df: rolling(df, fn, 1, 0, order)


def fill_within(df: DataFrame, cols: Sequence[str], order: Order = TICKS, back: bool = True) -> DataFrame:
    """W46 forward fill inside the key, then backward fill."""
    d = running(df, {f"__f_{x}": ("last", c(x)) for x in cols}, order)
    if back:
        d = running(d, {f"__b_{x}": ("last", c(x)) for x in cols}, order, reverse=True)
        filled = {x: F.coalesce(c(f"__f_{x}"), c(f"__b_{x}")) for x in cols}
    else:
        filled = {x: c(f"__f_{x}") for x in cols}
    return d.withColumns(filled).select(df.columns)


def interpolate_grid(df: DataFrame, cols: Sequence[str], step_seconds: int = 1, order: Order = TICKS) -> DataFrame:
    """W45 regular grid from the first to the last time of a key with linear values in between.

    Rows off the grid are dropped, values before the first known one are filled
    from it, and weights go by grid position.
    """
    keys, ts, step = list(order.keys), order.ts, int(step_seconds) * 1_000_000
    us = micros(ts)
    span = df.groupBy(*keys).agg(F.min(us).alias("__t0"), F.max(us).alias("__t1"))
    # the grid is expanded in two hops, so no single row explodes into a whole series
    per, last = 10_000, F.floor((c("__t1") - c("__t0")) / step)
    chunks = span.select(*keys, "__t0", last.alias("__last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / per))).alias("__ch"))
    chunks = chunks.repartition(*keys, "__ch")
    grid = chunks.select(
        *keys,
        "__t0",
        F.explode(F.sequence(c("__ch") * per, F.least(c("__last"), c("__ch") * per + per - 1))).alias("__g"),
    )
    grid = grid.withColumn("__us", c("__t0") + c("__g") * step)
    known = df.select(*keys, us.alias("__us"), *cols)
    g = grid.join(known, [*keys, "__us"], "left")
    g = g.withColumn(ts, F.timestamp_micros("__us").cast("timestamp_ntz"))
    o = Order(tuple(keys), ts, ("__g",), order.bucket_seconds)
    at = {x: F.when(c(x).isNotNull(), F.struct(c("__g").alias("g"), c(x).alias("v"))) for x in cols}
    g = running(g, {f"__p_{x}": ("last", at[x]) for x in cols}, o)
    g = running(g, {f"__q_{x}": ("last", at[x]) for x in cols}, o, reverse=True)
    new = {}
    for x in cols:
        p, q = c(f"__p_{x}"), c(f"__q_{x}")
        share = (c("__g") - p["g"]) / nz(q["g"] - p["g"])
        line = p["v"] + (q["v"] - p["v"]) * share
        new[x] = F.coalesce(c(x), line, p["v"], q["v"])
    return g.withColumns(new).select(*keys, ts, *cols)


# ---------------------------------------------------------------- gates


def signal_gate(prob: Column, conditions: Sequence[Column]) -> Column:
    """F15 the probability where every condition holds, else 0 (NULL counts as not holding)."""
    ok = F.lit(True)
    for cond in conditions:
        ok = ok & F.coalesce(cond, F.lit(False))
    return F.when(ok, prob).otherwise(0.0)


def regime_threshold(df: DataFrame, thresholds: Mapping[int | str, float], default: float = 0.5, prob="prob", regime="market_regime") -> DataFrame:
    """F16 class by the probability threshold of the row's regime."""
    thr = F.lit(float(default))
    for key, value in thresholds.items():
        thr = F.when(c(regime) == F.lit(key), float(value)).otherwise(thr)
    return df.withColumn("pred", (c(prob) >= thr).cast("int"))


def spread_ok(max_spread: float) -> Column:
    """F17 spread within the limit."""
    return (c("Ask") - c("Bid")) <= max_spread


def slippage_ok(max_slippage: float, requested: str = "requested", filled: str = "filled") -> Column:
    """F17 relative slippage within the limit."""
    return F.abs(c(filled) - c(requested)) / nz(F.abs(c(requested))) <= max_slippage
