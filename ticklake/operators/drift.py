"""Distribution drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import IDX, TICKS, Order, attach, row_index
from ..plans.values import cumulative_by_value, quantile_arrays

c = F.col


def to_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, v) rows of the numeric columns, NULLs left out."""
    wide = df.select(*[c(x).cast("double").alias(x) for x in cols])
    return wide.unpivot([], list(cols), "column", "v").where(c("v").isNotNull())


def psi(expected: DataFrame, actual: DataFrame, cols: Sequence[str], buckets: int = 10) -> DataFrame:
    """A26 population stability index per column.

    Bins run between the distinct quantiles of ``expected``, the last one
    closed on the right; values outside are left out, empty shares count 1e-6.
    """
    e, a = to_long(expected, cols), to_long(actual, cols)
    cuts = quantile_arrays(e, ["column"], "v", [i / buckets for i in range(buckets + 1)], "__cuts")
    cuts = cuts.withColumn("__cuts", F.array_distinct("__cuts"))
    both = e.withColumn("__e", F.lit(1)).unionByName(a.withColumn("__e", F.lit(0))).join(F.broadcast(cuts), "column")  # one row per requested column
    k = F.size("__cuts")
    at = F.size(F.filter("__cuts", lambda b: b <= c("v")))
    both = both.withColumn("__b", F.when((at == k) & (c("v") == F.element_at("__cuts", -1)), k - 1).otherwise(at))
    hits = {f"__{side}{i}": F.count_if((c("__b") == i) & (i < k) & (c("__e") == is_e)) for i in range(1, buckets + 1) for side, is_e in (("e", 1), ("a", 0))}
    bins = both.groupBy("column").agg(F.first(k).alias("__k"), *[x.alias(n) for n, x in hits.items()])
    total = {side: sum((c(f"__{side}{i}") for i in range(1, buckets + 1)), F.lit(0)) for side in "ea"}

    def share(side: str, i: int) -> Column:
        x = F.coalesce(c(f"__{side}{i}") / F.nullif(total[side], F.lit(0)), F.lit(0.0))
        return F.when(x == 0, 1e-6).otherwise(x)

    parts = [F.when(F.lit(i) < c("__k"), (share("e", i) - share("a", i)) * F.ln(share("e", i) / share("a", i))).otherwise(0.0) for i in range(1, buckets + 1)]
    score = F.when(c("__k") < 2, 0.0).when(total["a"] == 0, float("inf")).otherwise(sum(parts, F.lit(0.0)))
    return bins.select("column", score.alias("psi"))


def ks(first: DataFrame, second: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A27 two-sample Kolmogorov-Smirnov statistic and one-term p-value per column."""
    both = to_long(first, cols).withColumn("__f", F.lit(1)).unionByName(to_long(second, cols).withColumn("__f", F.lit(0)))
    cum = cumulative_by_value(both, ["column"], "v", {"n1": c("__f"), "n2": 1 - c("__f")})
    totals = both.groupBy("column").agg(F.sum("__f").alias("t1"), F.sum(1 - c("__f")).alias("t2"))
    gap = F.abs(c("cum_n1") / c("t1") - c("cum_n2") / c("t2"))
    out = cum.join(F.broadcast(totals), "column").groupBy("column").agg(F.max(gap).alias("ks"), F.first("t1").alias("t1"), F.first("t2").alias("t2"))
    en2 = c("t1") * c("t2") / (c("t1") + c("t2"))
    return out.select("column", "ks", (2 * F.exp(-2 * en2 * c("ks") * c("ks"))).alias("p_value"))


def drift_report(baseline: DataFrame, current: DataFrame, cols: Sequence[str], p=0.05, limit=0.2) -> DataFrame:
    """A28 both tests for all columns with their alerts."""
    out = ks(baseline, current, cols).join(psi(baseline, current, cols), "column", "full")
    return out.withColumn("ks_alert", c("p_value") < p).withColumn("psi_alert", c("psi") > limit)


def importance_drift(old: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A28 relative change of stored importances (feature, importance)."""
    d = old.select("feature", c("importance").alias("old")).join(new.select("feature", c("importance").alias("new")), "feature", "full")
    d = d.fillna(0.0, ["old", "new"])
    change = F.when(c("old") == 0, F.when(c("new") == 0, 0.0).otherwise(1.0)).otherwise(F.abs(c("new") - c("old")) / F.abs("old"))
    return d.withColumn("change", change).withColumn("drifted", c("change") > threshold)


def mean_shift(df: DataFrame, cols: Sequence[str], threshold: float = 1.0, order: Order = TICKS) -> DataFrame:
    """A29 change point at the middle of each series if its halves' means differ by more than ``threshold``."""
    keys = list(order.keys)
    long = df.select(*keys, order.ts, *order.tie, *cols).unpivot([*keys, order.ts, *order.tie], list(cols), "column", "v").where(c("v").isNotNull())
    o = order.with_keys(*keys, "column")
    d = row_index(long, o)
    n = d.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("__n"))
    half = F.floor(c("__n") / 2)
    out = attach(d, n, [*keys, "column"], [IDX]).groupBy(*keys, "column").agg(
        F.first(half).alias("middle"),
        F.avg(F.when(c(IDX) < half, c("v"))).alias("mean_before"),
        F.avg(F.when(c(IDX) >= half, c("v"))).alias("mean_after"),
    )
    return out.withColumn("change", F.coalesce(F.abs(c("mean_after") - c("mean_before")) > threshold, F.lit(False)))
