"""Order by value: exact quantiles, ranks and cumulative counts without one task per group.

Equal values are counted first, so a value held by many rows is one row from
then on.  Values are spread over buckets at approximate quantiles of their
group, and running counts over buckets are combined as in ``ordered.running``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Order, attach, join_same, running

VB = "__vb"


def value_order(df: DataFrame, keys: Sequence[str], col: str, grid: int = 64) -> tuple[DataFrame, Order]:
    """``df`` with a value bucket per row, and the order to give to ``running``."""
    probs = F.array(*[F.lit(i / grid) for i in range(1, grid)])
    splits = df.groupBy(*keys).agg(F.percentile_approx(col, probs, F.lit(10 * grid)).alias("__cuts"))
    joined = attach(df, splits, list(keys))
    cuts = F.col("__cuts")
    rows = joined.withColumn(VB, F.size(F.filter(cuts, lambda x: x < F.col(col))).cast("long")).drop("__cuts")
    return rows, Order(tuple(keys), ts=col, tie=(), bucket_by=F.col(VB))


def cumulative_by_value(
    df: DataFrame, keys: Sequence[str], col: str, sums: Mapping[str, Column], reverse: bool = False
) -> DataFrame:
    """One row per (key, value) with the sums at it and ``cum_*`` up to and including it."""
    per_value = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    rows, order = value_order(per_value, keys, col)
    outs = {f"cum_{n}": ("sum", F.col(n)) for n in sums}
    return running(rows, outs, order, reverse=reverse).drop(VB)


def average_ranks(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """1-based rank of ``col`` within the group, ties sharing their mean rank; NULL stays NULL."""
    cum = cumulative_by_value(df, keys, col, {"__n": F.lit(1)})
    ranks = cum.select(*keys, col, (F.col("cum___n") - (F.col("__n") - 1) / 2).alias(out))
    return df.join(ranks, [*keys, col], "left")


DIGIT = 1 << 16  # steps into which a power of two is cut
_TOP = (1 << 62) - 1


def digits(v: Column, steps: int = DIGIT) -> Column:
    """Sign, exponent and leading digits of a double as one integer that rises with it.

    Values under 2**-1000 share 0; infinities and NaN (the greatest) have their own.
    """
    a = F.abs(v)
    e = F.least(F.floor(F.log2(a)), F.lit(1023))
    at = (e + 1001) * steps + F.floor((a / F.pow(F.lit(2.0), e) - 1) * steps)
    size = F.when(a == float("inf"), F.lit(_TOP - 1)).when(a < 2.0**-1000, F.lit(0)).otherwise(at)
    return F.when(F.isnan(v), F.lit(_TOP)).when(v < 0, -size).otherwise(size).cast("long")


def quantile_arrays(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], out: str, accuracy: int = DIGIT) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key, ``out`` in the order of ``probs``.

    Radix selection in two passes over (key, value).  The first counts rows by
    the leading digits of their value, which tells the bucket and the rank in it
    of every quantile; the second only keeps the buckets that are hit, counts
    equal values and orders them.  What is ordered at once are the counts of a key's
    buckets, and the distinct values of one bucket; ``accuracy`` is the number of
    buckets to a power of two.  NULL values do not count; a NULL key is a key.
    """
    keys = list(keys)
    data = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("__v")).withColumn("__d", digits(F.col("__v"), accuracy))
    counts = data.groupBy(*keys, "__d").agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*keys).orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
    spot = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    counts = counts.withColumns({"__upto": F.sum("__c").over(upto), "__n": F.sum("__c").over(Window.partitionBy(*keys))})
    ranks = F.array(*[f(x) for x in spot for f in (F.floor, F.ceil)])
    hit = F.exists(ranks, lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__c")))
    hits = counts.where(hit).select(*keys, "__d", "__n", (F.col("__upto") - F.col("__c")).alias("__before"))
    same = join_same(data, hits, [*keys, "__d"]).groupBy(*keys, "__d", "__v", "__n", "__before").agg(F.count(F.lit(1)).alias("__c"))
    inside = Window.partitionBy(*keys, "__d").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = same.withColumn("__end", F.col("__before") + F.sum("__c").over(inside))

    def at(rank: Column) -> Column:  # the value whose run of ranks holds ``rank``
        return F.max(F.when((F.col("__end") > rank) & (F.col("__end") - F.col("__c") <= rank), F.col("__v")))

    pairs = F.array(*[F.struct(at(F.floor(x)).alias("a"), at(F.ceil(x)).alias("b")) for x in spot])
    got = placed.groupBy(*keys).agg(F.first("__n").alias("__n"), pairs.alias("__q"))
    values = [F.col("__q")[i]["a"] + (F.col("__q")[i]["b"] - F.col("__q")[i]["a"]) * (x - F.floor(x)) for i, x in enumerate(spot)]
    return got.select(*keys, F.array(*values).alias(out))


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], accuracy: int = DIGIT) -> DataFrame:
    """:func:`quantile_arrays` as one row per (key, ``prob``) with ``value``."""
    q = quantile_arrays(df, keys, col, probs, "__q", accuracy)
    both = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("__q").alias("value"))
    return q.select(*keys, F.inline(both).alias("prob", "value"))
