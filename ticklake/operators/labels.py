"""Labels, splits and sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import IDX, TICKS, Order, attach, join_same, rolling, row_index
from .base import nz, safe_div

c = F.col


def split_first(df: DataFrame, n: int, order: Order = TICKS) -> DataFrame:
    """W37 ``is_train``: the first ``n`` rows of each key."""
    return row_index(df, order).withColumn("is_train", c(IDX) < n).drop(IDX)


def purged_folds(df: DataFrame, splits: int, embargo: int = 0, group: str | None = None, group_gap: int = 0, order: Order = TICKS) -> DataFrame:
    """W38 rows with ``fold`` and ``part``: growing train part, next block as validation.

    Rows within ``embargo`` before the validation block are left out, and so are
    training rows of a group that occurs in it or within ``group_gap`` rows of it.
    """
    keys = list(order.keys)
    d = row_index(df, order)
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    d = attach(d, sizes, keys, [IDX])
    block = F.floor(c("__n") / (splits + 1))
    # the validation block of fold k starts at n - (splits - k) * block
    arms = []
    for k in range(splits):
        start = c("__n") - (splits - k) * block
        part = F.when((c(IDX) >= start) & (c(IDX) < start + block), "val").when(c(IDX) < start - embargo, "train")
        near = (c(IDX) >= start - group_gap) & (c(IDX) < start + block + group_gap)
        arms.append(F.when(part.isNotNull() | near, F.struct(F.lit(k).alias("fold"), part.alias("part"), near.alias("near"))))
    d = d.withColumn("__f", F.explode(F.filter(F.array(*arms), lambda a: a.isNotNull())))
    d = d.select(*df.columns, c("__f.fold").alias("fold"), c("__f.part").alias("part"), c("__f.near").alias("__near"))
    if group is None:
        return d.where(c("part").isNotNull()).drop("__near")
    held = d.where(c("__near") & c(group).isNotNull()).select(*keys, "fold", group).distinct()
    train = join_same(d.where(c("part") == "train"), held, [*keys, "fold", group], "left_anti").select(d.columns)
    return train.unionByName(d.where(c("part") == "val")).drop("__near")


def sequences(df: DataFrame, features: Sequence[str], n: int, ret: str = "return", order: Order = TICKS) -> DataFrame:
    """W39 the last ``n`` feature rows as arrays (one per feature) with the direction label.

    The label of the window before row i is the sign of the return after row i;
    windows without one are left out.
    """

    def fn(d, w):
        f = w.rowsBetween(-n, -1)
        d = d.withColumns({f"{x}_seq": F.collect_list(x).over(f) for x in features})
        return d.withColumns({"label": (F.lead(ret).over(w) > 0).cast("int"), "__nx": F.lead(F.lit(1)).over(w)})

    d = rolling(df, fn, n, 1, order, keep_index=True)
    return d.where((c(IDX) >= n) & c("__nx").isNotNull()).drop(IDX, "__nx")


def triple_barrier(col: str = "mid", pt: float = 0.01, sl: float = 0.01, h: int = 10, order: Order = TICKS):
    """W40 +1 if the upper barrier is touched first within ``h`` rows, -1 for the lower, 0 otherwise."""

    def fn(d, w):
        d = d.withColumn("__fut", F.collect_list(col).over(w.rowsBetween(1, h)))
        up, low = c(col) * (1 + pt), c(col) * (1 - sl)
        first = lambda hit: F.array_position(F.transform("__fut", hit), True)
        u, l = first(lambda x: x >= up), first(lambda x: x <= low)
        u, l = F.when(u == 0, h + 1).otherwise(u), F.when(l == 0, h + 1).otherwise(l)
        return d.withColumn("label", F.when(u < l, 1).when(l < u, -1).otherwise(0)).drop("__fut")

    return lambda df: rolling(df, fn, 0, h, order)


def multi_horizon(horizons: Sequence[int], col: str = "mid", order: Order = TICKS):
    """W41 direction, absolute return and realised volatility ahead; 0 in the tail."""
    hs = list(dict.fromkeys(int(h) for h in horizons if int(h) > 0))

    def fn(d, w):
        step = safe_div(F.lead(col).over(w), c(col)) - 1
        d = d.withColumn("__sq", F.coalesce(F.pow(step, 2), F.lit(0.0))).withColumn("__has", F.lead(F.lit(1)).over(w))
        new: dict[str, Column] = {}
        for h in hs:
            ahead = F.lead(F.lit(1), h).over(w).isNotNull()
            rel = F.coalesce(safe_div(F.lead(col, h).over(w), c(col)) - 1, F.lit(0.0))
            f = w.rowsBetween(0, h - 1)
            new[f"direction_{h}"] = F.when(ahead & (rel > 0), 1).otherwise(0).cast("byte")
            new[f"abs_return_{h}"] = F.when(ahead, F.abs(rel)).otherwise(0.0).cast("float")
            new[f"volatility_{h}"] = F.when(ahead, F.sqrt(F.sum("__sq").over(f))).otherwise(0.0).cast("float")
        return d.withColumns(new).drop("__sq", "__has")

    return lambda df: rolling(df, fn, 0, max(hs), order)


def entropy(probs: Sequence[Column]) -> Column:
    """X24 entropy of a probability vector, clipped away from 0 and 1."""
    clip = [F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12)) for p in probs]
    return -sum((p * F.ln(p) for p in clip[1:]), clip[0] * F.ln(clip[0]))


def most_uncertain(df: DataFrame, k: int, prob: str = "prob", row_id: str = "id", queued: DataFrame | None = None) -> DataFrame:
    """F21/K04 the ``k`` rows of largest entropy that are not queued yet."""
    d = df.withColumn("uncertainty", entropy([1 - c(prob), c(prob)]))
    top = d.orderBy(F.round("uncertainty", 12).desc(), row_id).limit(k)
    return top.join(queued, row_id, "left_anti") if queued is not None else top


def low_confidence(df: DataFrame, threshold: float = 0.6, prob: str = "prob", row_id: str = "id", queued: DataFrame | None = None) -> DataFrame:
    """F21 rows whose best class is below ``threshold``."""
    d = df.withColumn("confidence", F.greatest(c(prob), 1 - c(prob))).where(c("confidence") < threshold)
    return d.join(queued, row_id, "left_anti") if queued is not None else d


def pseudo_labels(df: DataFrame, threshold: float = 0.9, prob: str = "prob") -> DataFrame:
    """F21 rows confident enough to be labelled by the model."""
    conf = F.greatest(c(prob), 1 - c(prob))
    return df.where(conf >= threshold).withColumn("pseudo_label", (c(prob) > 0.5).cast("int"))


def label_quality(df: DataFrame, y: str = "y", pred: str = "pseudo_label") -> DataFrame:
    """F21 precision and recall of given labels."""
    tp, fp = F.count_if((c(y) == 1) & (c(pred) == 1)), F.count_if((c(y) == 0) & (c(pred) == 1))
    fn = F.count_if((c(y) == 1) & (c(pred) == 0))
    return df.agg(
        F.coalesce(safe_div(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(safe_div(tp, tp + fn), F.lit(0.0)).alias("recall")
    )


def merge_labels(df: DataFrame, labeled: DataFrame, label: str, order_by: str, row_id: str = "id") -> DataFrame:
    """J17 replace labels by id; the first label given for an id wins."""
    first = labeled.groupBy(row_id).agg(F.min_by("label", order_by).alias("__l"))
    return df.join(first, row_id, "left").withColumn(label, F.coalesce(c("__l"), c(label))).drop("__l")
