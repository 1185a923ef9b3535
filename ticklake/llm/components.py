"""Connected components of an edge table, on joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, keep


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is named by its smallest node.

    Alternates two contractions until the edges no longer change.  *Large star*: a
    node ties its larger neighbours to its smallest one.  *Small star*: a node
    ties itself and its smaller neighbours to the smallest one.  Each is one
    minimum per node (combined before the shuffle) and one join with it, so a
    node with very many neighbours is never gathered anywhere, and the number of
    rounds grows with the logarithm of the longest path.  Edges and minima are
    written between rounds; only two counters reach the driver.

    Edges with a null end and loops tie nothing and are left out; repeated edges
    count once; an empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    now = keep(now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = now.union(now.select("b", "a"))
        least = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tied = keep(large.distinct())
        down = keep(tied.groupBy("a").agg(F.min("b").alias("m")))
        small = tied.join(down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = keep(small.union(down).distinct())
        for x in (now, least, tied, down):
            drop_table(x)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
