"""Connected components over a table of edges, in rounds of grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgraph.operators.lineage import cut, forget


def components(edges: DataFrame, a: str = "left_id", b: str = "right_id") -> DataFrame:
    """(id, component) of every id with an edge to another; component is the smallest id reachable.

    Each round ties the larger neighbours of an id to the smallest of its neighbourhood, then the smaller
    ones and itself to the smallest of them, so the number of rounds grows with the logarithm of the longest path.
    Rounds are written to the session's shared folder. Null ends and loops have no effect.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)) & F.col("u").isNotNull() & F.col("v").isNotNull()).distinct()
    e = cut(e)
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        new = cut(near.where("u > v").distinct())
        # Done when all edges lead straight to the smallest id of a component, that is when no end is another's start.
        if new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            e = new
            break
        forget(e)
        e = new
    tops = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)
