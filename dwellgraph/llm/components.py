"""Connected components as a distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgraph.llm.common import broadcaster, materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id has one smaller neighbour at most, and none if it has larger ones."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every id with an edge to another id; component_id is the smallest id reachable.

    Alternates the large-star and small-star steps until each id is linked to the smallest of its
    component and to nothing else. Every step is a grouped minimum (combined before the
    shuffle) and an equi-join with it: broadcast if the edges are counted few (steps never add edges, so
    the count holds for all rounds), else a sort-merge join that adaptive execution splits if one id has
    most of the links. Each round is written to the shared folder. Null ends, loops and repeated edges
    have no effect; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "cc")
    # A table of ends has two rows for an edge at most.
    small = broadcaster(2 * e.count())
    while not _are_stars(e):
        # Large star: each neighbour above u is tied to the smallest neighbour of u (or u itself).
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # An edge (w > u) needs the minimum of its smaller end only: w is the neighbour above u.
        tied = e.select(F.col("u").alias("w"), F.col("v").alias("u")).join(small(least), "u")
        large = materialize(tied.select(F.col("w").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "cc")
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(small(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(near.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "cc")
    leaves = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return leaves.union(roots)


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The (id, component_id) of written labels after more edges (a, b), without another look at the older edges.

    Each end stands for its component so far, and the components of these ends are found alone.
    """
    known = labels
    small = broadcaster(known.count())
    of_a = small(known.select(F.col("id").alias("a"), F.col("component_id").alias("ra")))
    of_b = small(known.select(F.col("id").alias("b"), F.col("component_id").alias("rb")))
    ends = edges.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = materialize(connected_components(ends), "joined")
    few = broadcaster(joined.count())
    renamed = known.join(few(joined.select(F.col("id").alias("component_id"), F.col("component_id").alias("to"))), "component_id", "left")
    added = joined.join(small(known.select("id")), "id", "left_anti")
    return renamed.select("id", F.coalesce("to", "component_id").alias("component_id")).union(added.select("id", "component_id"))
