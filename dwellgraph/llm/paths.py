"""Linking by recursively branched buckets: the candidate search of the similarity joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgraph.llm.common import broadcaster, discard, materialize, release
from dwellgraph.llm.components import connected_components, merged

#: Buckets of so many members at most are compared exhaustively.
LIMIT = 24
#: Buckets with more members outside their largest component are compared with one more pivot first.
FEW = 4
#: So many pairs of a member outside the largest component and any other at most are compared without branching.
WORK = 4_000_000
#: Levels of branching; what is still open after the last is compared whatever its size.
DEPTH = 2
#: Members of a block; the pairs of two blocks meet in one task.
BLOCK = 1024


def shared_buckets(*parts: DataFrame) -> DataFrame:
    """(node, id, cnt) of the buckets that hold two ids at least; parts of the rows share no bucket and are taken one by one.

    The rows of a bucket are counted as they stream by in the order of a sort, so they go through one
    shuffle and a bucket of any size takes no more memory than another.
    """
    out = []
    for rows in parts:
        counted = rows.withColumn("cnt", F.count("*").over(Window.partitionBy("node")))
        out.append(materialize(counted.where("cnt > 1"), "nodes"))
        del counted
        release(rows.sparkSession)
    return reduce(DataFrame.union, out)


def popular(rows: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, pivot): of each bucket the member that meets most others over all buckets, from (node, id, cnt).

    The middle of a group of near copies shares its buckets with most of them, so that one comparison
    with it ties most of the group.
    """
    met = rows.groupBy("id").agg(F.sum("cnt").alias("met"))
    best = rows.join(small(met), "id").groupBy("node").agg(F.max(F.struct("met", "id")).alias("best"))
    return best.select("node", F.col("best.id").alias("pivot"))


#: sketches(ids) gives (id, s0, s1, ...); may(x, y), of the prefixes of two sketches' columns, is false for pairs to pass over.
Sift = tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]]


def link(parts: list[DataFrame], branch: Callable[[DataFrame, int], DataFrame], verify: Callable[[DataFrame], DataFrame], sift: Sift | None = None, *, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """(id, component_id) of all ids with a confirmed link, from (node, id) rows of non-null values,
    in parts that share no node.

    verify keeps the pairs (a, b) that are links, by an exact test. Small buckets are compared
    exhaustively. In a large one every member is compared with a pivot, which is linear; members tied
    together by then need no comparison among themselves. Where members are left outside the bucket's
    largest component, all are compared with one more pivot from among them; then every pair of members
    of different components is compared, in blocks. Only buckets with more than WORK such pairs are
    branched instead: branch(rows, level) gives (node, id) rows of finer buckets, which must hold the
    links of their bucket together. After depth levels all that are open are compared, whatever their size.
    Of the pairs across components those that sift rules out are not verified; without it all are.
    """
    nodes = shared_buckets(*parts)
    near_nodes = nodes.where(F.col("cnt") <= limit)
    near = near_nodes.select("node", F.col("id").alias("a")).join(near_nodes.select("node", F.col("id").alias("b")), "node").where("a < b").select("a", "b")
    wide = materialize(nodes.where(F.col("cnt") > limit), "wide")
    small = broadcaster(wide.count())
    star = wide.join(small(popular(wide, small)), "node").where("id <> pivot")
    tested = materialize(near.union(_ordered(star, "pivot", "id")).distinct(), "pairs")
    discard(nodes)
    if tested.isEmpty():
        return tested.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    labels = materialize(connected_components(verify(tested)), "labels")

    def test(pairs: DataFrame) -> None:
        nonlocal tested, labels
        pairs = materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tested = tested.union(pairs)
            labels = materialize(merged(labels, verify(pairs)), "labels")

    wide = wide.select("node", "id")
    for level in range(depth + 1):
        # Tables of a level are made of distinct parts of its wide rows, so their count bounds them.
        here = _open(wide, labels, small)
        outer = here.where(F.col("label") != F.col("main"))
        pivots = popular(outer.where((F.col("out") > FEW) & (F.col("cnt") > limit)), small)
        # A pivot stands outside its bucket's main component, where its own label is known.
        own = outer.select("node", F.col("id").alias("pivot"), F.col("label").alias("own"))
        test(_ordered(here.join(small(pivots.join(own, ["node", "pivot"])), "node").where("label <> own"), "pivot", "id"))
        here = _open(here.select("node", "id"), labels, small)
        if here.isEmpty():
            break
        direct = F.lit(level == depth) | (F.col("cnt") <= limit) | (F.col("cnt") * F.col("out") <= WORK)
        test(_across(here.where(direct), sift))
        rest = here.where(~direct)
        if rest.isEmpty():
            break
        wide = shared_buckets(branch(rest.select("node", "id"), level + 1)).select("node", "id")
        small = broadcaster(wide.count())
    return labels


def _open(rows: DataFrame, labels: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, id, label, cnt, main, out) of the (node, id) buckets with more than one component; out is the number of members outside the largest, main."""
    told = materialize(_labelled(rows, labels), "labelled")
    groups = told.groupBy("node", "label").agg(F.count("*").alias("n"))
    main = groups.groupBy("node").agg(F.sum("n").alias("cnt"), F.max(F.struct("n", "label")).alias("main")).where("cnt > main.n")
    main = main.select("node", "cnt", F.col("main.label").alias("main"), (F.col("cnt") - F.col("main.n")).alias("out"))
    return materialize(told.join(small(materialize(main, "main")), "node").select("node", "id", "label", "cnt", "main", "out"), "here")


def _across(here: DataFrame, sift: Sift | None) -> DataFrame:
    """The pairs (a, b) of members of different components of a bucket, from the rows of _open.

    A bucket's members are dealt into blocks and each pair of blocks is a key of its own, so that no
    bucket has to fit in one task.
    """
    cells: list[str] = []
    if sift:
        sketches = sift[0](here.select("id").distinct())
        cells = [c for c in sketches.columns if c != "id"]
        here = here.join(sketches, "id")
    parts = lambda c: F.ceil(F.col(c) / BLOCK)
    part = lambda c: F.pmod(F.xxhash64("id"), parts(c))
    all_ = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), parts(c) - 1))
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ["id", "label", *cells]]
    x = here.where(F.col("label") != F.col("main")).select("node", "main", *side("x"), part("out").alias("i"), all_("cnt").alias("j"))
    y = here.select("node", *side("y"), part("cnt").alias("j"), all_("out").alias("i"))
    met = x.join(y, ["node", "i", "j"]).where((F.col("x_label") != F.col("y_label")) & ((F.col("y_label") == F.col("main")) | (F.col("x_id") < F.col("y_id"))))
    if sift:
        met = met.where(sift[1]("x_", "y_"))
    return _ordered(met, "x_id", "y_id")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with the component of each id so far as label; an id without links is its own."""
    names = broadcaster(labels.count())(labels.withColumnRenamed("component_id", "label"))
    return rows.join(names, "id", "left").withColumn("label", F.coalesce("label", "id"))
